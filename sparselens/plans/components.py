"""Connected groups of a graph given as links."""

from pyspark.sql import functions as F

from sparselens.session import staged


def connected(links, nodes, a="a", b="b", node="node"):
    """Each node with the smallest id of its group, itself included: (``node``, ``group_id``).

    Every round a node takes the smallest label among itself and its neighbours, then the label of
    that label, so long chains shrink by more than one step. A round is a table in the shared folder;
    a lost task reads the last one. Rounds end when no label changes. Links to ids that are not among
    the nodes count as nodes too; repeated links, loops and either direction are allowed.
    """
    ends = links.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null")
    both = staged(ends.union(ends.select("_b", "_a")).where("_a <> _b").distinct(), "links")
    known = nodes.select(F.col(node).alias("_n")).where("_n is not null").union(both.select("_a")).distinct()
    labels = staged(known.select("_n", F.col("_n").alias("_label")), "labels")
    while True:
        near = both.join(labels.select(F.col("_n").alias("_b"), "_label"), "_b").groupBy(F.col("_a").alias("_n")).agg(
            F.min("_label").alias("_near"))
        taken = staged(labels.join(near, "_n", "left").select(
            "_n", F.least("_label", "_near").alias("_next"), F.col("_label").alias("_was")), "labels")
        over = taken.select(F.col("_n").alias("_next"), F.col("_next").alias("_after"))
        after = staged(taken.join(over, "_next").select("_n", F.col("_after").alias("_label"), "_was"), "labels")
        labels = after.select("_n", "_label")
        if after.where("_label <> _was").isEmpty():
            return labels.select(F.col("_n").alias(node), F.col("_label").alias("group_id"))
