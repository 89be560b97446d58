"""Positions of rows in the order of any sortable key, without a window over rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparselens.session import staged

# monotonically_increasing_id: the number of the partition stands above this many bits.
_ROW_BITS = 33


def number_rows(df, order, by=(), name="idx"):
    """0-based position of every row in ``order`` within ``by``: ``name`` is added to the columns.

    ``order`` lists columns of any sortable type (names, or expressions with asc or desc). Spark
    samples the whole key (by, order) and cuts the rows into ranges of equal size, so a group that
    holds most of the rows lies in many ranges. Each range is sorted in its task and written once with
    the place of each row; the rows of each group in each range are counted from that table, and the
    sums of the ranges before are joined back. Keys that are equal get positions in any order. Nulls
    come first in ascending order; null groups are groups.
    """
    by = list(by)
    columns = list(df.columns)
    placed = staged(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_at", _ROW_BITS).cast("int"))
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    if by:
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(by)]
        starts = starts.select(*keys, F.col("_range").alias("_part"), "_first", "_before")
    else:  # one row a range: as many as the shuffle has partitions
        rows, total = [], 0
        for r in sorted(counts.collect(), key=lambda r: r["_range"]):
            rows.append((r["_range"], r["_first"], total))
            total += r["_rows"]
        starts = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _first long, _before long"))
    met = F.col("_range") == F.col("_part")
    for i, k in enumerate(by):
        met = met & placed[k].eqNullSafe(starts[f"_key{i}"])
    return placed.join(starts, met).select(
        *[placed[f"`{c}`"] for c in columns], (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))
