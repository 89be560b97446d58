"""Helpers the operators share: staged tables, words of Arrow batches, components."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselens.session import shared_dir

#: Rows up to which a narrow keyed table (a few dozen bytes a row) is broadcast.
BROADCAST_ROWS = 100_000
SALTS = 16


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark, name):
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df, name="stage"):
    """The frame written as a table in the shared folder and read back: it is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs, **views):
    """Whole rows as the struct ``row`` beside the columns a step needs, so that no name of the
    documents clashes with a working column."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), *(c.alias(k) for k, c in views.items()))


def box_schema(docs, **more):
    """The schema of boxed rows and further columns."""
    fields = [T.StructField("row", boxed(docs).schema["row"].dataType)]
    return T.StructType(fields + [T.StructField(k, t) for k, t in more.items()])


def join_small(big, small, keys, how="inner", spread_by=()):
    """Join with a small keyed table: broadcast once it is counted and short, else salted."""
    small = staged(small)
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    copies = F.explode(F.array(*map(F.lit, range(SALTS))))
    return (big.withColumn("_salt", salt)
            .join(small.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt"))


def sliced(batches, column, most=4 << 20):
    """The batches cut into slices of at most about ``most`` bytes of a text or binary column;
    a longer value is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, lo = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def words_of(texts, lower=True):
    """Words (runs without ASCII white space) of an Arrow string array.

    Returns ``codes`` (index of each word in ``unique``), ``unique`` (an Arrow array) and
    ``bounds``: document i has the words ``codes[bounds[i]:bounds[i + 1]]``. Null texts have none.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (pc.ascii_lower(texts) if lower else texts).cast(pa.large_string())  # lowering goes wrong on a cast slice
    lists = pc.ascii_split_whitespace(texts)
    encoded = lists.flatten().dictionary_encode()
    unique = encoded.dictionary
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    empty = pc.index(unique, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return codes, unique, bounds


def components(edges):
    """Connected components: ``edges`` (a, b) to (node, label), label the smallest node.

    Smallest labels go to the neighbours and each label is replaced by its own label, until
    nothing changes. Every round is a staged table; links never reach the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        offered = (both.join(labels.select(F.col("node").alias("a"), "label"), "a")
                   .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near")))
        met = staged(labels.join(offered, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        own = met.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(met.join(own, "label").select("node", F.col("next").alias("label"), "was"), "labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
