"""Deterministic splits, batches, shards and file numbers."""

import warnings

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.functions.text import natural_key
from sparselens.plans.numbering import number_rows
from sparselens.plans.ordered import WIDTH, dense_index, rank_by_hash


def split_keys(df, key, train=0.8, val=0.1, test=0.1, seed=42):
    """Assign each unique key to train, val or test in a seeded shuffle order.

    Train and val get floor(n * ratio) keys; all others go to test.
    """
    total = train + val + test
    if total > 1.0:
        raise ValueError(f"the ratios sum to {total}, more than 1")
    if total < 1.0:
        warnings.warn(f"the ratios sum to {total}, less than 1; the rest goes to test",
                      UserWarning, stacklevel=2)
    ranked = rank_by_hash(df, key, seed, "_rank")
    n = df.agg(F.count("*")).scalar()
    n_train, n_val = F.floor(n * F.lit(float(train))), F.floor(n * F.lit(float(val)))
    part = (F.when(F.col("_rank") < n_train, "train")
            .when(F.col("_rank") < n_train + n_val, "val").otherwise("test"))
    return ranked.withColumn("split", part).drop("_rank")


def batch_index(df, order="sample_id", by=("split",), size=schema.TRAIN_BATCH, width=WIDTH):
    """Number of the batch of ``size`` consecutive rows, within each split."""
    indexed = dense_index(df, order, by, "_at", width)
    return indexed.withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def natural_order(files, name="file"):
    """Distinct file names with their 0-based natural position, however many there are."""
    numbered = number_rows(files.select(name).distinct(), [natural_key(F.col(name)), name], name="chunk_index")
    return numbered.withColumn("chunk_index", F.col("chunk_index").cast("int"))


def shard_files(files, workers, name="file"):
    """Round-robin share of the naturally ordered files for each worker."""
    return natural_order(files, name).withColumn("worker", F.pmod(F.col("chunk_index"), F.lit(workers)))
