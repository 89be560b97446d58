"""Tables, views, readers and writers."""

import warnings

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sparselens import schema


def table_exists(spark, name):
    return spark.catalog.tableExists(name)


def create_features_table(spark, name, path, location=None):
    """Load all parquet shards below ``path`` into a table; an existing table is kept."""
    if table_exists(spark, name):
        warnings.warn(f"table {name!r} exists and is kept", UserWarning, stacklevel=2)
        return spark.table(name)
    writer = spark.read.parquet(path).write.mode("ignore").format("parquet")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return spark.table(name)


def lazy_features_view(spark, name, path):
    """View that reads the shards when it is queried."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.table(name)


def register(frame, name):
    frame.createOrReplaceTempView(name)


def unregister(spark, name):
    return spark.catalog.dropTempView(name)


def drop_table(spark, name):
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def drop_column(spark, table, column, location=None):
    """Rewrite a table without a column.

    The rows are written to a new place first and the name is switched afterwards, so a lost
    executor never leaves a half-written table under the name.
    """
    staged = f"{table}__rewrite"
    drop_table(spark, staged)
    writer = spark.table(table).drop(column).write.format("parquet")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(staged)
    drop_table(spark, table)
    spark.sql(f"ALTER TABLE `{staged}` RENAME TO `{table}`")
    return spark.table(table)


def query(spark, sql, args=None, **frames):
    """SQL over registered tables; ``frames`` are referred to as {name} in the text."""
    return spark.sql(sql, args, **frames) if frames else spark.sql(sql, args)


def memoise(frame):
    """Keep a result for repeated use by the caller; spills to disk."""
    return frame.persist(StorageLevel.MEMORY_AND_DISK)


# ---- activations --------------------------------------------------------------------

def typed_activations(act):
    return act.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.ACTIVATIONS])


def write_activations(act, path, mode="overwrite", max_records=5_000_000):
    """Typed parquet, one folder per chunk.

    Rows are rebalanced by chunk: small chunks share a task, a very large chunk is split, and
    files stay bounded.
    """
    (typed_activations(act).hint("rebalance", "chunk_id")
     .write.mode(mode).option("maxRecordsPerFile", max_records)
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("chunk_id").parquet(path))


def write_by_feature(act, path, mode="overwrite"):
    """Layout for per-feature reads: row groups hold narrow feature ranges.

    Ranges are taken over (feature, value), so one very frequent feature fills many files.
    """
    (typed_activations(act).repartitionByRange("feature_id", "activation_value")
     .sortWithinPartitions("feature_id", F.desc("activation_value"))
     .write.mode(mode).parquet(path))


def read_activations(spark, path):
    return spark.read.schema(schema.ACTIVATIONS).parquet(path)


def write_alive_set(alive, path, mode="overwrite"):
    """Sorted distinct feature ids as JSON lines."""
    alive.select("feature_id").distinct().orderBy("feature_id").write.mode(mode).json(path)


def read_alive_set(spark, path):
    return spark.read.schema("feature_id int").json(path)


# ---- chunks of vectors --------------------------------------------------------------

def write_chunks(rows, path, mode="overwrite"):
    """Vector rows, one folder per chunk."""
    rows.hint("rebalance", "chunk_id").write.mode(mode).partitionBy("chunk_id").parquet(path)


def read_chunks(spark, path):
    return spark.read.parquet(path)


def expand_chunks(chunks, ids="token_ids", vectors="activations", key="chunk_id"):
    """One row per sample of chunks stored as two parallel arrays.

    Arrays of different length stop the job with an error.
    """
    zipped = F.when(F.size(ids) != F.size(vectors), F.raise_error(F.concat(
        F.lit("mismatched lengths in chunk "), F.col(key).cast("string")))).otherwise(
        F.arrays_zip(F.col(ids).alias("token_id"), F.col(vectors).alias("vec")))
    return chunks.select(key, F.posexplode(zipped).alias("pos", "_s")).select(
        key, "pos", "_s.token_id", "_s.vec")


def pending_chunks(rows, done, key="chunk_id"):
    """Rows of chunks that are not finished yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
