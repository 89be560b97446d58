"""Incremental extraction: vector chunks arrive as files, activations are appended."""

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.operators.activations import active_entries, trimmed_entries
from sparselens.operators.autoencoder import encode
from sparselens.operators.resample import step_window


def vector_stream(spark, path, row_schema=schema.VECTORS, files_per_trigger=None, **options):
    """Stream over parquet chunk files of a folder."""
    reader = spark.readStream.schema(row_schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def active_stream(samples, model=None, threshold=schema.ACTIVATION_THRESHOLD,
                  top_k_features=schema.FEATURES_PER_SAMPLE):
    """Threshold and per-sample trim. A dense vector is one row, so nothing is kept between
    batches; contexts need neighbours and are joined afterwards in batch."""
    if model is not None:
        return encode(samples, model, threshold, top_k_features)
    if top_k_features is None:
        return active_entries(samples, threshold)
    return trimmed_entries(samples, threshold, top_k_features)


def append_to(stream, path, checkpoint):
    """Append to parquet, all available input, then stop; a restart continues after the last
    committed file and writes nothing twice."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def rewrite_result(stream, path, checkpoint):
    """Keep the complete result of a small aggregate at ``path``; repeating a batch is safe."""
    def save(batch, _):
        batch.write.mode("overwrite").parquet(path)
    return (stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(availableNow=True).start())


def alive_counts(active):
    """Records per unit seen so far; state is one row per unit."""
    return active.groupBy("feature_id").agg(F.count("*").alias("num_activations"))


def fire_parts(active, every=schema.RESAMPLE_EVERY, step="step"):
    """Per step window and unit, the steps with a positive value as bitmaps of 32,768 steps.

    The row with a null unit holds the last step of the input.
    """
    fired = active.where(F.col("activation_value") > 0).select(
        step_window(F.col(step), every).cast("long").alias("step_window"), "feature_id",
        F.bitmap_bucket_number(F.col(step)).alias("bucket"), F.col(step).cast("long").alias("step"))
    parts = fired.groupBy("step_window", "feature_id", "bucket").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("step"))).alias("steps"), F.max("step").alias("last_step"))
    last = active.agg(F.max(F.col(step).cast("long")).alias("last_step")).where("last_step is not null")
    return parts.unionByName(last, allowMissingColumns=True)


def save_fire_parts(active, path, checkpoint, every=schema.RESAMPLE_EVERY, step="step"):
    """Write the parts of each micro-batch under its number; a repeated batch replaces its own.

    Nothing depends on the order in which steps come, and no state is kept between batches.
    """
    def save(batch, number):
        fire_parts(batch, every, step).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return (active.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(availableNow=True).start())


def fire_counts(parts, every=schema.RESAMPLE_EVERY):
    """Per complete step window and unit, the number of distinct steps with a positive value.

    A window is complete once the last step seen lies at or past its end, as in
    ``resample.dead_per_window``.
    """
    complete = F.floor(parts.agg(F.max("last_step")).scalar() / every)
    whole = (parts.where(F.col("feature_id").isNotNull()).where(F.col("step_window") < complete)
             .groupBy("step_window", "feature_id", "bucket").agg(F.bitmap_or_agg("steps").alias("steps")))
    return whole.groupBy("step_window", "feature_id").agg(F.sum(F.bitmap_count("steps")).alias("fire_count"))
