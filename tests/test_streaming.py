"""Incremental runs give the batch result and continue after a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselens import schema
from sparselens.operators import activations as ac
from sparselens.operators import resample as rs
from sparselens.streaming import incremental as inc


def chunk(spark, start, n=40, dim=12):
    x = np.random.default_rng(start).normal(size=(n, dim))
    return spark.createDataFrame([(start + i, i % 5, start // n, [float(v) for v in row]) for i, row in enumerate(x)],
                                 schema.VECTORS)


def test_restart_continues_where_it_stopped(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    def run():
        inc.append_to(inc.active_stream(inc.vector_stream(spark, src, files_per_trigger=1)), out, mark).awaitTermination()
        return spark.read.parquet(out)

    chunk(spark, 0).write.mode("append").parquet(src)
    first = run().count()
    chunk(spark, 40).write.mode("append").parquet(src)
    rows = run()
    want = ac.strongest_per_sample(ac.active_entries(spark.read.schema(schema.VECTORS).parquet(src)))
    key = ("sample_id", "feature_id", "activation_value")
    assert first < rows.count()
    assert sorted(rows.select(*key).collect()) == sorted(want.select(*key).collect())
    assert run().count() == rows.count()


def test_alive_counts_grow(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for start in (0, 40):
        chunk(spark, start).write.mode("append").parquet(src)
        stream = inc.active_stream(inc.vector_stream(spark, src), top_k_features=None)
        inc.rewrite_result(inc.alive_counts(stream), out, mark).awaitTermination()
    got = {r.feature_id: r.num_activations for r in spark.read.parquet(out).collect()}
    want = ac.active_entries(spark.read.schema(schema.VECTORS).parquet(src)).groupBy("feature_id").count().collect()
    assert got == {r.feature_id: r["count"] for r in want}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_fire_counts_equal_batch(spark, tmp_path, order):
    """25 steps in windows of 5: all five windows are complete, whatever file comes first."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    def stepped(df):
        return df.withColumn("step", F.expr("sample_id div 8") + 1)

    rows = chunk(spark, 0, n=200)
    for part in order:
        rows.where(F.expr(f"sample_id div 67 = {part}")).coalesce(1).write.mode("append").parquet(src)
        stream = stepped(inc.active_stream(inc.vector_stream(spark, src, files_per_trigger=1), threshold=1.5, top_k_features=None))
        inc.save_fire_parts(stream, out, mark, 5).awaitTermination()
    got = {(r.step_window, r.feature_id): r.fire_count for r in inc.fire_counts(spark.read.parquet(out), 5).collect()}
    batch = stepped(ac.active_entries(spark.read.schema(schema.VECTORS).parquet(src), 1.5))
    want = batch.groupBy(rs.step_window(F.col("step"), 5).alias("w"), "feature_id").agg(F.count_distinct("step").alias("n")).collect()
    assert got == {(r.w, r.feature_id): r.n for r in want} and {w for w, _ in got} == set(range(5))
