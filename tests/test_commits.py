"""Commits are all or nothing; finished chunks are not done again."""

import os

import pytest
from pyspark.sql import functions as F

from sparselens.operators import report as rp
from sparselens.sources import commits as cm

ROWS = "sample_id long, chunk_id long, v double"


def samples(spark, chunks):
    return spark.createDataFrame([(10 * c + k, c, float(k)) for c in chunks for k in range(4)], ROWS)


def make(rows):
    """Chunk 2 yields no row."""
    return rows.where("v > 0 and chunk_id <> 2")


def result(spark, path):
    return sorted(tuple(r) for r in cm.read_finished(spark, path).select("sample_id", "chunk_id", "v").collect())


def parts(path):
    return len(os.listdir(f"{path}/data/rows"))


def wanted(chunks):
    return sorted((10 * c + k, c, float(k)) for c in chunks if c != 2 for k in range(1, 4))


def test_resume_does_the_rest_once(spark, tmp_path):
    path, rows = str(tmp_path / "log"), samples(spark, range(-3, 9))
    assert cm.finished_chunks(spark, path).count() == 0 and cm.commits(path) == []
    early = rows.where("chunk_id in (0, 2, 5)")
    cm.finish_chunks(make(early), early, path, chunks_per_folder=3)
    assert {r.chunk_id for r in cm.finished_chunks(spark, path).collect()} == {0, 2, 5}  # 2 has no row
    assert {r.chunk_id for r in cm.pending_rows(rows, path).collect()} == set(range(-3, 9)) - {0, 2, 5}
    done = []
    assert cm.resume(rows, lambda part: (done.extend(r.chunk_id for r in part.select("chunk_id").distinct().collect()), make(part))[1], path, per_commit=4) == 3
    assert sorted(done) == [-3, -2, -1, 1, 3, 4, 6, 7, 8]
    assert cm.resume(rows, make, path) == 0 and len(cm.commits(path)) == 4
    assert result(spark, path) == wanted(range(-3, 9))


class Unmoved:
    """A file system whose job dies at the rename."""

    def __init__(self, fs, die):
        self.fs, self.move = fs, die

    def __getattr__(self, name):
        return getattr(self.fs, name)


@pytest.mark.parametrize("where", ["write", "rename"])
def test_a_killed_job_leaves_nothing_that_counts(spark, tmp_path, monkeypatch, where):
    path, rows = str(tmp_path / "log"), samples(spark, range(6))
    cm.resume(rows.where("chunk_id < 2"), make, path)

    def die(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if where == "write":  # rows are written, nothing is published
            m.setattr(cm, "publish", die)
        else:  # the commit's file is there, but not renamed
            whole = cm.place
            m.setattr(cm, "place", lambda uri: (Unmoved(whole(uri)[0], die), whole(uri)[1]))
        with pytest.raises(KeyboardInterrupt):
            cm.finish_chunks(make(rows.where("chunk_id >= 2")), rows.where("chunk_id >= 2"), path)
    assert parts(path) == 2 and result(spark, path) == wanted(range(2))
    assert cm.resume(rows, make, path) == 1
    assert result(spark, path) == wanted(range(6)) and parts(path) == 3
    cm.vacuum(path)
    assert parts(path) == len(cm.commits(path)) == 2 and result(spark, path) == wanted(range(6))


def test_two_jobs_that_finish_the_same_chunk(spark, tmp_path):
    path, rows = str(tmp_path / "log"), samples(spark, range(4))
    cm.finish_chunks(make(rows), rows, path)
    other = rows.where("chunk_id >= 2").withColumn("v", F.col("v") + 100)
    cm.finish_chunks(other, other, path)
    assert result(spark, path) == wanted(range(4))


def test_chunk_ranges_share_folders(spark, tmp_path):
    path, rows = str(tmp_path / "log"), samples(spark, range(30))
    commit = cm.finish_chunks(rows, rows, path, chunks_per_folder=10)
    folders = [f for f in os.listdir(f"{path}/data/rows/commit={commit}") if f.startswith("chunk_range")]
    assert sorted(folders) == [f"chunk_range={k}" for k in range(3)] and len(result(spark, path)) == 120


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, None, 1.0), (None, 4, None), (None, 4, None)], ROWS)
    assert cm.resume(rows, lambda r: r, path) == 1
    assert sorted(map(str, cm.read_finished(spark, path).select("sample_id", "chunk_id", "v").collect())) == ["Row(sample_id=None, chunk_id=4, v=None)"] * 2
    assert cm.resume(rows, lambda r: r, path) == 0
    none = str(tmp_path / "none")
    assert cm.resume(rows.where("false"), lambda r: r, none) == 0
    with pytest.raises(ValueError, match="nothing was committed"):
        cm.read_finished(spark, none)
    only_empty = str(tmp_path / "empty")
    cm.resume(samples(spark, [2]), make, only_empty)
    assert cm.read_finished(spark, only_empty).count() == 0 and cm.finished_chunks(spark, only_empty).count() == 1


def test_report_versions(spark, tmp_path, monkeypatch):
    """A report whose writing stops half-way is never read: the last whole version stays."""
    path = str(tmp_path / "report")
    tables = {"a": spark.range(3).select(F.col("id").alias("x")), "b": spark.createDataFrame([("u", None)], "k string, v int")}
    first = rp.save_report(tables, path)
    broken = {"a": spark.range(9).select(F.col("id").alias("x")), "b": spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("k"))}
    with pytest.raises(Exception, match="stop"):
        rp.save_report(broken, path)
    assert rp.report_versions(path) == [first] and rp.read_report(spark, path, "a").count() == 3
    second = rp.save_report({"a": spark.range(5).select(F.col("id").alias("x"))}, path)
    assert rp.report_versions(path) == [first, second] and rp.read_report(spark, path, "a").count() == 5
    assert rp.read_report(spark, path, "a", first).count() == 3 and rp.read_report(spark, path, "b", first).schema == tables["b"].schema
    with pytest.raises(ValueError, match="no such commit"):
        rp.read_report(spark, path, "a", "other")
