"""Tables that count only once they are committed, and the log of finished chunks built on them.

A commit writes its part of each table below ``data/<table>/commit=<id>`` and then publishes one small file: it is written
beside the log and renamed into it, so all tables of a commit become visible at once or not at all.
A job that is killed before the rename leaves files that no reader looks at; ``vacuum`` removes them.
Any folder works that all executors and the driver share.
"""

import json
import time
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselens.plans.joins import lookup_join
from sparselens.plans.slabs import place

CHUNKS_PER_FOLDER = 1_000
_RANGE = "chunk_range"


def write_commit(path, tables, partition=None):
    """Write the named frames and publish them together; returns the commit's id.

    ``partition`` maps a table's name to its partition columns. Ids sort by the time a commit began.
    """
    commit = f"c{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        writer = frame.write
        if (partition or {}).get(name):
            writer = writer.partitionBy(*partition[name])
        writer.parquet(f"{path}/data/{name}/commit={commit}")
    publish(path, commit, {name: frame.schema.json() for name, frame in tables.items()})
    return commit


def publish(path, commit, schemas):
    """The step that makes a commit count: an atomic rename."""
    fs, root = place(path)
    for folder in ("pending", "commits"):
        fs.create_dir(f"{root}/{folder}", recursive=True)
    with fs.open_output_stream(f"{root}/pending/{commit}.json") as out:
        out.write(json.dumps(schemas).encode())
    fs.move(f"{root}/pending/{commit}.json", f"{root}/commits/{commit}.json")


def commits(path):
    """Ids of all commits in the order they began: one entry a commit, in the driver."""
    fs, root = place(path)
    found = fs.get_file_info(pa.fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json"))


def schemas_of(path, commit):
    """{table: schema} of a commit."""
    fs, root = place(path)
    with fs.open_input_stream(f"{root}/commits/{commit}.json") as source:
        return {name: T.StructType.fromJson(json.loads(text)) for name, text in json.loads(source.read()).items()}


def read_commit(spark, path, table, commit=None):
    """A table of one commit, by default of the last."""
    known = commits(path)
    commit = commit or (known[-1] if known else None)
    if commit not in known:
        raise ValueError(f"no such commit below {path}: {commit}")
    return spark.read.schema(schemas_of(path, commit)[table]).parquet(f"{path}/data/{table}/commit={commit}")


def read_all(spark, path, table):
    """A table over all commits with the id of each row's ``commit``; None without a commit."""
    known = commits(path)
    if not known:
        return None
    shape = T.StructType([*schemas_of(path, known[-1])[table].fields, T.StructField("commit", T.StringType())])
    root = f"{path}/data/{table}"
    return spark.read.schema(shape).option("basePath", root).parquet(*[f"{root}/commit={c}" for c in known])


def vacuum(path):
    """Delete what was written but never published. Only while no job writes."""
    fs, root = place(path)
    known = {f"commit={c}" for c in commits(path)}
    for table in fs.get_file_info(pa.fs.FileSelector(f"{root}/data", allow_not_found=True)):
        for entry in fs.get_file_info(pa.fs.FileSelector(table.path)):
            if entry.base_name not in known:
                fs.delete_dir(entry.path)
    for entry in fs.get_file_info(pa.fs.FileSelector(f"{root}/pending", allow_not_found=True)):
        fs.delete_file(entry.path)


# ---- finished chunks ------------------------------------------------------------------

def finish_chunks(rows, chunks, path, key="chunk_id", chunks_per_folder=CHUNKS_PER_FOLDER):
    """Write the rows made from ``chunks`` and note these chunks as finished, those without rows too.

    A folder holds a range of chunks, and rows are rebalanced by range: the number of files follows the
    amount of data, not of chunks. Chunks that are finished already may come again, from a job that ran
    beside this one; readers take the rows of the commit that began first.
    """
    ranged = rows.withColumn(_RANGE, F.floor(F.col(key) / chunks_per_folder).cast("long")).hint("rebalance", _RANGE)
    return write_commit(path, {"rows": ranged, "finished": chunks.select(key).distinct()}, {"rows": [_RANGE]})


def finished_chunks(spark, path, key="chunk_id"):
    """Distinct ids of finished chunks; an empty frame where nothing was committed."""
    found = read_all(spark, path, "finished")
    return spark.createDataFrame([], f"{key} long") if found is None else found.select(key).distinct()


def read_finished(spark, path, key="chunk_id"):
    """The rows of all finished chunks, each chunk from one commit only."""
    rows, done = read_all(spark, path, "rows"), read_all(spark, path, "finished")
    if rows is None:
        raise ValueError(f"nothing was committed below {path}")
    first = done.groupBy(key).agg(F.min("commit").alias("commit"), F.count("*").alias("_times"))
    if first.where("_times > 1").isEmpty():  # the usual case: every chunk was finished once
        return rows.drop(_RANGE, "commit")
    return lookup_join(rows, first.drop("_times"), [key, "commit"], "left_semi").drop(_RANGE, "commit")


def pending_rows(rows, path, key="chunk_id"):
    """Input rows of chunks that are not finished; rows without a chunk are no chunk's and go."""
    done = finished_chunks(rows.sparkSession, path, key)
    return lookup_join(rows.where(F.col(key).isNotNull()), done, key, "left_anti")


def resume(rows, make, path, key="chunk_id", per_commit=None):
    """Run ``make`` over the input rows of pending chunks and commit the results; returns the number of commits.

    ``per_commit`` chunks go into a commit (all by default), in ascending order: a killed job loses the
    open commit at most.
    """
    todo = pending_rows(rows, path, key)
    ids = todo.select(key).distinct()
    if per_commit is None:
        if ids.isEmpty():
            return 0
        finish_chunks(make(todo), ids, path, key)
        return 1
    bounds = sorted(r[0] for r in ids.collect())  # one id a chunk, hundreds of documents each
    parts = [bounds[k:k + per_commit] for k in range(0, len(bounds), per_commit)]
    for part in parts:
        inside = todo.where(F.col(key).between(part[0], part[-1]))
        finish_chunks(make(inside), inside, path, key)
    return len(parts)
