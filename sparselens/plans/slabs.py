"""Weights of any size as files in the shared folder, read slab by slab inside tasks.

A slab is an Arrow file with some consecutive units. Tasks map it into memory where the folder
is a mounted one, so all tasks of a machine share its pages, and otherwise read it; in both cases
one slab at a time. No task and no driver ever holds all weights.
"""

import functools
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

from sparselens.session import shared_dir

# Numbers of one matrix in a slab: 8 MB.
SLAB_CELLS = 1 << 20

_MANIFEST = "uri string, first long, units long, dim long"


class Slab(NamedTuple):
    """Units in ascending order of ``ids``; rows of both matrices belong to them."""
    ids: np.ndarray
    w_enc: np.ndarray
    w_dec: np.ndarray
    b_enc: np.ndarray


def place(uri):
    """File system and path of a URI or a plain path."""
    return pa.fs.FileSystem.from_uri(uri) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


def matrix(column, dim=None):
    """Arrow list column to a dense matrix; all rows must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    width = dim if dim is not None else (len(flat) // max(len(column), 1))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError("vectors of different length")
    return flat.reshape(len(column), width)


def write_slabs(weights, decoder="w_dec", cells=None):
    """Write (feature_id, w_enc, b_enc and the decoder column) as slabs; returns [(uri, units)] in order of units.

    Tasks take ranges of units, so each holds one slab. A slab counts once its name is in the
    result: files of lost attempts are never read. A unit must have one row.
    """
    cells = SLAB_CELLS if cells is None else cells
    rows = weights.select(F.col("feature_id").cast("long").alias("feature_id"), F.col("w_enc").cast("array<double>").alias("w_enc"),
                          F.col(decoder).cast("array<double>").alias("_dec"), F.col("b_enc").cast("double").alias("b_enc"))
    return _write(rows, lambda dim: cells // max(dim, 1))


def write_rows(rows, key="id", vec="vec", units=512):
    """Vectors with ids as slabs of ``units`` rows without decoder and bias, in order of ids; ids may
    repeat, rows without one are left out. Returns [(uri, units)]."""
    rows = rows.select(F.col(key).cast("long").alias("feature_id"), F.col(vec).cast("array<double>").alias("w_enc"))
    return _write(rows.where(F.col("feature_id").isNotNull()), lambda dim: units, False)


def _write(rows, room, unique=True):
    folder = f"{shared_dir(rows.sparkSession).rstrip('/')}/weights-{uuid.uuid4().hex}"

    def save(parts):
        columns = [np.concatenate(p) for p in zip(*parts)]
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        fs, path = place(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]) if c.ndim == 2 else pa.array(c) for c in columns]
        batch = pa.RecordBatch.from_arrays(arrays, list(Slab._fields[:len(arrays)]))
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, batch.schema) as writer:
            writer.write_batch(batch)
        ids, enc = columns[:2]
        return pa.RecordBatch.from_pylist([{"uri": uri, "first": int(ids[0]), "units": len(ids), "dim": enc.shape[1]}])

    def run(batches):
        held, count, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if any(c.null_count for c in batch.columns):
                raise ValueError("a unit without an id, a row or a bias")
            ids = batch.column(0).to_numpy()
            columns = [ids, *(matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns[1:])]
            enc = columns[1]
            if any(c.shape != enc.shape for c in columns[1:] if c.ndim == 2) or (held and held[0][1].shape[1] != enc.shape[1]):
                raise ValueError("vectors of different length")
            if unique and ((np.diff(ids) == 0).any() or last == ids[0]):
                raise ValueError("a unit with several rows")
            last, units, lo = ids[-1], max(1, room(enc.shape[1])), 0
            while lo < len(ids):
                hi = min(len(ids), lo + units - count)
                held.append([c[lo:hi] for c in columns])
                count, lo = count + hi - lo, hi
                if count == units:
                    yield save(held)
                    held, count = [], 0
        if held:
            yield save(held)

    found = rows.repartitionByRange("feature_id").sortWithinPartitions("feature_id").mapInArrow(run, _MANIFEST).collect()
    if len({r["dim"] for r in found}) > 1:
        raise ValueError("vectors of different length")
    return [(r["uri"], r["units"]) for r in sorted(found, key=lambda r: r["first"])]


def remove_slabs(slabs):
    """Delete the files; frames that still read them fail afterwards."""
    for uri, _ in slabs:
        fs, path = place(uri)
        fs.delete_file(path)


def _slab(source):
    batch = pa.ipc.open_file(source).get_batch(0)
    rows = [c.flatten().to_numpy().reshape(batch.num_rows, -1) for c in batch.columns[1:3]]
    bias = batch.column(3).to_numpy() if batch.num_columns > 3 else None
    return Slab(batch.column(0).to_numpy(), rows[0], rows[-1], bias)


# Pages of a mapped file count as memory of the worker, so old slabs are let go.
@functools.lru_cache(maxsize=1)
def _mapped(path):
    return _slab(pa.memory_map(path))


@functools.lru_cache(maxsize=1)
def _loaded(uri):
    fs, path = place(uri)
    return _slab(fs.open_input_file(path).read_buffer())


def open_slab(uri):
    """A slab in this worker, mapped or read; only the last one is kept, so memory does not grow with the weights."""
    fs, path = place(uri)
    return _mapped(path) if isinstance(fs, pa.fs.LocalFileSystem) else _loaded(uri)
