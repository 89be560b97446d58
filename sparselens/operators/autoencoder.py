"""Sparse autoencoder arithmetic over tables of vectors, and its losses.

Weights lie in slabs (``plans/slabs.py``). Every operator below is one Arrow pass over the
vectors: a task takes a slice of rows and streams all slabs past it, so the same plan serves
weights of any size, batch frames and streams, and needs no id of a sample.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparselens import schema
from sparselens.functions import vectors as V
from sparselens.plans.inputs import spread
from sparselens.plans.joins import lookup_join
from sparselens.plans.slabs import matrix, open_slab, remove_slabs, write_slabs

# Unit values held at a time by one task: 16 MB.
CELLS_AT_ONCE = 2 << 20
# Values of all units that one task gathers before they leave it.
CELLS_HELD = 2 << 20
# Values of all units among which ``forward`` gathers the active ones of some rows; 12 bytes each.
CELLS_FORWARD = 8 << 20
# Rows of a batch that leaves a task.
ROWS_OUT = 1 << 17
# Numbers of vectors among which a task looks for the best rows of each unit: 16 MB.
VECTORS_HELD = 2 << 20


class Autoencoder:
    """Weights as a table with one row per unit, and the one-row decoder bias.

    ``weights`` has feature_id, w_enc, w_dec, b_enc; ``b_dec`` has one array column of the
    same name. With ``tied`` weights the decoder uses the encoder rows. The slabs are written
    when the first operator asks for them; ``remove`` deletes them. ``slab_cells`` sets their size.
    """

    def __init__(self, weights, b_dec, tied=False, slab_cells=None):
        self.weights, self.b_dec, self.tied, self.slab_cells = weights, b_dec, tied, slab_cells
        self._size = self._slabs = self._bias = None

    @property
    def size(self):
        """(number of units, vector length); one small aggregate over the weights table."""
        if self._size is None:
            self._size = tuple(self.weights.agg(
                F.count("*"), F.coalesce(F.max(F.size("w_enc")), F.lit(0))).first())
        return self._size

    def slabs(self):
        """[(uri, units)]: a short list, whatever the size of the weights."""
        if self._slabs is None:
            self._slabs = write_slabs(self.weights, "w_enc" if self.tied else "w_dec", self.slab_cells)
        return self._slabs

    def bias(self):
        if self._bias is None:
            self._bias = np.asarray(self.b_dec.select("b_dec").first()[0], dtype="float64")
        return self._bias

    def remove(self):
        remove_slabs(self._slabs or [])
        self._slabs = None


def _slices(batches, width, cells=None):
    """Arrow batches cut so that rows x ``width`` stays bounded."""
    step = max(1, (cells or CELLS_AT_ONCE) // max(width, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _widest(slabs, dim):
    return max([dim, *(units for _, units in slabs)])


def _all_units(slabs, dim):
    return max(dim, sum(units for _, units in slabs))


def _trim(rows, units, values, k):
    """The k largest entries of each row, sorted by (row, value descending, unit)."""
    order = np.lexsort((units, -values, rows))
    rows, units, values = rows[order], units[order], values[order]
    if len(rows):
        first = np.r_[True, rows[1:] != rows[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        keep = np.arange(len(rows)) - start < k
        rows, units, values = rows[keep], units[keep], values[keep]
    return rows, units, values


def _relu(x, slab, bias):
    f = (x - bias) @ slab.w_enc.T
    f += slab.b_enc
    return np.maximum(f, 0.0, out=f)


def _strongest(x, slabs, bias, limit, k):
    """(row, unit, value) above the limit, the best k of each row; one slab's values at a time.

    ``floor`` is the value an entry of the next slab must pass: the k-th best so far, and equal
    values keep the lower unit, which came first.
    """
    rows, units, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(x), limit)
    for uri, _ in slabs:
        slab = open_slab(uri)
        f = _relu(x, slab, bias)
        keep = f > floor[:, None]
        if k is not None and len(slab.ids) > k:
            cut = len(slab.ids) - k
            keep &= f >= np.partition(f, cut, axis=1)[:, cut:cut + 1]
        r, c = np.nonzero(keep)
        rows, units, values = np.append(rows, r), np.append(units, slab.ids[c]), np.append(values, f[r, c])
        if k is not None and len(r):
            rows, units, values = _trim(rows, units, values, k)
            full = np.flatnonzero(np.bincount(rows, minlength=len(x)) >= k)
            if len(full):
                floor[full] = np.maximum(limit, values[np.searchsorted(rows, full, side="right") - 1])
    if k is None:
        order = np.argsort(rows, kind="stable")
        rows, units, values = rows[order], units[order], values[order]
    return rows, units, values


def encode(vectors, model, threshold=0.0, top_k_features=None, vec="vec", top_k_samples=None, sample="sample_id"):
    """Units with ``relu((x - b_dec) . w_enc + b_enc)`` above the threshold, best k per sample.

    One vector is one row, so threshold and trim need no shuffle and no id: rows with a null or
    repeated ``sample_id`` are rows of their own. NaN is never above a threshold. Without a trim
    the entries of each slab leave the task as they are found, in short batches.

    ``top_k_samples`` is for a reader that takes the best rows of each unit, by value and then by
    ``sample``: a task leaves out entries that as many of its other rows of the unit go before.
    """
    if top_k_samples is not None and top_k_features is not None:
        raise ValueError("rows are trimmed per sample or per unit, not both")
    keep = [f for f in vectors.schema.fields if f.name != vec]
    names = [f.name for f in keep]
    out = T.StructType(keep + [T.StructField("feature_id", T.IntegerType()),
                               T.StructField("activation_value", T.DoubleType())])
    arrow = to_arrow_schema(out)
    slabs, bias, limit = model.slabs(), model.bias(), float(threshold)

    def entries(x):
        if top_k_features is not None:
            yield _strongest(x, slabs, bias, limit, top_k_features)
            return
        for uri, _ in slabs:
            slab = open_slab(uri)
            f = _relu(x, slab, bias)
            rows, cols = np.nonzero(f > limit)
            yield rows, slab.ids[cols], f[rows, cols]

    def rows_out(batch, rows, units, values):
        for lo in range(0, len(rows), ROWS_OUT):
            part = slice(lo, lo + ROWS_OUT)
            at = pa.array(rows[part])
            kept = [batch.column(batch.schema.get_field_index(n)).take(at) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(
                [*kept, pa.array(units[part]), pa.array(values[part])], arrow.types)], schema=arrow)

    def run(batches):
        for batch in _slices(batches, _widest(slabs, len(bias))):
            x = matrix(batch.column(batch.schema.get_field_index(vec)), len(bias))
            for found in entries(x):
                yield from rows_out(batch, *found)

    def run_per_unit(batches):
        for batch in _gathered(batches, max(top_k_samples, VECTORS_HELD // max(len(bias), 1))):
            order = pa.compute.sort_indices(batch.column(batch.schema.get_field_index(sample)), null_placement="at_start")
            batch = batch.take(order)
            x = matrix(batch.column(batch.schema.get_field_index(vec)), len(bias)) - bias
            for uri, _ in slabs:
                for found in _best_rows(x, open_slab(uri), limit, top_k_samples):
                    yield from rows_out(batch, *found)

    return spread(vectors).mapInArrow(run if top_k_samples is None else run_per_unit, out)


def _gathered(batches, rows):
    """Arrow batches put together until they have that many rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best_rows(x, slab, limit, k):
    """(row, unit, value) above the limit, the k best rows of each unit; equal values keep the first rows."""
    step = max(1, CELLS_HELD // max(len(x), 1))
    for lo in range(0, len(slab.ids), step):
        f = slab.w_enc[lo:lo + step] @ x.T
        f += slab.b_enc[lo:lo + step, None]
        np.maximum(f, 0.0, out=f)
        f[~(f > limit)] = -np.inf
        if len(x) > k:
            cut = np.partition(f, len(x) - k, axis=1)[:, len(x) - k, None]
            above, level = f > cut, f == cut
            level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)
            above |= level
        else:
            above = np.ones(f.shape, bool)
        above &= f > -np.inf
        units, rows = np.nonzero(above)
        yield rows, slab.ids[lo + units], f[units, rows]


def encode_nested(vectors, model, threshold=0.0, top_k_features=None, vec="vec"):
    """``encode`` with one row a vector: ``features`` is an array of (feature_id, activation_value)."""
    keep = [f for f in vectors.schema.fields if f.name != vec]
    out = T.StructType([*keep, T.StructField("features", _ENTRIES)])
    arrow = to_arrow_schema(out)
    slabs, bias, limit = model.slabs(), model.bias(), float(threshold)
    width = (_widest(slabs, len(bias)),) if top_k_features is not None else (_all_units(slabs, len(bias)), CELLS_HELD)

    def run(batches):
        for batch in _slices(batches, *width):
            x = matrix(batch.column(batch.schema.get_field_index(vec)), len(bias))
            found = _strongest(x, slabs, bias, limit, top_k_features)
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            columns = [c.cast(t) for c, t in zip([*kept, _entries(len(x), *found)], arrow.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spread(vectors).mapInArrow(run, out)


def _entries(n, rows, units, values):
    """Arrow lists of (feature_id, activation_value) for n rows; ``rows`` ascend."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype("int32")
    entries = pa.StructArray.from_arrays([pa.array(units.astype("int32")), pa.array(values.astype("float64"))],
                                         names=["feature_id", "activation_value"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def alive_units(vectors, model, threshold=schema.ACTIVATION_THRESHOLD, vec="vec"):
    """Distinct units above the threshold before any trim.

    Each task reports every unit once, so the result of the big pass is small.
    """
    slabs, bias, limit = model.slabs(), model.bias(), float(threshold)
    out = T.StructType([T.StructField("feature_id", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        seen = [np.zeros(units, bool) for _, units in slabs]
        for batch in _slices(batches, _widest(slabs, len(bias))):
            x = matrix(batch.column(0), len(bias))
            for (uri, _), hit in zip(slabs, seen):
                slab = open_slab(uri)
                fresh = (_relu(x, slab, bias) > limit).any(axis=0) & ~hit
                hit |= fresh
                yield pa.RecordBatch.from_arrays([pa.array(slab.ids[fresh].astype("int32"))], schema=arrow)

    return spread(vectors.select(vec)).mapInArrow(run, out).distinct()


def forward(vectors, model, vec="vec"):
    """Each vector with its active units (array of structs) and its reconstruction."""
    out = T.StructType(vectors.schema.fields + [
        T.StructField("features", _ENTRIES),
        T.StructField("reconstruction", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)
    slabs, bias = model.slabs(), model.bias()

    # as many rows as one slab and the active units of all slabs leave room for: each slab is read once for all of them
    step = max(1, min(CELLS_AT_ONCE // max(_widest(slabs, len(bias)), 1), CELLS_FORWARD // max(_all_units(slabs, len(bias)), 1)))

    def run(batches):
        for batch in _slices(batches, 1, step):
            x = matrix(batch.column(batch.schema.get_field_index(vec)), len(bias))
            found, total = [], np.tile(bias, (len(x), 1))
            for uri, _ in slabs:
                slab = open_slab(uri)
                f = _relu(x, slab, bias)
                total += f @ slab.w_dec
                hit = f > 0
                found.append((hit.sum(axis=1), np.broadcast_to(slab.ids.astype("int32"), f.shape)[hit], f[hit]))
            columns = [*batch.columns, _side_by_side(len(x), found), _lists(total)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return spread(vectors).mapInArrow(run, out)


def _side_by_side(n, found):
    """Arrow lists of (feature_id, activation_value) for n rows out of (entries of each row, units, values) of each slab."""
    counts = np.array([c for c, _, _ in found], dtype="int64").reshape(len(found), n)
    ends = np.cumsum(counts.sum(axis=0))
    units, values = np.empty(ends[-1] if n else 0, "int32"), np.empty(ends[-1] if n else 0)
    at = ends - counts.sum(axis=0)
    for c, u, v in found:
        lo = 0
        for row, some in enumerate(c):
            units[at[row]:at[row] + some], values[at[row]:at[row] + some] = u[lo:lo + some], v[lo:lo + some]
            lo += some
        at += c
    entries = pa.StructArray.from_arrays([pa.array(units), pa.array(values)], names=["feature_id", "activation_value"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("int32")), entries)


_ENTRIES = T.ArrayType(T.StructType([T.StructField("feature_id", T.IntegerType()),
                                     T.StructField("activation_value", T.DoubleType())]))


def _lists(matrix):
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * d),
                                    pa.array(np.ascontiguousarray(matrix).ravel()))


def _add_units(total, rows, units, values, slab):
    """Add each entry's decoder row to its row of ``total``; rows ascend, units the slab lacks add nothing."""
    at = np.minimum(np.searchsorted(slab.ids, units), len(slab.ids) - 1)
    known = np.flatnonzero(slab.ids[at] == units)
    step = max(1, CELLS_HELD // max(total.shape[1], 1))
    for lo in range(0, len(known), step):
        some = known[lo:lo + step]
        row = rows[some]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[first]] += np.add.reduceat(slab.w_dec[at[some]] * values[some, None], first, axis=0)


def decode(activations, samples, model, sample="sample_id"):
    """``f . W_dec + b_dec`` per sample; a sample without active units gives ``b_dec``.

    Units the weights don't have add nothing, repeated rows of a unit add up. A sample's entries
    meet in one row; the weights are not moved.
    """
    entries = activations.groupBy(sample).agg(F.collect_list(
        F.struct(F.col("feature_id").cast("int").alias("feature_id"),
                 F.col("activation_value").cast("double").alias("activation_value"))).alias("features"))
    rows = samples.select(sample).join(entries, sample, "left") \
        .withColumn("features", F.coalesce("features", F.array().cast(_ENTRIES)))
    out = T.StructType([rows.schema[sample],
                        T.StructField("reconstruction", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)
    slabs, bias = model.slabs(), model.bias()

    def run(batches):
        for batch in _slices(batches, len(bias)):
            column = batch.column(1)
            entry = column.flatten()
            at = np.repeat(np.arange(len(column)),
                           column.value_lengths().to_numpy(zero_copy_only=False))
            units, values = (entry.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            total = np.tile(bias, (len(column), 1))
            for uri, _ in slabs:
                _add_units(total, at, units, values, open_slab(uri))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(total).cast(arrow.types[1])], schema=arrow)

    return rows.mapInArrow(run, out)


def vectors_for_tokens(tokens, table, token="token_id", vec="vec"):
    """The vector of each token by its id; tokens without one are dropped."""
    return lookup_join(tokens, table.select(token, vec), token)


# ---- weights as a table -------------------------------------------------------------

def row_norms(weights, column="w_dec"):
    return weights.select("feature_id", V.norm(F.col(column)).alias("norm"))


def norm_range(weights, column="w_dec"):
    return row_norms(weights, column).agg(F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"))


def normalise_rows(weights, column="w_dec"):
    return weights.withColumn(column, V.normalised(F.col(column)))


# ---- losses -------------------------------------------------------------------------

def model_errors(vectors, model, vec="vec"):
    """``sample_errors`` in one pass over the vectors: only three numbers leave each batch row."""
    keep = [f for f in vectors.schema.fields if f.name != vec]
    names = [f.name for f in keep]
    out = T.StructType(keep + [T.StructField("squared_error", T.DoubleType()),
                               T.StructField("l1", T.DoubleType()), T.StructField("dim", T.IntegerType())])
    arrow = to_arrow_schema(out)
    slabs, bias = model.slabs(), model.bias()

    def run(batches):
        for batch in _slices(batches, _widest(slabs, len(bias))):
            x = matrix(batch.column(batch.schema.get_field_index(vec)), len(bias))
            error, l1 = bias - x, np.zeros(len(x))
            for uri, _ in slabs:
                slab = open_slab(uri)
                f = _relu(x, slab, bias)
                error += f @ slab.w_dec
                l1 += f.sum(axis=1)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns = [*kept, pa.array((error * error).sum(axis=1)), pa.array(l1),
                       pa.array(np.full(len(x), x.shape[1]))]
            yield pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return spread(vectors).mapInArrow(run, out)


def sample_errors(forwarded, vec="vec"):
    """Squared reconstruction error, absolute activation sum and vector length per sample."""
    absolute = F.aggregate("features", F.lit(0.0), lambda s, e: s + F.abs(e["activation_value"]))
    return forwarded.select(
        *[c for c in forwarded.columns if c not in (vec, "features", "reconstruction")],
        V.squared_distance(F.col(vec), F.col("reconstruction")).alias("squared_error"),
        absolute.alias("l1"), F.size(vec).alias("dim"))


def _mean_squared():
    return F.sum("squared_error") / F.sum("dim")


def _mean_absolute(lam, num_features, l1):
    if l1 not in ("mean", "sum"):
        raise ValueError("l1 must be 'mean' or 'sum'")
    per = F.count("*") * F.lit(num_features if l1 == "mean" else 1)
    return F.lit(float(lam)) * F.sum("l1") / per


def reconstruction_loss(errors, by=("batch",)):
    """Mean squared error over all numbers of a batch."""
    return errors.groupBy(*by).agg(_mean_squared().alias("reconstruction_loss"))


def sparsity_loss(errors, lam, num_features, by=("batch",), l1="mean"):
    """lambda times the mean absolute activation over batch x units (zeros count).

    ``l1="sum"`` sums over units and averages over samples only.
    """
    return errors.groupBy(*by).agg(_mean_absolute(lam, num_features, l1).alias("sparsity_loss"))


def batch_losses(errors, lam, num_features, by=("batch",), l1="mean", loss=None):
    """Total loss per batch, in one pass over the errors. ``loss`` replaces the sum of both
    parts by any aggregate of the error columns."""
    if loss is not None:
        return errors.groupBy(*by).agg(loss.alias("loss"))
    return errors.groupBy(*by).agg(
        _mean_squared().alias("reconstruction_loss"),
        _mean_absolute(lam, num_features, l1).alias("sparsity_loss")).withColumn(
        "loss", F.col("reconstruction_loss") + F.col("sparsity_loss"))


def evaluation(errors, lam, num_features, split="split", batch="batch"):
    """Loss of each batch of each split, with the number of batches of the split.

    Counting the loss column keeps both uses of the per-batch result identical, so the
    shuffle below them (and the model pass) runs once.
    """
    losses = batch_losses(errors, lam, num_features, (split, batch)).select(split, batch, "loss")
    counts = losses.groupBy(split).agg(F.count("loss").alias("num_batches"))
    return losses.join(counts, split)


def fire_counts(active, batch="batch"):
    """Per unit, the number of batches in which any sample has a positive value."""
    return active.where(F.col("activation_value") > 0).groupBy("feature_id").agg(
        F.count_distinct(batch).alias("fire_count"))
