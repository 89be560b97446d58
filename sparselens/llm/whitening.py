"""Whitening of embeddings by Jacobi-Davidson, without ever forming the covariance.

Entries become integers x = floor(256 * c). The fit list is every distinct x-vector once, packed as
bytes in the shared folder. One pass gives its size n, the exact sums S and the exact trace; after
that the covariance V is only met as products V B = 1/n sum (x - S/n) (x - S/n)' B, one distributed
pass for all columns of B. A pass leaves one short block a task and is summed with ``fsum``.

The driver keeps vectors of the embedding's dimension only. Each round takes Ritz pairs of the
search space, locks those whose residual has reached double precision, and widens the space by the
solutions of the projected correction equations (I - QQ')(V - theta I)(I - QQ') t = -r, Q holding the
locked and the current vectors. They are solved by MINRES for all open pairs side by side, so a step
of MINRES is one pass whatever the number of pairs.

Odd rows: a null vector, or one that holds a null, a NaN, an infinity or an entry beyond the longs,
is left out; so is a vector whose length is not the commonest one (the longer of equally common
ones) and an empty one. Repeated rows and null ids are kept, each with its rows. Components of zero
variance do not exist: constant or fewer than five vectors have fewer than four components, and one
distinct vector has no row. Ties of eigenvalues: any basis of their space. ``deviation`` is null where
it does not fit into a long. An empty table gives no row. Other columns are ignored unless asked for.
"""

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import staged

SCALE = 256
#: Wanted components, further vectors of the search space, and the space's largest width.
WANTED, GUARD, WIDEST = 4, 2, 40
#: Steps of MINRES a round, and rounds before the search is given up with an error.
INNER, ROUNDS = 3, 200
#: A residual is at double precision below so many units in the last place of the largest eigenvalue.
ULPS = 64
WIDTHS = {2: "<i2", 4: "<i4", 8: "<i8"}
SUMMED = "sums binary, size long"
WHITE = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def pack(vectors):
    """Rows of integers as bytes each: a length of 4 bytes, a width, then the entries at the least width that holds them all."""
    top = np.maximum(vectors.max(axis=1), -1 - vectors.min(axis=1))
    out = np.empty(len(vectors), object)
    for width, most in ((2, 1 << 15), (4, 1 << 31), (8, None)):
        here = (top >= {2: -1, 4: 1 << 15, 8: 1 << 31}[width]) & (top < most if most else True)
        if here.any():
            block = vectors[here].astype(WIDTHS[width])
            step, raw = block.shape[1] * width, block.tobytes()
            out[here] = [raw[k * step:(k + 1) * step] for k in range(len(block))]
    return out.tolist()


def unpack(column, dim):
    """The int64 matrix of packed rows of one dimension."""
    if not len(column):
        return np.zeros((0, dim), np.int64)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset))
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]
    raw, first = raw[start:start + sizes.sum()], np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty((len(column), dim), np.int64)
    for width, kind in WIDTHS.items():
        here = np.flatnonzero(sizes == dim * width)
        if len(here) == len(column):
            return raw.view(kind).reshape(-1, dim).astype(np.int64)
        for k in here:
            out[k] = raw[first[k]:first[k + 1]].view(kind)
    return out


def integers(column):
    """Of an Arrow list array: which rows are usable, their lengths, and the longs of usable rows in a row."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    usable = (sizes > 0) & ~column.is_null().to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
        bad = ~np.isfinite(values) | (scaled >= 2.0 ** 63) | (scaled < -2.0 ** 63)
    row = np.repeat(np.arange(len(sizes)), sizes)
    usable[row[bad]] = False
    longs = np.where(bad, 0, scaled).astype(np.int64)
    return usable, sizes, longs, np.concatenate([[0], np.cumsum(sizes)])


def rows_of_length(usable, sizes, longs, first, dim):
    """The matrix of usable rows of ``dim`` entries, and their places."""
    here = np.flatnonzero(usable & (sizes == dim))
    return longs[first[here][:, None] + np.arange(dim)], here


def packed(embeddings, vector):
    """(dim, x): usable vectors as packed integers."""
    def run(batches):
        for batch in batches:
            usable, sizes, longs, first = integers(batch.column(0))
            for dim in np.unique(sizes[usable]):
                matrix, _ = rows_of_length(usable, sizes, longs, first, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), dim, np.int32)), pa.array(pack(matrix), pa.binary())],
                                                 ["dim", "x"])

    return embeddings.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "dim int, x binary")


class FitList:
    """The distinct vectors: ``n``, ``sums`` (exact), ``mean``, ``trace``, and products with the covariance."""

    def __init__(self, embeddings, vector="embedding"):
        distinct = staged(packed(embeddings, vector).groupBy("dim", "x").agg(F.count("*").alias("copies")), "vectors")
        counts = distinct.groupBy("dim").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
        self.dim = counts["dim"] if counts else 0
        self.passes, self.n, self.rows = 0, 0, distinct.where(F.col("dim") == self.dim).select("x")
        # as many tasks as twice the cores: each leaves one block, so what meets in the driver does not grow with the data
        self.rows = self.rows.coalesce(max(1, 2 * embeddings.sparkSession.sparkContext.defaultParallelism))
        if not self.dim:
            return
        first = self.collected(lambda x: [x.shape[0], *sum_longs(x)])
        self.n, *self.sums = [sum(column) for column in zip(*first)]
        self.mean = np.array([s / self.n for s in self.sums])
        mean = self.mean
        squares = self.collected(lambda x: np.square(x - mean).sum(axis=0).tolist())
        self.trace = math.fsum(v for row in squares for v in row) / self.n

    def collected(self, numbers):
        """``numbers(matrix)`` of every batch, added up over each task: a list of numbers a task."""
        dim = self.dim

        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    here = numbers(unpack(batch.column(0), dim))
                    total = here if total is None else [a + b for a, b in zip(total, here)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary()), pa.array([1], pa.int64())], ["sums", "size"])

        self.passes += 1
        return [pickle.loads(r["sums"]) for r in self.rows.mapInArrow(run, SUMMED).collect()]

    def product(self, block):
        """V @ block for a matrix of dim x k, in one pass."""
        mean, shape = self.mean, block.shape

        def numbers(x):
            centred = x - mean
            return (centred.T @ (centred @ block)).ravel().tolist()

        parts = self.collected(numbers)
        return np.array([math.fsum(v) for v in zip(*parts)]).reshape(shape) / self.n

    def white_moments(self, directions):
        """Covariance over the fit list of centred vectors projected on ``directions``."""
        mean, k = self.mean, directions.shape[1]
        means = np.array([math.fsum(v) for v in zip(*self.collected(lambda x: ((x - mean) @ directions).sum(axis=0).tolist()))]) / self.n

        def numbers(x):
            y = (x - mean) @ directions - means
            return (y.T @ y).ravel().tolist()

        return np.array([math.fsum(v) for v in zip(*self.collected(numbers))]).reshape(k, k) / self.n


def sum_longs(x):
    """Exact column sums: the upper and lower halves of the longs are added apart."""
    high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
    return [(h << 32) + v for h, v in zip(high, low)]


def orthonormal(new, *against):
    """Columns of ``new`` made orthonormal to each other and to the given blocks; dependent ones go."""
    basis = np.hstack([b for b in against if b.size] or [np.zeros((new.shape[0], 0))])
    kept = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            basis = np.hstack([basis, v[:, None]])
            kept.append(v)
    return np.array(kept).T.reshape(new.shape[0], len(kept))


def minres(product, shifts, projector, right, steps):
    """MINRES for the projected systems P (V - shift I) P t = right, a column each, side by side.

    One call of ``product`` a step serves all columns. Columns that are solved stand still.
    """
    b = projector(right)
    k = b.shape[1]
    beta = np.linalg.norm(b, axis=0)
    start, v, older = beta.copy(), np.divide(b, beta, out=np.zeros_like(b), where=beta > 0), np.zeros_like(b)
    t, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, c, c_old, s, s_old = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    beta = np.zeros(k)
    for _ in range(steps):
        going = np.abs(eta) > 1e-6 * start
        if not going.any():
            break
        p = projector(product(v) - v * shifts)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * older
        following = np.linalg.norm(p, axis=0)
        delta, rho2 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta
        rho3, rho1 = s_old * beta, np.hypot(delta, following)
        live = going & (rho1 > 0)
        c_new, s_new = np.divide(delta, rho1, out=np.ones(k), where=live), np.divide(following, rho1, out=np.zeros(k), where=live)
        step = np.divide(v - rho3 * w_old - rho2 * w, rho1, out=np.zeros_like(v), where=live)
        t = t + c_new * eta * step
        w_old, w = w, step
        eta = np.where(live, -s_new * eta, 0)
        older, v = v, np.divide(p, following, out=np.zeros_like(p), where=following > 1e-300)
        beta, c_old, c, s_old, s = following, c, c_new, s, s_new
    return t


def jacobi_davidson(product, dim, wanted=WANTED, seed=11):
    """The ``wanted`` largest eigenpairs (values falling, vectors as columns) of a symmetric operator."""
    wanted = min(wanted, dim)
    width = min(dim, wanted + GUARD)
    space = orthonormal(np.random.default_rng(seed).standard_normal((dim, width)))
    image = product(space)
    locked, values, top = np.zeros((dim, 0)), [], 0.0
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max([top, *np.abs(theta[:1]), *values])
        ritz, images = space @ s, image @ s
        residual = images - ritz * theta
        residual -= locked @ (locked.T @ residual)
        done = np.linalg.norm(residual, axis=0) <= ULPS * np.finfo(float).eps * top
        ready = int(np.argmin(np.append(done, False)))  # lock from the top only, so that order holds
        ready = min(ready, wanted - len(values))
        if ready:
            locked, values = np.hstack([locked, ritz[:, :ready]]), values + theta[:ready].tolist()
            if len(values) == wanted or locked.shape[1] == dim:
                break
        ritz, images, theta, residual = ritz[:, ready:], images[:, ready:], theta[ready:], residual[:, ready:]
        open_ = min(wanted - len(values), ritz.shape[1])
        if ritz.shape[1] + open_ > WIDEST:  # start anew from the best Ritz vectors
            ritz, images = ritz[:, :open_ + GUARD + 4], images[:, :open_ + GUARD + 4]
        space, image = ritz, images
        current, shifts = ritz[:, :open_], theta[:open_]
        hidden = np.hstack([locked, current])

        def projector(y, hidden=hidden):
            y = y - hidden @ (hidden.T @ y)
            return y - hidden @ (hidden.T @ y)

        t = minres(product, shifts, projector, -residual[:, :open_], INNER)
        new = orthonormal(t, locked, space)
        if not new.shape[1]:  # the space is whole, or rounding is all that is left
            new = orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((dim, open_)), locked, space)
            if not new.shape[1]:
                locked, values = np.hstack([locked, current]), values + shifts.tolist()
                break
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} components reached double precision in {ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


class Whitening:
    """A fit: ``n``, ``sums``, ``mean``, ``trace``, ``values`` and ``vectors`` of positive components."""

    def __init__(self, embeddings, vector="embedding", wanted=WANTED):
        fit = FitList(embeddings, vector)
        self.n, self.dim = fit.n, fit.dim
        self.sums, self.mean, self.trace = ([], None, 0.0) if not fit.n else (fit.sums, fit.mean, fit.trace)
        self.values, self.vectors, self.identity_error = np.zeros(0), np.zeros((fit.dim, 0)), 0.0
        if self.trace > 0:
            values, vectors = jacobi_davidson(fit.product, fit.dim, wanted)
            real = values > fit.dim * np.finfo(float).eps * self.trace
            self.values, self.vectors = values[real], vectors[:, real]
            white = fit.white_moments(self.vectors / np.sqrt(self.values))
            self.identity_error = float(np.abs(white - np.eye(len(white))).max())
        self.passes = fit.passes

    def deviations(self, x):
        """Exact sums of (n x - S)^2, None beyond a long."""
        limit = max(map(abs, self.sums), default=0) + self.n * max(int(np.abs(x).max()) if x.size else 0, 0)
        if limit * limit * self.dim < 1 << 63:
            return np.square(self.n * x - np.array(self.sums, np.int64)).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [d if d < 1 << 63 else None for d in exact]


def whiten(embeddings, key="vec_id", vector="embedding", wanted=WANTED):
    """One row a remaining row and component: key, component from 1, n, deviation (sum of (n x - S)^2),
    whitened (x - S/n on the unit eigenvector, over the root of its eigenvalue), explained (eigenvalue
    over the trace) and identity_error (largest entry of the whitened covariance minus the identity)."""
    fit = Whitening(embeddings, vector, wanted)
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    directions, k = fit.vectors / np.sqrt(fit.values), len(fit.values)
    explained = (fit.values / fit.trace).tolist() if k else []

    def run(batches):
        for batch in batches:
            usable, sizes, longs, first = integers(batch.column(1))
            if not k:
                continue
            x, here = rows_of_length(usable, sizes, longs, first, fit.dim)
            m = len(here)
            deviation = pa.array(fit.deviations(x), pa.int64())
            repeat = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(here)).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fit.n, np.int64)), deviation.take(repeat), pa.array(((x - fit.mean) @ directions).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, fit.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, {WHITE}")
