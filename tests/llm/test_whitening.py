import math
import random

import numpy as np
import pytest

from sparselens.llm import whitening

SHAPE = "vec_id long, embedding array<float>, label int, x string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 0, "x", "v") for i, v in rows], SHAPE).repartition(3)


def plain(rows, wanted=4):
    """Whitening through the dense covariance: {key: [(deviation, values up to sign)]} and the shared figures."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v)
              and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in usable}), float)
    n, total = len(fit), [sum(int(v) for v in column) for column in fit.T.tolist()]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    rows = [(i, sum((n * a - s) ** 2 for a, s in zip(v, total)), (np.array(v, float) - fit.mean(axis=0)) @ vectors / np.sqrt(values))
            for i, v in usable]
    return n, rows, values / np.trace(centred.T @ centred / n)


def compare(df, rows, tolerance=1e-9):
    n, want, explained = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.zeros(len(explained))
    for key, deviation, values in want:
        for k, v in enumerate(values):
            found = got[key, deviation][k + 1]
            sign[k] = sign[k] or (np.sign(v * found[0]) if abs(v) > 1e-3 else 0)
            assert min(abs(f - (sign[k] or 1) * v) for f in found) < tolerance
    assert sum(len(f) for c in got.values() for f in c.values()) == len(want) * len(explained)


def test_the_table_against_the_dense_covariance(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    compare(whitening.whiten(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_copies_count_once_in_the_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    rows += [(100 + k, rows[0][1]) for k in range(60)] + [(rows[1][0], rows[1][1])]
    compare(whitening.whiten(frame(spark, rows)), rows)


def test_odd_rows(spark):
    """Unusable vectors are left out, repeated and null ids kept; wide entries are exact."""
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=5) * 10 ** (k % 5)).astype(np.float32).tolist()) for k in range(30)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [math.nan] * 5), (53, [math.inf, 1, 2, 3, 4]), (54, [])]
    more = [(None, rows[3][1]), (3, rows[3][1]), (60, [-0.0] * 5), (61, [0.0] * 5), (62, [-1e-30, 0, 0, 0, 0])]
    compare(whitening.whiten(frame(spark, rows + bad + more)), rows + more, 1e-8)
    other = [(70, [1.0, 2.0]), (71, [3e38] * 5)]  # another length, entries beyond the longs
    assert whitening.whiten(frame(spark, rows + other)).where("vec_id >= 70").isEmpty()


def test_fewer_components_than_wanted(spark):
    assert whitening.whiten(frame(spark, []).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    flat = [(k, [float(k % 3), float(k % 5)]) for k in range(15)]
    assert {r["component"] for r in whitening.whiten(frame(spark, flat)).collect()} == {1, 2}


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [1e12 * (k + 1), 1.0 * k]) for k in range(4)]
    assert {r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()} == {None}


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [5, 5, 5, 1, 1, 1, 1, 1], [7], [3, 2], [9, 9 - 1e-7, 9 - 2e-7, 1, 1, 0, 0],
                                    [1e-3] * 30 + [1e6], list(np.linspace(1, 1.1, 90))])
def test_search_for_eigenpairs(values):
    rng = np.random.default_rng(len(values))
    basis, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = basis @ np.diag(values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.jacobi_davidson(lambda b: matrix @ b, len(values))
    k = min(4, len(values))
    assert np.allclose(found, sorted(values)[::-1][:k], rtol=0, atol=1e-13 * max(values))
    assert np.abs(matrix @ vectors - vectors * found).max() < 3e-13 * max(values) and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_minres_solves_columns_side_by_side():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 20))
    a = a @ a.T + np.eye(20)
    right, shifts = rng.normal(size=(20, 3)), np.array([0.0, 0.5, -2.0])
    got = whitening.minres(lambda b: a @ b, shifts, lambda b: b, right, 40)
    for k in range(3):
        assert np.abs((a - shifts[k] * np.eye(20)) @ got[:, k] - right[:, k]).max() < 1e-4 * np.abs(right).max()


def test_packed_vectors_and_exact_sums():
    rng = random.Random(4)
    for width in (10, 20, 40, 62):
        x = np.array([[rng.randrange(-1 << (width + 1), 1 << (width + 1)) if rng.random() < 0.3 else rng.randrange(-9, 9) for _ in range(7)]
                      for _ in range(50)], np.int64)
        import pyarrow as pa
        column = pa.array(whitening.pack(x), pa.binary())
        assert (whitening.unpack(column, 7) == x).all() and (whitening.unpack(column.slice(11, 20), 7) == x[11:31]).all()
        assert whitening.sum_longs(x) == [sum(c) for c in zip(*x.tolist())]
    edge = np.array([[-1 << 15, 0], [1 << 15, 0], [-1 << 31, 1], [1 << 31, 1], [-1 << 63, (1 << 63) - 1]], np.int64)
    assert [len(p) // 2 for p in whitening.pack(edge)] == [2, 4, 4, 8, 8]
