"""The bounded similarity join, pinning and clusters against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselens.operators import autoencoder as ae
from sparselens.operators import diagnostics as dg
from sparselens.operators import relations as rel
from sparselens.plans import similarity
from sparselens.plans.components import connected


def cells(spark, m, first=0):
    return spark.createDataFrame([(int(i), int(j) + first, float(m[i, j])) for i, j in zip(*np.nonzero(m))], "t long, f int, x double").repartition(3)


def sparse(seed, rows=60, features=23, share=0.3):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((rows, features)) < share, rng.normal(size=(rows, features)), 0)


def cosines(a, b):
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a.T @ b) / np.sqrt(np.outer((a * a).sum(axis=0), (b * b).sum(axis=0)))


SIZES = [(4, 7), (5, 1000), (512, 4096)]


@pytest.mark.parametrize("block,width", SIZES)
@pytest.mark.parametrize("cut", [-0.3, 0.0, 0.25])
def test_pairs_above_a_cut(spark, block, width, cut):
    m = sparse(1)
    c, met = cosines(m, m), ((m != 0).T.astype(int) @ (m != 0)) > 0
    got = {(r.left_id, r.right_id): r.score for r in similarity.similar_features(cells(spark, m), "t", "f", "x", cut=cut, block=block, row_width=width).collect()}
    want = {(i, j) for i in range(23) for j in range(i + 1, 23) if met[i, j] and c[i, j] >= cut}
    assert set(got) == want and all(v == pytest.approx(c[k]) for k, v in got.items())


@pytest.mark.parametrize("block,width", SIZES)
@pytest.mark.parametrize("top,cut", [(1, None), (3, None), (4, 0.1)])
def test_best_partners(spark, block, width, top, cut):
    m = sparse(2)
    c = np.where(((m != 0).T.astype(int) @ (m != 0)) > 0, cosines(m, m), -9)
    np.fill_diagonal(c, -9)
    got = {}
    for r in similarity.similar_features(cells(spark, m), "t", "f", "x", top=top, cut=cut, block=block, row_width=width).collect():
        got.setdefault(r.left_id, {})[r["rank"]] = r.right_id
    for i in range(23):
        want = [j for j in np.argsort(-c[i], kind="stable")[:top] if c[i, j] > -9 and (cut is None or c[i, j] >= cut)]
        assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(i, {})) == len(want)


@pytest.mark.parametrize("same", [True, False])
def test_a_task_of_an_answer_has_few_right_blocks(spark, same):
    """Right ids repeat in a task and equal scores lie side by side: the answer is written in fewer bytes."""
    m = (sparse(8, rows=40, features=64, share=0.6) != 0).astype(float)
    right = None if same else cells(spark, m, 128)
    found = similarity.similar_features(cells(spark, m), "t", "f", "x", right=right, cut=1.0, cosine=False, block=4)
    tasks = {}
    for r in found.withColumn("task", F.spark_partition_id()).collect():  # in the order of their task
        tasks.setdefault(r.task, []).append(r)
    n = m.T @ m
    want = {(i, j if same else j + 128) for i in range(64) for j in range(64) if n[i, j] and (i < j or not same)}
    rows = [(r.left_id, r.right_id) for of in tasks.values() for r in of]
    assert len(rows) == len(want) and set(rows) == want
    assert len(tasks) > 4 and max(len({r.right_id // 4 for r in of}) for of in tasks.values()) <= 2
    for of in tasks.values():
        for a, b in zip(of, of[1:]):
            if (a.left_id, a.right_id // 4) == (b.left_id, b.right_id // 4):
                assert a.score >= b.score


@pytest.mark.parametrize("block,width", SIZES)
def test_two_matrices_and_dot_products(spark, block, width):
    a, b = sparse(3, features=9), sparse(4, features=17)
    args = dict(right=cells(spark, b, 100), cosine=False, block=block, row_width=width)
    got = {(r.left_id, r.right_id - 100): r.score for r in similarity.similar_features(cells(spark, a), "t", "f", "x", cut=1.0, **args).collect()}
    dots = a.T @ b
    assert got == {(i, j): pytest.approx(dots[i, j]) for i in range(9) for j in range(17) if dots[i, j] >= 1.0}
    best = similarity.similar_features(cells(spark, a), "t", "f", "x", top=2, **args).collect()
    assert {(r.left_id, r.right_id - 100) for r in best if r["rank"] == 1} == {(i, int(dots[i].argmax())) for i in range(9)}


def test_bounds_skip_blocks_and_rows_stay_few(spark):
    """Groups of features that share no rows with other groups: their block pairs are never computed."""
    rng = np.random.default_rng(5)
    m = np.zeros((400, 40))
    for g in range(10):
        m[40 * g:40 * g + 40, 4 * g:4 * g + 4] = rng.random((40, 4)) + 0.1
    m[3, :] = 0.001  # one row that all share
    df = similarity._cells(cells(spark, m), "t", "f", "x", 4, 40)
    pairs = {(r.lb, r.rb) for r in similarity.block_pairs(df, df, 0.5, True, True).collect()}
    assert pairs == {(g, g) for g in range(10)}
    assert similarity.block_pairs(df, df, None, True, True).count() == 55
    found = similarity.similar_features(cells(spark, m), "t", "f", "x", cut=0.5, block=4, row_width=40)
    c = cosines(m, m)
    assert found.count() == sum(c[i, j] >= 0.5 for i in range(40) for j in range(i + 1, 40))


def test_rows_that_leave_the_tasks_are_bounded(spark, monkeypatch):
    """With ``top`` a task emits at most that many rows a feature and block pair, not the square."""
    m = np.random.default_rng(6).random((50, 64)) + 0.1  # every pair shares rows
    emitted = []
    seen = similarity.top_k
    monkeypatch.setattr(similarity, "top_k", lambda df, *a, **k: (emitted.append(df.count()), seen(df, *a, **k))[1])
    got = similarity.similar_features(cells(spark, m), "t", "f", "x", top=2, block=16)
    assert got.count() == 128 and emitted[0] <= 2 * 64 * 4 < 64 * 63
    with pytest.raises(ValueError, match="cut"):
        similarity.similar_features(cells(spark, m), "t", "f", "x")


def test_odd_features(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (0, 3, float("nan")), (0, 4, 2.0), (-9, 4, 1.0), (-9, -7, 3.0), (5, 9, 1.0)], "t long, f int, x double")
    got = similarity.similar_features(df, "t", "f", "x", cut=0.1, block=3, row_width=4).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(2, 4), (-7, 4)}
    assert similarity.similar_features(df.where("false"), "t", "f", "x", top=2).count() == 0


def test_co_occurrences_leave_the_probe_out(spark):
    act = spark.createDataFrame([(f, t, 1.0 + (f + t) % 3, 0) for f in range(12) for t in range(20) if (f * t + f) % 4], "feature_id int, token_id int, activation_value double, chunk_id int")
    whole = {(r.source_feature_id, r.feature_id): r.co_occurrence_count for r in rel.co_occurrence_counts(act).collect()}
    for top in (1, 4, 50):
        got = {}
        for r in rel.strongest_co_occurrences(act, top=top).collect():
            got.setdefault(r.source_feature_id, []).append((r["rank"], r.feature_id, r.co_occurrence_count))
        for p in got:
            want = sorted(((-n, f) for (s, f), n in whole.items() if s == p))[:top]
            assert [(f, n) for _, f, n in sorted(got[p])] == [(f, -n) for n, f in want]
    cut = rel.strongest_co_occurrences(act, cut=9).collect()
    assert {(r.source_feature_id, r.feature_id): r.co_occurrence_count for r in cut} == {k: n for k, n in whole.items() if n >= 9}


# ---- groups -----------------------------------------------------------------------------

def groups(spark, links, nodes):
    got = connected(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    return {r.node: r.group_id for r in got.collect()}


def test_chains_hubs_and_lone_nodes(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    hub = [(7, k) for k in range(200, 260)]
    odd = [(5, 5), (3, 4), (4, 3), (3, 4), (None, 4), (-2, 300), (300, 301)]
    got = groups(spark, chain + hub + odd, [1, 1, 5, 7, 400, None])
    want = {k: 100 for k in range(100, 141)} | {k: 7 for k in range(200, 260)} | {7: 7, 5: 5, 3: 3, 4: 3, -2: -2, 300: -2, 301: -2, 1: 1, 400: 400}
    assert got == want
    assert groups(spark, [], [2]) == {2: 2} and groups(spark, [], []) == {}


def test_random_groups(spark):
    rng = np.random.default_rng(8)
    links = [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(80)]
    label = list(range(120))
    for _ in range(120):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert groups(spark, links, range(120)) == dict(enumerate(label))


def test_clusters_of_features(spark):
    rows = [(f, t, 1.0) for f, tokens in ((1, (1, 2)), (2, (1, 2)), (9, (2, 1)), (3, (5, 6)), (4, (6, 5)), (8, (7,))) for t in tokens]
    act = spark.createDataFrame(rows, "feature_id int, token_id int, activation_value double")
    got = {r.feature_id: (r.cluster_id, r.num_features) for r in dg.feature_clusters(act, 0.9).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 9: (1, 3), 3: (3, 2), 4: (3, 2), 8: (8, 1)}


# ---- pinning ----------------------------------------------------------------------------

@pytest.fixture
def coder(spark):
    rng = np.random.default_rng(0)
    enc, dec, bias = rng.normal(size=(10, 5)), rng.normal(size=(10, 5)), rng.normal(size=10) / 4
    dec[6] = 0
    rows = [(3 * k, e.tolist(), d.tolist(), float(b)) for k, (e, d, b) in enumerate(zip(enc, dec, bias))]
    weights = spark.createDataFrame(rows, "feature_id int, w_enc array<double>, w_dec array<double>, b_enc double")
    model = ae.Autoencoder(weights, spark.createDataFrame([([0.2] * 5,)], "b_dec array<double>"), slab_cells=15)
    x = rng.normal(size=(12, 5))
    samples = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "sample_id long, vec array<double>")
    return model, samples, dec


def test_pinning_equals_two_full_decodes(spark, coder):
    model, samples, dec = coder
    active = ae.encode(samples, model, 0.3).where("sample_id <> 4")  # one sample without any unit
    pins = spark.createDataFrame([(0, 2.0), (12, 0.0), (18, 1.0)], "feature_id int, value double")
    clamped = active.join(pins, "feature_id", "left_anti").select("sample_id", "feature_id", "activation_value").unionByName(
        samples.select("sample_id").crossJoin(pins).select("sample_id", "feature_id", F.col("value").alias("activation_value")))
    full = {r.sample_id: np.array(r.reconstruction) for r in ae.decode(clamped, samples, model).collect()}
    before = ae.decode(active, samples, model)
    plain = {r.sample_id: np.array(r.reconstruction) for r in before.collect()}
    got = {r.sample_id: r.reconstruction for r in dg.pinned_reconstruction(before, active, pins, model).collect()}
    assert set(got) == set(range(12)) and all(np.allclose(got[k], full[k]) for k in got)
    for r in dg.pinned_shift(active, samples, pins, model).collect():
        moved, row = full[r.sample_id] - plain[r.sample_id], dec[r.feature_id // 3]
        size = np.linalg.norm(row)
        assert r.shift == pytest.approx(np.linalg.norm(moved))
        if size:
            assert r.projection == pytest.approx(moved @ row / size) and r.cosine == pytest.approx(moved @ row / size / np.linalg.norm(moved))
        else:
            assert r.cosine is None


def test_one_pin_moves_along_its_own_row(spark, coder):
    model, samples, dec = coder
    active = ae.encode(samples, model, 0.3)
    now = {r.sample_id: r.activation_value for r in active.where("feature_id = 9").collect()}
    for r in dg.pinned_shift(active, samples, spark.createDataFrame([(9, 1.5)], "feature_id int, value double"), model).collect():
        change = 1.5 - now.get(r.sample_id, 0.0)
        assert r.change == pytest.approx(change) and abs(r.cosine) == pytest.approx(1.0)
        assert r.projection == pytest.approx(change * np.linalg.norm(dec[3]))


def test_pins_are_checked(spark, coder):
    model, samples, _ = coder
    active = ae.encode(samples, model, 0.3)
    for rows, what in (([(1, 1.0)], "no such unit"), ([(0, 1.0), (0, 2.0)], "one value each"), ([(0, None)], "one value each")):
        with pytest.raises(ValueError, match=what):
            dg.pinned_shift(active, samples, spark.createDataFrame(rows, "feature_id int, value double"), model)
    assert dg.pinned_shift(active, samples, spark.createDataFrame([], "feature_id int, value double"), model).count() == 0


def test_pins_of_any_number_in_slabs(spark, coder, monkeypatch):
    """More than 4,096 pins were refused; a task holds one slab of them at a time."""
    model, samples, dec = coder
    active = ae.encode(samples, model, 0.3)
    pins = spark.createDataFrame([(3 * k, k / 4) for k in range(10)], "feature_id int, value double")
    whole = {(r.sample_id, r.feature_id): r for r in dg.pinned_shift(active, samples, pins, model).collect()}
    monkeypatch.setattr(dg, "_PIN_CELLS", 10)  # two units a slab
    cut = {(r.sample_id, r.feature_id): r for r in dg.pinned_shift(active, samples, pins, model).collect()}
    assert len(cut) == 120 and set(cut) == set(whole)
    for k, r in cut.items():
        assert all(r[c] == pytest.approx(whole[k][c]) for c in ("change", "projection", "shift", "cosine"))
    decoded = ae.decode(active, samples, model)
    for r in dg.pinned_reconstruction(decoded, active, pins, model).collect():
        assert np.allclose(r.reconstruction, 0.2 + np.arange(10) / 4 @ dec)
    n = 4100
    many = spark.range(n).select(F.col("id").cast("int").alias("feature_id"), F.array(F.lit(1.0)).alias("w_enc"), F.array(F.lit(2.0)).alias("w_dec"), F.lit(0.0).alias("b_enc"))
    wide = ae.Autoencoder(many, spark.createDataFrame([([0.0],)], "b_dec array<double>"))
    one = spark.createDataFrame([(1, [0.5])], "sample_id long, vec array<double>")
    rows = dg.pinned_shift(ae.encode(one, wide, 0.1, 1), one, many.select("feature_id", F.lit(1.5).alias("value")), wide).collect()
    assert len(rows) == n and rows[0].shift == pytest.approx(2 * (1.5 * n - 0.5))
    assert sorted(round(r.change, 6) for r in rows) == [1.0] + [1.5] * (n - 1)
