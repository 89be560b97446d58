"""Weights in slabs: one plan for all sizes, with and without ids, in batch and in streams."""

import glob

import numpy as np
import pytest

from sparselens.operators import autoencoder as ae
from sparselens.plans import slabs
from sparselens.session import shared_dir
from sparselens.streaming import incremental as inc

WEIGHTS = "feature_id int, w_enc array<double>, w_dec array<double>, b_enc double"


def model(spark, units=20, dim=4, cells=None, seed=0, ids=None):
    rng = np.random.default_rng(seed)
    enc, dec, bias = rng.normal(size=(units, dim)), rng.normal(size=(units, dim)), rng.normal(size=units) / 4
    ids = list(range(units)) if ids is None else ids
    rows = [(i, e.tolist(), d.tolist(), float(b)) for i, e, d, b in zip(ids, enc, dec, bias)]
    made = ae.Autoencoder(spark.createDataFrame(rows, WEIGHTS).repartition(4), spark.createDataFrame([([0.1] * dim,)], "b_dec array<double>"),
                          slab_cells=cells)
    return made, enc, dec, bias


def samples(spark, schema="sample_id long, other string, vec array<double>", n=40, dim=4):
    x = np.random.default_rng(1).normal(size=(n, dim))
    ids = [None if i % 5 == 0 else i // 3 for i in range(n)]  # null and repeated ids
    return spark.createDataFrame([(i, f"row{k}", v.tolist()) for k, (i, v) in enumerate(zip(ids, x))], schema), x


@pytest.mark.parametrize("units_per_slab", [1, 3, 7, 1000])
@pytest.mark.parametrize("k", [None, 1, 4, 50])
def test_running_top_k_over_slabs(spark, units_per_slab, k):
    coder, enc, _, bias = model(spark, cells=4 * units_per_slab)
    df, x = samples(spark)
    f = np.maximum((x - 0.1) @ enc.T + bias, 0)
    want = []
    for row, values in enumerate(f):
        hit = sorted((-v, u) for u, v in enumerate(values) if v > 0.2)[:k]
        want += [(f"row{row}", u, round(-v, 9)) for v, u in hit]
    got = ae.encode(df, coder, 0.2, k).collect()
    assert sorted((r.other, r.feature_id, round(r.activation_value, 9)) for r in got) == sorted(want)
    assert len(coder.slabs()) >= 20 // units_per_slab


def test_equal_values_keep_the_lower_unit_whatever_the_slab(spark):
    same = ([1.0, 0.0], [1.0, 0.0], 0.0)
    weights = spark.createDataFrame([(i, *same) for i in range(9)], WEIGHTS)
    bias = spark.createDataFrame([([0.0, 0.0],)], "b_dec array<double>")
    df = spark.createDataFrame([([2.0, 5.0],)], "vec array<double>")  # no id column at all
    for cells in (2, 6, 1000):
        got = ae.encode(df, ae.Autoencoder(weights, bias, slab_cells=cells), 0.0, 4).collect()
        assert [r.feature_id for r in got] == [0, 1, 2, 3]


@pytest.mark.parametrize("cells", [4, 12, 1 << 20])
def test_forward_losses_and_alive_without_ids(spark, cells):
    coder, enc, dec, bias = model(spark, cells=cells)
    df, x = samples(spark)
    f = np.maximum((x - 0.1) @ enc.T + bias, 0)
    out = f @ dec + 0.1
    for r in ae.forward(df.drop("sample_id"), coder).collect():
        row = int(r.other[3:])
        assert np.allclose(r.reconstruction, out[row])
        assert [e.feature_id for e in r.features] == np.flatnonzero(f[row]).tolist()
    for r in ae.model_errors(df, coder).collect():
        row = int(r.other[3:])
        assert r.squared_error == pytest.approx(((out[row] - x[row]) ** 2).sum()) and r.l1 == pytest.approx(f[row].sum()) and r.dim == 4
    alive = ae.alive_units(df, coder, 1.5).collect()
    assert sorted(r.feature_id for r in alive) == np.flatnonzero((f > 1.5).any(axis=0)).tolist()


def test_nan_vectors_and_units_with_gaps_and_negative_ids(spark):
    ids = [k * 7 - 30 for k in range(20)]
    df = spark.createDataFrame([(1, [float("nan")] * 4), (2, [1.0, -1.0, 0.5, 2.0])], "sample_id long, vec array<double>")
    results = []
    for cells in (4, 12, 1 << 20):
        coder, *_ = model(spark, cells=cells, ids=ids)
        assert {r.sample_id for r in ae.encode(df, coder).collect()} == {2}
        found = {r.sample_id: r.reconstruction for r in ae.forward(df, coder).collect()}
        assert np.isnan(found[1]).all()
        active = spark.createDataFrame([(1, -30, 2.0), (1, -30, 1.0), (1, 5, 1.0), (1, -29, 9.0), (3, 103, 1.0), (None, -30, 1.0)],
                                       "sample_id long, feature_id int, activation_value double")
        decoded = ae.decode(active, spark.createDataFrame([(1,), (3,), (4,)], "sample_id long"), coder).collect()
        results.append(sorted((r.sample_id, tuple(np.round(r.reconstruction, 12))) for r in decoded))
    assert results[0] == results[1] == results[2] and [r[0] for r in results[0]] == [1, 3, 4]


def test_streams_take_the_same_plan(spark, tmp_path):
    coder, *_ = model(spark, cells=12)
    df, _ = samples(spark)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    df.repartition(3).write.parquet(src)
    stream = inc.active_stream(inc.vector_stream(spark, src, df.schema, files_per_trigger=1), coder, 0.2, 3)
    inc.append_to(stream, out, mark).awaitTermination()
    key = ("other", "feature_id", "activation_value")
    assert sorted(spark.read.parquet(out).select(*key).collect()) == sorted(ae.encode(df, coder, 0.2, 3).select(*key).collect())


def test_odd_weights(spark):
    bias = spark.createDataFrame([([0.0, 0.0],)], "b_dec array<double>")
    one = (1, [1.0, 2.0], [1.0, 2.0], 0.0)
    for rows, what in (([one, one], "several rows"), ([one, (None, *one[1:])], "without an id"),
                       ([one, (2, [1.0], [1.0], 0.0)], "different length")):
        with pytest.raises(Exception, match=what):
            ae.Autoencoder(spark.createDataFrame(rows, WEIGHTS).coalesce(1), bias).slabs()
    none = ae.Autoencoder(spark.createDataFrame([], WEIGHTS), bias)
    df = spark.createDataFrame([(1, [3.0, 4.0])], "sample_id long, vec array<double>")
    assert none.slabs() == [] and ae.encode(df, none).count() == 0 and ae.alive_units(df, none).count() == 0
    assert ae.forward(df, none).first().reconstruction == [0.0, 0.0] and ae.model_errors(df, none).first().squared_error == 25.0
    empty, *_ = model(spark, cells=12)
    assert ae.encode(samples(spark)[0].limit(0), empty).count() == 0


def test_slabs_are_written_once_and_can_be_removed(spark):
    coder, *_ = model(spark, cells=12)
    df, _ = samples(spark)
    files = lambda: len(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/weights-*/*.arrow"))
    before = files()
    ae.encode(df, coder).count(), ae.forward(df, coder).count()
    assert files() - before == len(coder.slabs()) >= 7
    coder.remove()
    assert files() == before


def test_slabs_of_a_store_that_is_not_mounted(spark, monkeypatch, tmp_path):
    """Other file systems are read one slab at a time."""
    coder, enc, *_ = model(spark, cells=12)
    uri, units = coder.slabs()[0]
    slabs._loaded.cache_clear()
    got = slabs._loaded(uri)
    assert len(got.ids) == units and np.allclose(got.w_enc, enc[got.ids])


@pytest.mark.parametrize("k", [None, 3])
def test_nested_rows_hold_the_same_entries(spark, k):
    from pyspark.sql import functions as F
    coder, *_ = model(spark, cells=12)
    df, _ = samples(spark)
    flat = sorted((r.other, r.feature_id, r.activation_value) for r in ae.encode(df, coder, 0.2, k).collect())
    nested = ae.encode_nested(df, coder, 0.2, k)
    assert nested.count() == 40
    rows = nested.select("other", F.inline("features")).collect()
    assert sorted((r.other, r.feature_id, r.activation_value) for r in rows) == flat


def test_records_move_one_row_a_sample(spark):
    """What is shuffled for the contexts is a row a sample, not a row a unit."""
    from pyspark.sql import functions as F
    from sparselens.operators import activations as ac
    df = spark.createDataFrame([(i, i % 7, i // 30, [float((i * k) % 11) / 10 for k in range(40)]) for i in range(90)],
                               "sample_id long, token_id int, chunk_id int, vec array<double>")
    got = sorted(map(str, ac.extract_activations(df, threshold=0.4, top_k_features=5).collect()))
    old = ac.activation_records(ac.trimmed_entries(df, 0.4, 5), ac.context_windows(df))
    assert got == sorted(map(str, old.collect())) and len(got) > 400
    whole = ac.extract_activations(df, threshold=0.4, top_k_features=None)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ac.activation_records(ac.active_entries(df, 0.4), ac.context_windows(df)).collect()))
    plan = ac.extract_activations(df, threshold=0.4)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = {what: next(k for k, line in enumerate(plan) if what in line) for what in ("Generate explode", "Join Inner")}
    assert first["Generate explode"] < first["Join Inner"]  # the records are written out above the join


def test_mapped_slabs_are_let_go(spark, tmp_path):
    coder = model(spark, cells=4 * 2)[0]
    for uri, _ in coder.slabs():
        assert len(slabs.open_slab(uri).ids) == 2
    assert len(coder.slabs()) == 10 and slabs._mapped.cache_info().currsize + slabs._loaded.cache_info().currsize <= 2


def test_untrimmed_entries_of_a_slab_leave_at_once(spark):
    """Entries of all slabs were held for every row of a slice before anything left, sorted by row."""
    from pyspark.sql import functions as F
    coder = model(spark, units=50, cells=4 * 7)[0]
    got = ae.encode(samples(spark)[0], coder).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    tasks = {}
    for r in got:
        tasks.setdefault(r.at >> 33, []).append((r.feature_id // 7, r.other))
    assert max(len({other for _, other in t}) for t in tasks.values()) > 1
    for t in tasks.values():
        assert [slab for slab, _ in t] == sorted(slab for slab, _ in t)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_rows_of_a_unit_are_trimmed_in_the_task(spark, monkeypatch, held):
    from pyspark.sql import functions as F

    from sparselens.operators.features import top_activations_per_feature
    monkeypatch.setattr(ae, "VECTORS_HELD", held)
    coder = model(spark, units=30, cells=4 * 7)[0]
    x = np.random.default_rng(5).normal(size=(20, 4))
    rows = [(None if i == 33 else i // 2 * 7 % 50, x[i % 20].tolist()) for i in range(300)]  # many equal vectors
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>").repartition(2)
    every, few = ae.encode(df, coder), ae.encode(df, coder, top_k_samples=5)
    tops = [sorted(map(tuple, top_activations_per_feature(e.withColumn("activation_value", F.round("activation_value", 9)), 5).collect()), key=str)
            for e in (every, few)]
    assert tops[0] == tops[1] and few.count() < every.count() / 2
    with pytest.raises(ValueError):
        ae.encode(df, coder, 0.0, 3, top_k_samples=5)


def test_entries_of_slabs_lie_side_by_side():
    """``forward`` put the entries of all slabs together by a sort; a row's entries are now copied to their place."""
    f = np.maximum(np.random.default_rng(2).normal(size=(5, 9)), 0)
    f[3] = 0
    ids = np.array([2, 3, 5, 7, 11, 13, 17, 19, 23])
    found = [(f[:, lo:lo + 4] > 0).sum(axis=1) for lo in (0, 4, 8)]
    parts = [(n, np.broadcast_to(ids[lo:lo + 4], f[:, lo:lo + 4].shape)[f[:, lo:lo + 4] > 0], f[:, lo:lo + 4][f[:, lo:lo + 4] > 0]) for n, lo in zip(found, (0, 4, 8))]
    want = [[{"feature_id": int(i), "activation_value": v} for i, v in zip(ids, row) if v > 0] for row in f]
    assert ae._side_by_side(5, parts).to_pylist() == want
    assert ae._side_by_side(5, []).to_pylist() == [[]] * 5 and len(ae._side_by_side(0, [])) == 0
