"""Operators on small hand-made frames, compared with plain Python and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparselens.functions import text as X
from sparselens.operators import activations as ac
from sparselens.operators import autoencoder as ae
from sparselens.operators import compare as cp
from sparselens.operators import features as ft
from sparselens.operators import relations as rel
from sparselens.operators import report as rp
from sparselens.operators import resample as rs
from sparselens.operators import splits as sp
from sparselens.operators import text as tx
from sparselens.operators import tokens as tk
from sparselens.plans import joins, quantiles, slabs
from sparselens.sources import catalog as cat

ACT = "sample_id long, feature_id int, activation_value float, token_id int, chunk_id int"


def acts(spark, rows):
    """rows of (feature, token, value)"""
    return spark.createDataFrame(
        [(i, f, float(v), t, 0) for i, (f, t, v) in enumerate(rows)], ACT)


def vecs(spark, matrix, per_chunk=100):
    return spark.createDataFrame(
        [(i, i % 7, i // per_chunk, [float(x) for x in row]) for i, row in enumerate(matrix)],
        "sample_id long, token_id int, chunk_id int, vec array<float>")


def model_of(spark, w_enc, w_dec, b_enc, b_dec, tied=False):
    rows = [(i, e.tolist(), d.tolist(), float(b)) for i, (e, d, b) in enumerate(zip(w_enc, w_dec, b_enc))]
    w = spark.createDataFrame(rows, "feature_id int, w_enc array<double>, w_dec array<double>, b_enc double")
    return ae.Autoencoder(w, spark.createDataFrame([(list(map(float, b_dec)),)], "b_dec array<double>"), tied)


def value(df):
    return df.first()[0]


# ---- ranking and distributions --------------------------------------------------------

def test_selectivity_uses_base_ten(spark):
    act = acts(spark, [(1, i, 1.0) for i in range(99)])
    assert ft.selectivity(act).first()["selectivity_score"] == pytest.approx(0.5)


def test_minimum_support_is_optional(spark):
    act = acts(spark, [(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0)])
    assert {r.feature_id for r in ft.selectivity(act, 2).collect()} == {2}
    assert {r.feature_id for r in ft.selectivity(act, None).collect()} == {1, 2}


def test_head_and_tail_may_overlap(spark):
    act = acts(spark, [(f, 0, f) for f in (1, 2, 3)])
    rows = ft.head_and_tail(ft.selectivity(act), 2).collect()
    assert sorted((r["group"], r.feature_id) for r in rows) == [
        ("bottom-k", 1), ("bottom-k", 2), ("top-k", 2), ("top-k", 3)]


def test_sample_deviation_of_one_row_is_null(spark):
    assert ft.distribution(acts(spark, [(1, 0, 2.0)])).first()["std"] is None


def test_float_values_are_widened_before_arithmetic(spark):
    act = acts(spark, [(1, 0, 0.1), (1, 1, 0.1), (1, 2, 0.1)])
    assert ft.distribution(act).first()["mean"] == float(np.float32(0.1))


def test_absent_feature_gives_an_empty_frame(spark):
    act = acts(spark, [(1, 0, 1.0), (2, 0, 1.0)])
    assert rel.co_occurring_features(act, 99).count() == 0
    assert ft.distribution(ft.for_feature(act, 99)).count() == 0


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [-2.0, 0.0, 5.0, 5.0, 1e-9], list(np.random.default_rng(0).normal(size=501)),
    [0.0] * 50 + [1e6] * 3, [-1.5] * 9])
@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_quantiles_match_numpy_without_whole_groups(spark, large, values, p):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    got = quantiles.exact_quantiles(df, ["g"], "v", {"q": p}).first()["q"]
    assert got == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_values_of_one_cell_are_few(spark):
    """A float32 octave of 2**23 values falls into 256 cells."""
    base = np.float32(1.0).view(np.int32)
    near = (base + np.arange(0, 1 << 23, 4096, dtype=np.int32)).view(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"v": near.astype("float64")}))
    cells = df.groupBy(quantiles.value_cell(F.col("v"))).count().agg(F.max("count")).first()[0]
    # an octave is wider in values at its upper end: 1/ln 2 times the mean
    assert cells <= 1.45 * len(near) / 256 + 1


def test_bad_arguments_are_refused_before_planning(spark):
    act = acts(spark, [(1, 0, 1.0)])
    with pytest.raises(ValueError):
        rel.co_occurring_features(act, 1, 1.5)
    with pytest.raises(ValueError):
        ft.activation_quantile(act, -0.1)
    with pytest.raises(ValueError):
        ft.top_activations(act, 1, 3, "up")
    with pytest.raises(ValueError):
        ac.strongest_per_sample(act, 3, "up")
    with pytest.raises(ValueError):
        sp.split_keys(act, "sample_id", 0.9, 0.2, 0.1)


# ---- thresholds and trims -------------------------------------------------------------

def test_threshold_is_strict(spark):
    df = vecs(spark, [[0.5, 0.25, 0.75]])
    assert [r.feature_id for r in ac.active_entries(df, 0.5).collect()] == [2]


@pytest.mark.parametrize("order,want", [("descending", [1, 3]), ("ascending", [0, 2])])
def test_ties_keep_the_lower_feature(spark, order, want):
    df = ac.active_entries(vecs(spark, [[0.25, 0.5, 0.25, 0.5, 0.5]]), 0.1)
    assert sorted(r.feature_id for r in ac.strongest_per_sample(df, 2, order).collect()) == want


def test_trim_without_limit_changes_nothing(spark):
    df = ac.active_entries(vecs(spark, [[0.25, 0.5]]), 0.1)
    assert ac.strongest_per_sample(df, None).count() == 2


def test_row_wise_trim_equals_window_trim(spark):
    x = np.random.default_rng(1).integers(0, 5, size=(40, 30)) / 8
    df = vecs(spark, x)
    a = ac.strongest_per_sample(ac.active_entries(df, 0.07), 6).select("sample_id", "feature_id", "activation_value")
    b = ac.trimmed_entries(df, 0.07, 6).select("sample_id", "feature_id", "activation_value")
    assert sorted(a.collect()) == sorted(b.collect())


def test_dead_before_and_after_trim_differ(spark):
    active = ac.active_entries(vecs(spark, [[0.9, 0.8, 0.7, 0.0]]), 0.07)
    before = rel.dead_features(ac.alive_features(active), 4)
    after = rel.dead_features(ac.strongest_per_sample(active, 2), 4)
    assert [r[0] for r in before.collect()] == [3]
    assert sorted(r[0] for r in after.collect()) == [2, 3]


def test_alive_and_dead_partition_the_range(spark):
    act = acts(spark, [(1, 0, 1.0), (4, 0, 1.0), (99, 0, 1.0)])
    dead = {r[0] for r in rel.dead_features(act, 6).collect()}
    assert dead == {0, 2, 3, 5}
    row = rel.dead_summary(rel.dead_features(act, 6), 6).first()
    assert (row.dead_count, row.alive_count) == (4, 2)


# ---- contexts -------------------------------------------------------------------------

def brute_context(tokens, w):
    n = len(tokens)
    return [[tokens[min(max(i + o, 0), n - 1)] for o in range(-w, w + 1)] for i in range(n)]


@pytest.mark.parametrize("n,w,width", [(1, 2, 8), (3, 10, 64), (50, 3, 4), (64, 4, 4)])
def test_context_repeats_edges(spark, large, n, w, width):
    tokens = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(i * 3, 0, t) for i, t in enumerate(tokens)],
                               "sample_id long, chunk_id int, token_id int")
    rows = ac.context_windows(df, w, width=width).orderBy("sample_id").collect()
    assert [list(r.context_token_ids) for r in rows] == brute_context(tokens, w)


def test_context_stays_inside_its_group(spark):
    df = spark.createDataFrame([(i, i // 2, i) for i in range(4)], "sample_id long, doc_id int, token_id int")
    rows = ac.context_windows(df, 1, by=["doc_id"]).orderBy("sample_id").collect()
    assert [list(r.context_token_ids) for r in rows] == [[0, 0, 1], [0, 1, 1], [2, 2, 3], [2, 3, 3]]


@pytest.mark.parametrize("vocab_size", [5, None])
def test_unknown_tokens(spark, vocab_size):
    vocab = spark.createDataFrame([(0, "a"), (1, " b"), (3, "c")], "token_id int, token_text string")
    rows = spark.createDataFrame(
        [(0, 1, 0, [0, 2, 3]), (1, 1, 2, [2, 2]), (2, 1, 3, [1, 1, 4])],
        "sample_id long, feature_id int, token_id int, context_token_ids array<int>")
    out = {r.sample_id: r.context_text for r in tx.with_context_text(rows, vocab, vocab_size).collect()}
    assert out == {0: ["a", "c"], 1: None, 2: [" b", " b"]}
    kept = tx.with_token_text(rows, vocab, vocab_size).collect()
    assert sorted(r.sample_id for r in kept) == [0, 2]


def test_vocabulary_array_is_not_carried_by_the_rows(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 0, [0, 1])], "sample_id long, feature_id int, token_id int, context_token_ids array<int>")
    rows.write.parquet(str(tmp_path / "r"))
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "token_id int, token_text string")
    stored = spark.read.parquet(str(tmp_path / "r"))
    out = tx.with_context_text(tx.with_token_text(stored, vocab, 2), vocab, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_texts#" not in plan and list(out.first().context_text) == ["a", "b"]


def test_context_string_and_joined_context_on_short_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "X"), (["a"], "X"), (None, "X")],
                               "context_text array<string>, token_text string")
    out = tx.with_joined_context(tx.with_context_string(df, 1), 1).collect()
    assert [r.context_string for r in out] == ["a**X**c", "a", None]
    assert [r.token_joined_context for r in out] == ["aXc", "aX", None]


# ---- similarity -----------------------------------------------------------------------

def test_correlation_is_centred_on_own_tokens(spark):
    act = acts(spark, [(1, 0, 1.0), (1, 1, 3.0), (1, 2, 8.0), (2, 1, 2.0), (2, 2, 5.0), (2, 3, 5.0)])
    a = {0: 1 - 4, 1: 3 - 4, 2: 8 - 4}
    b = {1: 2 - 4, 2: 5 - 4, 3: 5 - 4}
    want = (a[1] * b[1] + a[2] * b[2]) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert value(rel.correlation(act, 1, 2)) == pytest.approx(want)
    assert rel.correlation_pairs(act).first()["correlation"] == pytest.approx(want)


def test_similarity_of_disjoint_and_constant_features(spark):
    act = acts(spark, [(1, 0, 1.0), (2, 1, 1.0), (3, 0, 2.0), (3, 4, 2.0), (4, 0, 1.0), (4, 2, 5.0)])
    assert value(rel.cosine_similarity(act, 1, 2)) == 0.0
    assert value(rel.correlation(act, 1, 2)) == 0.0
    assert math.isnan(value(rel.correlation(act, 3, 4)))
    assert value(rel.cosine_similarity(act, 1, 77)) == 0.0


def test_similarity_matrix_properties(spark):
    rng = np.random.default_rng(2)
    act = acts(spark, [(int(f), int(t), v) for f, t, v in zip(
        rng.integers(0, 12, 300), rng.integers(0, 40, 300), rng.random(300) + 0.1)])
    ids = act.select("feature_id").distinct()
    m = {(r.feature_i, r.feature_j): r.cosine_similarity for r in rel.similarity_matrix(act, ids).collect()}
    assert len(m) == 144
    for (i, j), v in m.items():
        assert v == pytest.approx(m[j, i]) and abs(v) <= 1 + 1e-12
        assert v == pytest.approx(value(rel.cosine_similarity(act, i, j))) or i == j
        assert i != j or v == 1.0


def test_co_occurrence_is_inclusive_and_equals_single_probe(spark, large):
    rng = np.random.default_rng(3)
    act = acts(spark, [(int(f), int(t), int(v) / 4) for f, t, v in zip(
        rng.integers(0, 8, 200), rng.integers(0, 30, 200), rng.integers(1, 6, 200))])
    batch = {(r.source_feature_id, r.feature_id): r.co_occurrence_count
             for r in rel.co_occurrence_counts(act).collect()}
    rows = act.toPandas()
    for probe in range(8):
        own = rows[rows.feature_id == probe]
        strong = set(own[own.activation_value >= np.quantile(own.activation_value, 0.75)].token_id)
        hit = rows[rows.token_id.isin(strong) & (rows.feature_id != probe)]
        want = hit.groupby("feature_id").token_id.nunique().to_dict()
        assert {k[1]: v for k, v in batch.items() if k[0] == probe} == want
        single = rel.co_occurring_features(act, probe).collect()
        assert {r.feature_id: r.co_occurrence_count for r in single} == want
        assert all(list(r.token_ids) == sorted(set(r.token_ids)) for r in single)


def test_nearest_alive(spark):
    w = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [0.6, 0.8])],
                              "feature_id int, w_dec array<double>")
    dead = spark.createDataFrame([(3,)], "feature_id int")
    rows = {r.feature_id: r for r in rel.nearest_alive(w, dead, num_features=4).collect()}
    assert (rows[3].kind, rows[3].nearest_id) == ("dead_alive", 1)
    assert (rows[0].kind, rows[0].nearest_id, rows[0].similarity) == ("alive_alive", 1, pytest.approx(0.8))
    near = rel.nearest_alive(w, dead)
    # 0.8 itself is not a near duplicate
    assert rel.near_duplicates(near, 0.8).first()["duplicate_count"] == 0
    assert rel.near_duplicates(near, 0.79).first()["duplicate_count"] == 2


def test_without_an_alive_unit_the_nearest_is_null(spark):
    w = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "feature_id int, w_dec array<double>")
    rows = rel.nearest_alive(w, w.select("feature_id")).collect()
    assert len(rows) == 2 and all(r.similarity is None for r in rows)


# ---- autoencoder ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def coder(spark):
    rng = np.random.default_rng(4)
    x, we, wd = rng.normal(size=(60, 8)), rng.normal(size=(20, 8)), rng.normal(size=(20, 8))
    be, bd = rng.normal(size=20) / 4, rng.normal(size=8) / 4
    x = x.astype("float32").astype("float64")
    f = np.maximum((x - bd) @ we.T + be, 0)
    return x, we, wd, be, bd, f


def as_matrix(rows, shape):
    m = np.zeros(shape)
    for r in rows:
        m[r.sample_id, r.feature_id] = r.activation_value
    return m


@pytest.mark.parametrize("cells,slab", [(8 << 20, 4 << 20), (60, 4 << 20), (60, 24), (8 << 20, 1)])
def test_encode_decode_forward(spark, coder, monkeypatch, cells, slab):
    monkeypatch.setattr(ae, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(slabs, "SLAB_CELLS", slab)
    x, we, wd, be, bd, f = coder
    df, model = vecs(spark, x), model_of(spark, we, wd, be, bd)
    assert np.allclose(as_matrix(ae.encode(df, model).collect(), f.shape), f)
    top = as_matrix(ae.encode(df, model, 0.5, 3).collect(), f.shape)
    want = np.where((f > 0.5) & (f >= np.sort(f, axis=1)[:, [-3]]), f, 0)
    assert np.allclose(top, want)
    alive = {r[0] for r in ae.alive_units(df, model, 2.0).collect()}
    assert alive == set(np.nonzero((f > 2.0).any(axis=0))[0])
    out = {r.sample_id: np.array(r.reconstruction) for r in ae.decode(ae.encode(df, model), df, model).collect()}
    assert all(np.allclose(out[i], f[i] @ wd + bd) for i in range(len(x)))
    fw = {r.sample_id: r for r in ae.forward(df, model).collect()}
    assert all(np.allclose(fw[i].reconstruction, f[i] @ wd + bd) for i in range(len(x)))
    assert all(len(fw[i].features) == (f[i] > 0).sum() for i in range(len(x)))
    errors = {r.sample_id: r for r in ae.model_errors(df, model).collect()}
    assert all(errors[i].squared_error == pytest.approx(((f[i] @ wd + bd - x[i]) ** 2).sum()) for i in range(len(x)))
    assert all(errors[i].l1 == pytest.approx(f[i].sum()) for i in range(len(x)))


def test_tied_decoder_and_silent_samples(spark, coder):
    x, we, wd, be, bd, f = coder
    model = model_of(spark, we, wd, be, bd, tied=True)
    df = vecs(spark, x)
    active = ae.encode(df, model).where("sample_id > 0")
    out = {r.sample_id: np.array(r.reconstruction) for r in ae.decode(active, df, model).collect()}
    assert np.allclose(out[0], bd) and np.allclose(out[5], f[5] @ we + bd)


def test_losses_are_means(spark, coder):
    x, we, wd, be, bd, f = coder
    df = ae.model_errors(vecs(spark, x), model_of(spark, we, wd, be, bd)).withColumn("batch", F.lit(0))
    row = ae.batch_losses(df, 0.3, 20).first()
    assert row.reconstruction_loss == pytest.approx(((f @ wd + bd - x) ** 2).mean())
    assert row.sparsity_loss == pytest.approx(0.3 * np.abs(f).mean())
    assert value(ae.sparsity_loss(df, 0.3, 20, l1="sum").select("sparsity_loss")) == pytest.approx(0.3 * f.sum(axis=1).mean())
    by_rows = ae.sample_errors(ae.forward(vecs(spark, x), model_of(spark, we, wd, be, bd)))
    assert by_rows.agg(F.sum("l1")).first()[0] == pytest.approx(f.sum())


def test_ragged_vectors_are_refused(spark, coder):
    x, we, wd, be, bd, _ = coder
    df = spark.createDataFrame([(0, [1.0] * 8), (1, [1.0] * 7)], "sample_id long, vec array<float>")
    with pytest.raises(Exception, match="different length"):
        ae.encode(df, model_of(spark, we, wd, be, bd)).collect()


def test_norms(spark):
    w = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "feature_id int, w_dec array<double>")
    out = {r.feature_id: list(r.w_dec) for r in ae.normalise_rows(w).collect()}
    assert out == {0: [0.6, 0.8], 1: [0.0, 0.0]}
    assert tuple(ae.norm_range(w).first()) == (0.0, 5.0)


# ---- resampling and splits ------------------------------------------------------------

def test_draw_is_proportional_to_the_error_itself(spark):
    errors = spark.createDataFrame([(9, 0, 1.0), (9, 1, 3.0)], "batch long, sample_id long, squared_error double")
    rows = rs.error_intervals(errors).orderBy("sample_id").collect()
    assert [(r.cum_lo, r.cum_hi) for r in rows] == [(0.0, 0.25), (0.25, 1.0)]
    dead = spark.range(4000).select(F.lit(0).cast("long").alias("step_window"), F.col("id").cast("int").alias("feature_id"))
    drawn = rs.draw_samples(dead, errors, every=10).groupBy("sample_id").count().collect()
    share = {r.sample_id: r["count"] / 4000 for r in drawn}
    assert share[0] == pytest.approx(0.25, abs=0.03) and share[1] == pytest.approx(0.75, abs=0.03)


def test_only_complete_step_windows_count(spark):
    steps = spark.range(1, 8).withColumnRenamed("id", "step")
    fired = spark.createDataFrame([(1, 0, 1.0), (4, 1, 1.0), (7, 0, 1.0), (2, 2, 0.0)],
                                  "step long, feature_id int, activation_value double")
    rows = rs.dead_per_window(fired, steps, 3, every=3).collect()
    assert sorted((r.step_window, r.feature_id) for r in rows) == [(0, 1), (0, 2), (1, 0), (1, 2)]
    assert rs.dead_per_window(fired, steps, 3, every=100).count() == 0


def test_reinitialise(spark, coder):
    x, we, wd, be, bd, _ = coder
    model = model_of(spark, we, wd, be, bd)
    draws = spark.createDataFrame([(3, 7)], "feature_id int, sample_id long")
    rows = {r.feature_id: r for r in rs.reinitialise(model.weights, draws, vecs(spark, x), model.b_dec).collect()}
    unit = (x[7] - bd) / np.linalg.norm(x[7] - bd)
    mean = np.mean([np.linalg.norm(we[i]) for i in range(20) if i != 3])
    assert np.allclose(rows[3].w_dec, unit) and np.allclose(rows[3].w_enc, unit * mean * 0.05)
    assert -0.01 < rows[3].b_enc <= 0 and rows[3].resampled
    assert np.allclose(rows[4].w_enc, we[4]) and not rows[4].resampled


def test_split_floors_and_rest_goes_to_test(spark):
    df = spark.range(19).withColumnRenamed("id", "k")
    counts = {r.split: r["count"] for r in sp.split_keys(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 15, "val": 1, "test": 3}
    with pytest.warns(UserWarning):
        short = sp.split_keys(df, "k", 0.5, 0.1, 0.1)
    assert short.groupBy("split").count().where("split = 'test'").first()["count"] == 9
    assert short.count() == 19


def test_natural_order(spark):
    names = ["chunk_10.pt", "Chunk_2.pt", "chunk_1.pt", "chunk_007b.pt", "chunk_7a.pt", "9.pt", "chunk_99999999999999999999999.pt"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = [r.file for r in sp.natural_order(df).orderBy("chunk_index").collect()]

    def parts(name):
        out, run = [], ""
        for c in name:
            if run and run[-1].isdigit() != c.isdigit():
                out.append(run)
                run = ""
            run += c
        out.append(run)
        if name[0].isdigit():
            out.insert(0, "")
        return [(1, int(p)) if p.isdigit() else (0, p.lower()) for p in out]
    assert got == sorted(names, key=parts)
    shares = [r.worker for r in sp.shard_files(df, 3).orderBy("chunk_index").collect()]
    assert shares == [0, 1, 2, 0, 1, 2, 0]


# ---- text -----------------------------------------------------------------------------

TOKENS = [" the", "The", "THE", "A", "AB", " AB ", "1", "12", " 3", "²", "a1", "A1", "Ab Cd", "Ab cd", "AB Cd", "McDonald",
          "", " ", "\n", "\t ", ".", "...", "-", "It's", "Éa", "éa", "ÉA", "3Ab", "a.B", "A.B", "日本"]


def test_token_flags_follow_python(spark):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in TOKENS], "t string").select(
        "t", X.is_numeric(t).alias("num"), X.is_upper(t).alias("up"), X.is_title(t).alias("title"),
        X.is_whitespace(t).alias("ws"), X.subword_position(t).alias("sub"))
    for r in df.collect():
        s = r.t.strip()
        assert (r.num, r.up, r.title, r.ws) == (s.isdigit(), s.isupper() and len(s) > 1, s.istitle(), s == ""), r.t
        assert r["sub"] == ("word_initial" if r.t.startswith(" ") else "word_medial")


def test_stop_words_and_punctuation(spark):
    """They are read from the word that covers the token's offset; a blank there covers nothing."""
    rows = spark.createDataFrame([(" The", ["x", " The", " y"]), ("The", ["x ", "The", " y"]), ("he", [" t", "he", " y"]), ("en", ["th", "en"]),
                                  (",", ["x", ",", "y"]), ("cat", None)], "token_text string, context_text array<string>")
    stop = spark.createDataFrame([("the",), ("a",)], "word string")
    out = {r.token_text: r for r in tx.classify_tokens(rows, 1, stop_words=stop).collect()}
    assert {t for t, r in out.items() if r.is_stop} == {"The", "he"} and {t for t, r in out.items() if r.is_punct} == {","}
    assert (out["cat"].pos, out["cat"].ner, out["cat"].dep) == ("X", "O", "")


REPLIES = ["Reasoning here\nLabel: Cats", "label: a\nmore\nLABEL:  b: c ", "  no label at all ", "x\n\n  Label: y  \n\n",
           "Label: same\ntext Label: same tail\nLabel: same", "Label:", "a\r\nLabel: b"]


def test_reply_parse(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "reply string")
    for r in tx.parse_replies(df).collect():
        raw = r.reply
        hits = [line for line in raw.strip().splitlines() if line.strip().lower().startswith("label:")]
        want = (hits[-1].partition(":")[2].strip(), raw[:raw.rindex(hits[-1])].strip()) if hits else (raw.strip(), "")
        assert (r.llm_label, r.llm_reasoning) == want


def test_numbered_list_and_names(spark):
    row = spark.range(1).select(
        X.numbered_list(F.array(F.lit("a"), F.lit("b"))).alias("n"),
        X.alive_file_name(F.lit("user/runs_32x_0.01"), "runs_").alias("f"),
        X.short_label(F.lit("x" * 21), 20).alias("s"), X.short_label(F.lit("x" * 20), 20).alias("t"),
        X.table_name(F.lit(8), F.lit("0.0001")).alias("u")).first()
    assert tuple(row) == ("1. a\n2. b", "alive_features_32x_0.01.json", "x" * 20 + "...", "x" * 20, "hf_8x_0_0001_full")


def test_tokenise(spark):
    df = spark.createDataFrame([(0, "a  bc\nd"), (1, ""), (2, " x y z")], "doc_id long, text string")
    rows = tk.token_rows(df).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.word) for r in rows] == [
        (0, 0, "a"), (0, 1, " bc"), (0, 2, "d"), (2, 0, " x"), (2, 1, " y"), (2, 2, " z")]
    assert tk.token_rows(df, 1).count() == 2
    vocab = {r.token_text: r.token_id for r in tk.build_vocabulary(tk.token_rows(df)).collect()}
    assert sorted(vocab.values()) == list(range(6))


# ---- report ---------------------------------------------------------------------------

def test_histogram_matches_numpy(spark, large):
    x = np.random.default_rng(5).normal(size=400).round(3)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)] + [(7, 2.5)], "g int, v double")
    rows = rp.equal_width_histogram(df, "v", 50, ["g"]).toPandas().sort_values("bin")
    for g in (0, 1, 7):
        want, edges = np.histogram(df.where(F.col("g") == g).toPandas().v, 50)
        got = rows[rows.g == g]
        assert list(got.n) == list(want) and np.allclose(got.bin_start, edges[:-1])


def test_fixed_edges_drop_outside_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (-0.4, -0.3, 0.2, 0.2, 1.0, 1.1)], "v double")
    rows = rp.fixed_edge_histogram(df, "v").toPandas().sort_values("bin")
    want, _ = np.histogram(df.toPandas().v, np.linspace(-0.3, 1.0, 80))
    assert list(rows.n) == list(want) and (rows.density * 1.3 / 79).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("split,n", [("train", 50), ("train", 51), ("train", 700), ("val", 10), ("val", 11), ("test", 80)])
def test_rolling_mean_matches_pandas(spark, large, split, n):
    x = np.random.default_rng(6).random(n)
    df = spark.createDataFrame([(split, i * 2, float(v)) for i, v in enumerate(x)], "split string, step long, loss double")
    got = rp.smoothed_losses(df, width=64).toPandas().sort_values("step").smoothed
    window = min(50, n // 10) if split == "train" and n > 50 else min(10, n // 5) if split != "train" and n > 10 else None
    if window is None:
        assert got.isna().all()
    else:
        assert np.allclose(got, pd.Series(x).rolling(window, min_periods=1).mean())


def test_loss_statistics_use_population_deviation(spark):
    df = spark.createDataFrame([("train", 0, 1.0), ("train", 1, 3.0)], "split string, step long, loss double")
    rows = {r.split: r for r in rp.loss_statistics(df).collect()}
    assert tuple(rows["train"])[1:] == (2, 2.0, 1.0, 1.0, 3.0, 2.0)
    assert rows["val"].num_batches == 0 and math.isnan(rows["val"]["mean"])


def test_density_sums_to_one(spark):
    act = acts(spark, [(i % 5, i, 1.0) for i in range(37)])
    assert ft.feature_density(act).agg(F.sum("feature_density")).first()[0] == pytest.approx(1.0)


def test_run_configurations(spark):
    rows = rp.run_configurations(spark).collect()
    assert len(rows) == 16 and rows[0].expansion == 4 and rows[0].lam == 0.0001 and not rows[0].sampling
    assert {r.num_features for r in rows} == {3072, 6144, 12288, 24576}
    assert rows[-1].key == "32x | λ=0.01 | sampling" and rows[-1].dataset == "features_32x_0.01_sampling"


def test_monosemanticity(spark):
    df = spark.createDataFrame([("top-k", "Polysemantic"), ("top-k", "cats"), ("bottom-k", "dogs")], "group string, llm_label string")
    rows = {r["group"]: r.monosemanticity_rate for r in rp.monosemanticity(df).collect()}
    assert rows == {"top-k": 0.5, "bottom-k": 1.0, "overall": pytest.approx(2 / 3)}


def test_table_comparison(spark):
    a = acts(spark, [(1, 0, 1.0), (2, 0, 2.0)])
    b = acts(spark, [(1, 0, 1.0), (2, 0, 2.5)])
    assert value(cp.same_first_rows(a, a)) and not value(cp.same_first_rows(a, b))
    assert tuple(cp.row_counts(a, b).first()) == (2, 2)
    w = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "feature_id int, w_enc array<double>")
    assert value(cp.same_weights(w, w)) and not value(cp.same_weights(w, w.where("feature_id = 0")))


# ---- joins ----------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    big = spark.range(1000).select((F.col("id") % 400 * (F.col("id") % 3)).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    assert sorted(joins.salted_join(big, small, ["k"], how, 7).collect(), key=str) == \
        sorted(big.join(small, "k", how).collect(), key=str)


# ---- tables ---------------------------------------------------------------------------

def test_chunks_of_unequal_length_stop_the_job(spark):
    df = spark.createDataFrame([(0, [1, 2], [[0.1], [0.2]]), (1, [1], [[0.1], [0.2]])],
                               "chunk_id int, token_ids array<int>, activations array<array<double>>")
    assert cat.expand_chunks(df.where("chunk_id = 0")).count() == 2
    with pytest.raises(Exception, match="mismatched lengths"):
        cat.expand_chunks(df).collect()


def test_table_life_cycle(spark, tmp_path):
    src = str(tmp_path / "src")
    acts(spark, [(1, 0, 1.0), (2, 0, 2.0)]).write.parquet(src)
    assert not cat.table_exists(spark, "life")
    cat.create_features_table(spark, "life", src, str(tmp_path / "t"))
    with pytest.warns(UserWarning):
        again = cat.create_features_table(spark, "life", src)
    assert again.count() == 2
    assert "chunk_id" not in cat.drop_column(spark, "life", "chunk_id", str(tmp_path / "u")).columns
    cat.drop_table(spark, "life")
    assert not cat.table_exists(spark, "life")


def test_resumed_run_recomputes_the_alive_set(spark):
    """Chunks skipped by a resumed run still count: the alive set is read from all data."""
    rows = vecs(spark, [[0.9, 0.0], [0.0, 0.9]], per_chunk=1)
    done = rows.where("chunk_id = 0")
    assert [r.sample_id for r in cat.pending_chunks(rows, done).collect()] == [1]
    assert {r[0] for r in ac.alive_features(ac.active_entries(rows)).collect()} == {0, 1}


def test_chunk_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "act")
    rows = vecs(spark, np.random.default_rng(7).random((30, 4)), per_chunk=10)
    out = ac.extract_activations(rows, threshold=0.2)
    cat.write_activations(out, path)
    cat.write_activations(out.where("chunk_id = 1"), path)
    back = cat.read_activations(spark, path)
    assert back.count() == out.count() and set(back.columns) == {f.name for f in cat.schema.ACTIVATIONS}
    assert all(len(r.context_token_ids) == 21 for r in back.collect())


def test_nan_is_not_active(spark):
    from sparselens.operators import activations as ac
    rows = spark.createDataFrame([(1, [float("nan"), 0.5, 0.01]), (2, [float("nan")] * 3)], "sample_id long, vec array<double>")
    for got in (ac.active_entries(rows), ac.trimmed_entries(rows, 0.07, 2)):
        assert [(r["sample_id"], r["feature_id"]) for r in got.collect()] == [(1, 1)]


def test_decode_skips_unknown_units_and_adds_repeated_ones(spark, monkeypatch):
    from sparselens.operators import autoencoder as ae
    weights = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0], 0.0), (2, [0.0, 1.0], [0.0, 1.0], 0.0)],
                                    "feature_id int, w_enc array<double>, w_dec array<double>, b_enc double")
    bias = spark.createDataFrame([([0.25, 0.25],)], "b_dec array<double>")
    active = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 7, 3.0), (1, 2, 1.0), (1, 2, 2.0), (-2, 1, 1.0)],
                                   "sample_id long, feature_id int, activation_value double")
    samples = spark.createDataFrame([(1,), (-2,)], "sample_id long")
    want = {1: [0.75, 3.25], -2: [0.25, 0.25]}
    for cells in (slabs.SLAB_CELLS, 2):
        monkeypatch.setattr(slabs, "SLAB_CELLS", cells)
        got = {r["sample_id"]: list(r["reconstruction"]) for r in ae.decode(active, samples, ae.Autoencoder(weights, bias)).collect()}
        assert got == want
        vectors = spark.createDataFrame([(-5000, [1.0, 0.5]), (3, [0.0, 2.0])], "sample_id long, vec array<double>")
        rows = {(r["sample_id"], r["feature_id"]): r["activation_value"] for r in ae.encode(vectors, ae.Autoencoder(weights, bias)).collect()}
        assert rows == {(-5000, 0): 0.75, (-5000, 2): 0.25, (3, 2): 1.75}


def test_context_text_of_repeated_ids_and_rows(spark):
    from sparselens.operators import text as tx
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (1, "B"), (2, "c")], "token_id int, token_text string")
    rows = spark.createDataFrame([(1, 1, [0, 1, 2]), (1, 1, [2, 2, 9]), (2, 1, None)], "sample_id long, feature_id int, context_token_ids array<int>")
    for size in (3, None):
        got = sorted((r["sample_id"], r["context_text"] or []) for r in tx.with_context_text(rows, vocab, size).collect())
        assert got == [(1, ["a", "B", "c"]), (1, ["c", "c"]), (2, [])]


def test_records_of_rows_with_contexts_do_not_move(spark, large):
    """Arrays of units moved to meet contexts that were built from the same rows."""
    samples = spark.createDataFrame([(i, i % 7, i // 10, [float(i % 3), 0.5, 0.0]) for i in range(30)], "sample_id long, token_id int, chunk_id int, vec array<double>")
    contexts = ac.context_windows(samples, 2)
    nested = ac.nested_entries(samples, 0.1, 2)
    units = nested.select("sample_id", "features").toPandas().set_index("sample_id").features
    mine = contexts.withColumn("features", F.when(F.col("sample_id") >= 0, F.array(F.struct(F.lit(4).alias("feature_id"), F.col("sample_id").cast("double").alias("activation_value")))))
    got, plan = ac.nested_records(mine).collect(), ac.nested_records(mine)._jdf.queryExecution().executedPlan().toString()
    windows = contexts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == windows.count("Exchange") and len(got) == 30
    want = {r.sample_id: r.context_token_ids for r in contexts.collect()}
    assert all(r.context_token_ids == want[r.sample_id] and r.feature_id == 4 and r.activation_value == r.sample_id for r in got)
    joined = ac.nested_records(nested, contexts).collect()
    assert sorted((r.sample_id, r.feature_id) for r in joined) == sorted((s, e["feature_id"]) for s, es in units.items() for e in es)


def test_units_of_a_corpus_are_not_moved(spark, large, tmp_path):
    """P13_corpus_to_activations moved 25 units and a context of every token; equal to sums over all records."""
    from sparselens.workload import extraction
    words = "the a of mouse house tree river stone cloud".split()
    docs = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(1 + 3 * i))) for i in range(12)]
    spark.createDataFrame(docs + [(3, "twice the same id")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = np.random.default_rng(3).normal(size=(5, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = extraction.corpus_to_activations(spark, str(tmp_path))
    assert "hashpartitioning(sample_id" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.feature_id: r for r in out.collect()}
    tokens = extraction.tk.corpus_samples(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    contexts = ac.context_windows(tokens).toPandas()
    units = vectors.astype("float32").astype("float64")
    units /= np.linalg.norm(units, axis=1)[:, None]
    f = vectors.astype("float32").astype("float64") @ units.T + [-0.05 * (i % 2) for i in range(5)]
    for u in range(5):
        mine = contexts[[f[t % 5, u] > 0.07 for t in contexts.token_id]]
        if not len(mine):
            assert u not in got
            continue
        r = got[u]
        assert (r.n, r.tokens) == (len(mine), mine.token_id.nunique())
        assert r.total == pytest.approx(sum(f[t % 5, u] for t in mine.token_id))
        assert (r.first_context, r.last_context) == tuple(sum(c[k] for c in mine.context_token_ids) for k in (0, 20))


def test_running_sum_moves_its_rows_once(spark, large):
    """Rows moved to a window over ranges, and once more to meet the totals of the ranges before."""
    df = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3) for k in range(50)], "k long, g int")
    out = large.running_sum(df.withColumn("one", F.lit(1)), "k", {"s": "one"}, ["g"], 4)
    assert sorted((r.g or 0, r.s) for r in out.collect()) == sorted((k % 3, k // 3 + 1) for k in range(50))
    again = large.running_sum(df.withColumn("one", F.lit(1)), "k", {"s": "one"}, ["g"], 4, float("inf"))  # rows once, totals three times
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4
