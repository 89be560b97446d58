"""Toxicity chain, co-training and mixing: held-out accuracy, targets, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselens.llm import cotrain, mixing, toxicity
from sparselens.llm.textmodel import Logistic, Words, labelled_sample, pieces

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def split(tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    return labels.where(~held), labels.where(held)


def test_toxicity_of_held_out_documents(tables, split):
    docs, _ = tables
    got = toxicity.score_toxicity(docs, split[0]).join(split[1].withColumnRenamed("toxic", "want"), "doc_id").toPandas()
    assert (got.toxic == (got.want == 1)).mean() > 0.97 and got.toxic[got.want == 0].mean() < 0.01 and got.toxic[got.want == 1].mean() > 0.8


def test_quality_of_held_out_documents(tables, split):
    docs, _ = tables
    got = cotrain.score_quality(docs, split[0]).join(split[1], "doc_id").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99 and got.kept[got.quality == 0].mean() < 0.2
    kept = cotrain.keep_quality(docs, split[0])
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def plain_cotraining(docs, labels, pieces):
    """Co-training over rows in memory: ranks in place of cells and cuts, sums over whole matrices."""
    import pyarrow as pa
    columns = [pa.array(docs[c], t) for c, t in (("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))]
    bits, numbers, places = cotrain.features(*columns, pieces)
    views, group = cotrain.view_matrices(bits, numbers, places), [tuple(p) for p in places]
    y = np.array([labels.get(d, -1) for d in docs.doc_id])
    kept_back = (y >= 0) & (docs.doc_id.to_numpy() % 104_729 % 5 == 0)
    learn, free = (y >= 0) & ~kept_back, y < 0
    models, given = [cotrain.View(x[learn]) for x in views], [np.full(len(y), -1) for _ in views]
    for step in range(cotrain.ROUNDS + 1):
        for m, x, g in zip(models, views, given):
            use = g >= 0
            w = cotrain.WEIGHT * learn.sum() / (learn.sum() + use.sum())
            for _ in range(cotrain.NEWTON if step else cotrain.FIRST):
                if m.step(m.slopes(x[learn], y[learn]) + w * m.slopes(x[use], g[use]), learn.sum() + w * use.sum()) < 1e-3:
                    break
        if step == cotrain.ROUNDS:
            break
        for v in (0, 1):
            kind, cell = cotrain.confidence(models[v], views[v])
            for s in set(group):
                inside = np.array([g == s for g in group]) & free
                for k in (0, 1):
                    for i in np.flatnonzero(inside & (given[1 - v] < 0) & (cell >= 0) & (kind == k)):
                        given[1 - v][i] = -2 - int(cell[i])  # waits until its rank is known
                    waiting = np.flatnonzero(given[1 - v] < -1)
                    sure = -2 - given[1 - v][waiting]
                    surer = np.array([(sure > c).sum() for c in sure])
                    given[1 - v][waiting] = np.where(surer < cotrain.SHARE * inside.sum(), k, -1)
    return models, given


def test_exchange_equals_plain_rounds(spark):
    """Every unlabelled document takes part; cuts, labels and fits equal those of rows in memory."""
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet").where("doc_id % 3 = 0")
    pieces, fitted, table = cotrain.fit_quality(docs, labels)
    rows = docs.toPandas().sort_values("doc_id", ignore_index=True)
    models, given = plain_cotraining(rows, {r["doc_id"]: int(r["quality"] > 0) for r in labels.where("quality is not null").collect()}, pieces)
    assert all((g >= 0).sum() > 100 for g in given) and table.count() == len(rows)
    for mine, plain in zip(fitted.models, models):
        assert np.abs(mine.w - plain.w).max() < 0.02


def test_rare_strata_hand_over_and_ties_stay_together():
    counts = np.zeros((2, 2, cotrain.PLACES ** 2, cotrain.CELLS))
    counts[0, 1, 3, [5, 9, 20]] = 500, 60, 70  # 20: 70, then 9 as 70 < 100, not 5
    counts[0, 0, 7, 0] = 1  # a stratum of three documents hands over its only sure one
    rows = np.zeros(cotrain.PLACES ** 2)
    rows[[3, 7]] = 1_000, 3
    cuts, taught = cotrain.choose_cuts(np.append(counts.ravel(), rows))
    assert cuts[0, 1, 3] == 9 and cuts[0, 0, 7] == 0 and list(taught) == [0, 131]


def test_labelled_sample_of_repeated_ids_is_the_lowest_row(spark):
    rows = [(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (2, "c", None), (2, None, "q"), (3, "d", "e")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string")
        known = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 1)], "doc_id long, quality int")
        got = labelled_sample(docs, known, ["quality"], 10).select("doc_id", "text", "lang", "_quality").collect()
        assert sorted(map(tuple, got)) == [(1, "a", "y", 1), (2, None, "q", 1)]


def test_mixing_meets_its_targets(tables):
    docs, labels = tables
    got = mixing.mixing_rates(docs, labels).toPandas()
    total = got.n_words.sum()
    for d, share in mixing.TARGETS.items():
        assert abs((got.n_words * got[f"p_{d}"] * got.rate).sum() / total - share) < 0.01
        assert abs((got.n_words * got[f"p_{d}"] * got.copies).sum() / total - share) < 0.03
    assert got.rate.between(0, mixing.MAX_RATE).all()


def test_rates_of_a_small_problem(spark):
    """Without bounds in the way the totals are met; rates follow from the totals alone."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3] * 3, 400)
    rows = [(int(n), *map(float, q)) for n, q in zip(rng.integers(1, 900, 400), p)]
    scored = spark.createDataFrame(rows, "words long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    scale, steps = mixing.fit_rates(scored, {"high": 0.4, "low": 0.35, "toxic": 0.25})
    a = np.array([r[0] * np.array(r[1:]) for r in rows])
    rate = mixing.rate_of(a / scale, steps, mixing.MAX_RATE)[0]
    assert np.abs(rate @ a / a.sum() - [0.4, 0.35, 0.25]).max() < 0.005


def test_odd_rows(odd_docs, no_docs, labels, spark):
    none = spark.createDataFrame([], labels.schema)
    n = odd_docs.count()
    for known in (labels, none):
        assert toxicity.score_toxicity(odd_docs, known).count() == n and toxicity.score_toxicity(no_docs, known).count() == 0
        assert cotrain.score_quality(odd_docs, known).count() == n and cotrain.score_quality(no_docs, known).count() == 0
        rates = mixing.mixing_rates(odd_docs, known)
        assert rates.count() == n and mixing.mixing_rates(no_docs, known).count() == 0
    assert {r["toxic"] for r in toxicity.score_toxicity(odd_docs, none).collect()} == {False}
    assert {r["kept"] for r in cotrain.score_quality(odd_docs, none).collect()} == {True}
    assert cotrain.keep_quality(odd_docs, none).collect() == odd_docs.collect()
    mixed = mixing.mix(odd_docs, none)
    assert mixed.columns == odd_docs.columns
    assert {r["doc_id"] for r in mixed.where("text is null").collect()} == {2, None}


def test_pieces_of_a_word_do_not_depend_on_its_neighbours():
    import pyarrow as pa
    both = pa.array(["toxic", "a", "größe"], pa.large_string())
    word, piece = pieces(both)
    for k in range(3):
        assert sorted(piece[word == k]) == sorted(pieces(both[k:k + 1])[1])
    words = Words(pa.array(["Toxic a a", None, "a größe"]))
    doc, found = words.pieces()
    assert set(found[doc == 2]) == set(piece[word == 1]) | set(piece[word == 2]) and not (doc == 1).any()


def test_logistic_regression_separates():
    x = np.random.default_rng(0).standard_normal((500, 3))
    y = x[:, 0] - x[:, 1] > 0.3
    assert ((Logistic().fit(x, y).logit(x.astype(np.float32)) > 0) == y).mean() > 0.97
