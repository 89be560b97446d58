"""Building blocks of the plans against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselens.operators import tokens
from sparselens.plans import blocks, joins, ordered
from sparselens.plans.topk import top_k


@pytest.mark.parametrize("very_large", [0, float("inf")])
@pytest.mark.parametrize("width", [4, 100, 1 << 16])
def test_running_sum(spark, very_large, width):
    df = spark.range(300).select((F.col("id") * 3 - 90).alias("k"), (F.col("id") % 2).alias("g"), "id")
    got = ordered.running_sum(df, "k", {"s": "id"}, ["g"], width, very_large).toPandas().sort_values("k")
    assert (got.s == got.groupby("g").id.cumsum()).all() and len(got) == 300
    whole = ordered.running_sum(df, "k", {"s": "id"}, (), width, very_large).toPandas().sort_values("k")
    assert (whole.s == whole.id.cumsum()).all()


def test_hash_rank_is_a_seeded_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k: r["rank"] for r in ordered.rank_by_hash(df.repartition(3), "k", 1).collect()}
    b = {r.k: r["rank"] for r in ordered.rank_by_hash(df, "k", 1).collect()}
    c = {r.k: r["rank"] for r in ordered.rank_by_hash(df, "k", 2).collect()}
    assert a == b != c and sorted(a.values()) == list(range(500))


def test_hot_position_range_stays_bounded(spark):
    """No window partition holds more than one range and its neighbours."""
    df = spark.range(1000).select(F.col("id").alias("p"), F.lit(0).alias("g"))
    out = ordered.over_neighbours(df, "p", {"n": lambda w: F.count("*").over(w)}, ["g"], 5, 5, 50)
    rows = out.collect()
    assert len(rows) == 1000 and max(r.n for r in rows) == 11
    with pytest.raises(ValueError):
        ordered.over_neighbours(df, "p", {}, ["g"], 51, 0, 50)


@pytest.mark.parametrize("k", [1, 3, 150])
def test_top_k_of_a_hot_group(spark, k):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("g"),
                                  (F.col("id") * 37 % 101).alias("v"), "id").repartition(6)
    got = {(r.g, r.rank): (r.v, r.id) for r in top_k(df, "g", [F.desc("v"), F.col("id")], k).collect()}
    rows = df.toPandas().sort_values(["g", "v", "id"], ascending=[True, False, True])
    want = {}
    for g, part in rows.groupby("g"):
        for i, r in enumerate(part.head(k).itertuples()):
            want[g, i + 1] = (r.v, r.id)
    assert got == want


@pytest.mark.parametrize("block,width", [(3, 4), (100, 1000)])
def test_sparse_products(spark, block, width):
    rng = np.random.default_rng(0)
    m = np.where(rng.random((30, 11)) < 0.4, rng.random((30, 11)), 0)
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))],
                                  "t long, f int, x double")
    g, shared = m.T @ m, (m > 0).T.astype(int) @ (m > 0)
    rows = blocks.sparse_products(cells, "t", "f", "x", block, width).collect()
    assert all(r.dot == pytest.approx(g[r.feature_i, r.feature_j]) and r.shared == shared[r.feature_i, r.feature_j]
               for r in rows)
    assert len(rows) == (np.triu(shared) > 0).sum()
    rows = blocks.sparse_cross(cells.where("f < 4"), cells, "t", "f", "x", block, width).collect()
    assert len(rows) == (shared[:4] > 0).sum()
    assert all(r.dot == pytest.approx(g[r.left_id, r.right_id]) for r in rows)


@pytest.mark.parametrize("block", [2, 64])
def test_dense_products(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    g = x @ x.T
    rows = blocks.dense_products(df.where("id < 4"), df, block=block).collect()
    assert len(rows) == 36 and all(r.dot == pytest.approx(g[r.left_id, r.right_id]) for r in rows)
    near = {r.left_id: r for r in blocks.nearest_products(df, df, exclude_self=True, block=block).collect()}
    np.fill_diagonal(g, -np.inf)
    assert all(near[i].nearest_id == g[i].argmax() for i in range(9))
    assert blocks.dense_products(df.where("false"), df).count() == 0


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.find("== Initial Plan ==")]


def test_products_leave_their_task_once(spark):
    """Partial products of all pairs of features were shuffled to be added up, and blocks were copied to each other."""
    rng = np.random.default_rng(4)
    m = np.where(rng.random((40, 9)) < 0.5, rng.random((40, 9)), 0)
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "t long, f int, x double")
    for df in (blocks.sparse_products(cells, "t", "f", "x", 3, 4), blocks.sparse_cosines(cells, "t", "f", "x", 3, 4),
               blocks.sparse_cross(cells, cells, "t", "f", "x", 3, 4)):
        plan = shuffles(df)
        assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    rows = blocks.sparse_cosines(cells, "t", "f", "x", 3, 4).collect()
    size = np.sqrt((m * m).sum(axis=0))
    assert len(rows) == 36 and all(r.cosine == pytest.approx((m.T @ m / np.outer(size, size))[r.feature_i, r.feature_j]) for r in rows)
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>")
    assert shuffles(blocks.dense_products(vectors, vectors, block=4)).count("Exchange") == 1


def test_ids_of_dense_products(spark):
    """Negative ids were never met; ids may repeat, rows without one meet nothing."""
    x = np.random.default_rng(5).normal(size=(6, 3))
    ids = [-3, 2, 2, None, 700, 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")
    known = [k for k, i in enumerate(ids) if i is not None]
    rows = [(r.left_id, r.right_id, round(r.dot, 9)) for r in blocks.dense_products(df, df, block=2).collect()]
    assert sorted(rows) == sorted((ids[a], ids[b], round(float(x[a] @ x[b]), 9)) for a in known for b in known)
    near = blocks.nearest_products(df, df, exclude_self=True, block=2).collect()
    assert len(near) == 6
    for r in near:
        dots = {(a, b): x[a] @ x[b] for a in known for b in known if ids[a] == r.left_id and ids[b] != ids[a]}
        assert (r.nearest_id, r.similarity) == (None, None) if r.left_id is None else ids[max(dots, key=dots.get)[1]] == r.nearest_id


@pytest.mark.parametrize("block, most", [(512, 0), (2, 35)])
def test_dense_products_leave_by_value(spark, block, most):
    """Products left in order of ids, so that a written answer took 8 bytes a product. A tile leaves by rising product."""
    x = np.random.default_rng(6).normal(size=(12, 3))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    right = left.select((F.col("id") + 100).alias("id"), "vec")
    rows = blocks.dense_products(left, right, block=block).select("*", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 144 and sum(a.p == b.p and a.dot > b.dot for a, b in zip(rows, rows[1:])) <= most
    assert {(r.left_id, r.right_id): round(r.dot, 9) for r in rows} == {(i, j + 100): round(float(x[i] @ x[j]), 9) for i in range(12) for j in range(12)}


@pytest.mark.parametrize("ordered_rows", [1, 1 << 22])
def test_cosines_leave_by_value(spark, monkeypatch, ordered_rows):
    """Cosines left in order of ids, so that a written answer took 8 bytes a pair."""
    monkeypatch.setattr(blocks, "_ORDERED", ordered_rows)
    m = np.random.default_rng(7).random((6, 20))
    cells = spark.createDataFrame([(t, f, float(m[t, f])) for t in range(6) for f in range(20)], "t long, f int, x double")
    rows = blocks.sparse_cosines(cells, "t", "f", "x", 16, 4).select("*", F.spark_partition_id().alias("p")).collect()
    size = np.sqrt((m * m).sum(axis=0))
    assert len(rows) == 190 and all(r.cosine == pytest.approx((m.T @ m / np.outer(size, size))[r.feature_i, r.feature_j]) and r.shared == 6 for r in rows)
    assert sum(a.p == b.p and a.cosine > b.cosine for a, b in zip(rows, rows[1:])) <= (2 if ordered_rows == 1 else 0)


def test_ones_are_multiplied_once(spark):
    """Co-occurrences multiplied the same 0/1 blocks twice, for products and for numbers of common rows."""
    m = np.random.default_rng(8).random((40, 9)) < 0.3
    cells = spark.createDataFrame([(int(t), int(f), 1.0) for t, f in zip(*np.nonzero(m))], "t long, f int, x double")
    args = cells.where("f < 4"), cells, "t", "f", "x", 3, 16
    rows = sorted(blocks.sparse_cross(*args, ones=True).collect())
    assert rows == sorted(blocks.sparse_cross(*args).collect()) and {(r.left_id, r.right_id): r.shared for r in rows}[0, 5] == (m[:, 0] & m[:, 5]).sum()


def test_entries_without_a_row_or_a_feature_meet_nothing(spark):
    cells = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (None, 1, 1.0), (1, None, 1.0), (-5, 1, 1.0), (-5, -2, 4.0)], "t long, f int, x double")
    rows = {(r.feature_i, r.feature_j): r.dot for r in blocks.sparse_products(cells, "t", "f", "x", 2, 2).collect()}
    assert rows == {(1, 1): 5.0, (1, 2): 6.0, (2, 2): 9.0, (-2, 1): 4.0, (-2, -2): 16.0}


NULLABLE = [("a", 5, 1.5), ("a", 9, float("nan")), ("a", -7, 8.0), (None, 3, 1.0), (None, -2, 2.0), (None, 8, float("inf")),
            ("b", 1, float("-inf")), ("b", 2, None), ("b", 4, 0.0), ("c", 6, None)]


def nullable(spark):
    return spark.createDataFrame(NULLABLE, "g string, k long, v double")


def both_plans(spark, monkeypatch, run):
    """The rows of the plan for small inputs and of the one for large inputs."""
    from sparselens.plans import joins
    small = sorted(map(str, run().collect()))
    for name in ("SMALL_INPUT", "BROADCAST_BYTES", "BROADCAST_ROWS"):
        monkeypatch.setattr(joins, name, -1)
    return small, sorted(map(str, run().collect()))


def test_null_groups_are_numbered(spark, monkeypatch):
    small, large = both_plans(spark, monkeypatch, lambda: ordered.dense_index(nullable(spark), "k", ["g"], width=4))
    assert small == large and len(large) == len(NULLABLE)


def test_quantiles_of_null_groups_nan_and_infinities(spark, monkeypatch):
    from sparselens.plans.quantiles import exact_quantiles
    small, large = both_plans(spark, monkeypatch, lambda: exact_quantiles(
        nullable(spark), ["g"], "v", {"low": 0.25, "mid": 0.5, "top": 1.0}, count_name="n"))
    assert small == large and len(large) == 3


@pytest.mark.parametrize("frequent", [1, 3, 1 << 18])
def test_frequent_keys_are_not_moved_and_nothing_is_copied(spark, large, frequent):
    words = ["the"] * 40 + ["of"] * 20 + [f"w{i}" for i in range(30)] + [None, "unknown", "unknown"]
    big = spark.createDataFrame(list(enumerate(words)), "pos long, word string")
    ids = [("the", 1), ("of", 2), ("of", 3), ("unused", 4), (None, 5), *((f"w{i}", 10 + i) for i in range(30))]
    small = spark.createDataFrame(ids, "word string, token_id long")
    got = joins.frequent_join(big, small, "word", frequent)
    assert got.columns == ["word", "pos", "token_id"]
    assert sorted((r.pos, r.word, r.token_id) for r in got.collect()) == sorted(
        (p, w, i) for p, w in enumerate(words) for k, i in ids if w is not None and w == k)
    plan = tokens.assign_token_ids(big, small.withColumnRenamed("word", "token_text"))._jdf.queryExecution().toString()
    assert "Generate explode" not in plan  # no copies of the vocabulary


def test_rows_of_keys_alone_are_spread(spark):
    from sparselens.plans.joins import salted_join
    big = spark.range(1000, numPartitions=8).select(F.lit(1).alias("k"))
    out = salted_join(big, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], salts=4)
    assert out.count() == 1000


@pytest.fixture
def tight(monkeypatch):
    """No shortcut for small inputs, and cells of at most 50 rows."""
    from sparselens.plans import joins, quantiles
    for name in ("SMALL_INPUT", "BROADCAST_BYTES", "BROADCAST_ROWS"):
        monkeypatch.setattr(joins, name, -1)
    monkeypatch.setattr(quantiles, "MOST_ROWS", 50)
    return quantiles


def test_close_doubles_are_refined_until_few_rows_are_left(spark, tight, monkeypatch):
    """Thousands of doubles within one part in ten million, copies, and a group of one repeated value."""
    rng = np.random.default_rng(3)
    close = (1.5 + rng.random(4_000) * 1e-7).tolist()
    data = [("close", v) for v in close] + [("close", close[7])] * 500 + [("same", 2.25)] * 900 + [("two", v) for v in (1.0, 1.0 + 2.0 ** -52) for _ in range(300)]
    data += [(None, float(v)) for v in rng.normal(size=300) * 1e9]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    ranked, largest = tight._ranked, []

    def seen(rows, small):
        largest.append(small.agg(F.coalesce(F.max("_c"), F.lit(0))).first()[0])
        return ranked(rows, small)

    monkeypatch.setattr(tight, "_ranked", seen)
    probs = {"low": 0.001, "p25": 0.25, "mid": 0.5, "top": 0.9993}
    got = {r.g: r for r in tight.exact_quantiles(df, ["g"], "v", probs, count_name="n").collect()}
    for g in ("close", "same", "two", None):
        own = np.array([v for k, v in data if k == g])
        assert got[g].n == len(own)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(own, p), rel=1e-15), (g, name)
    assert max(largest) <= 50 and len(largest) >= 3


def test_infinite_neighbours_of_a_rank(spark, monkeypatch):
    from sparselens.plans.quantiles import exact_quantiles
    inf = float("inf")
    df = spark.createDataFrame([(1, v) for v in (-inf, 1.0, inf)] + [(2, v) for v in (-inf, -inf, 3.0, float("nan"))], "g int, v double")
    small, large = both_plans(spark, monkeypatch, lambda: exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.9}))
    assert small == large
