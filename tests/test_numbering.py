"""Positions by sampled ranges against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from sparselens.operators import resample as rs
from sparselens.operators import splits as sp
from sparselens.plans import ordered
from sparselens.plans.numbering import number_rows


def rows(n=800):
    """Most rows in one group; text keys, negative numbers, nulls in both."""
    rng = random.Random(5)
    return [(None if k % 17 == 0 else "hot" if k % 5 else f"g{k % 3}", None if k == 40 else f"{rng.random():.12f}", k - 300, "x") for k in range(n)]


def as_sorted(data, by, key):
    seen, out = {}, {}
    for r in sorted(data, key=key):
        group = r[0] if by else 0
        out[r[2]] = seen[group] = seen.get(group, -1) + 1
    return out


def null_first(v):
    return (v is not None, v)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_any_key(spark, by):
    data = rows()
    df = spark.createDataFrame(data, "g string, k string, id long, idx string").repartition(7)
    got = {r.id: r.at for r in number_rows(df, ["k"], by, "at").collect()}
    assert got == as_sorted(data, by, lambda r: null_first(r[1]))
    got = {r.id: r.at for r in number_rows(df, [F.length("k").desc(), F.desc("id")], by, "at").collect()}
    assert got == as_sorted(data, by, lambda r: (-len(r[1]) if r[1] else 99, -r[2]))


def test_ranges_of_a_hot_group_are_even(spark):
    """Half the rows are one group; no range holds much more than its share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9).alias("g"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("k"), "id").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("g", "k").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in ranged) < 1.5 * 20_000 / 4
    numbered = number_rows(df, ["k"], ["g"]).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("top"))
    assert all(r.n == r.d == r.top + 1 for r in numbered.collect())


def test_odd_rows(spark):
    df = spark.createDataFrame([], "g string, k string, id long")
    assert number_rows(df, ["k"]).count() == 0 and number_rows(df, ["k"], ["g"]).count() == 0
    same = spark.createDataFrame([(None, "a", k) for k in range(50)], "g string, k string, id long").repartition(5)
    assert sorted(r.idx for r in number_rows(same, ["k"], ["g"]).collect()) == list(range(50))
    named = spark.createDataFrame([(1, 2)], "`a.b` int, _rows int")
    assert number_rows(named, ["_rows"]).columns == ["a.b", "_rows", "idx"]


def test_dense_index_of_text_keys_in_both_plans(spark, monkeypatch):
    from test_plans import both_plans
    data = [r for r in rows(300)]
    df = spark.createDataFrame(data, "g string, k string, id long, idx string").drop("idx")
    small, large = both_plans(spark, monkeypatch, lambda: ordered.dense_index(df, "k", ["g"]))
    assert small == large and len(large) == 300


def test_plans_have_no_window_over_all_rows(spark):
    import __spark_entry__ as entry
    for name in ("P14_number_files", "M14_shard_files", "K2_ranking_order", "K7_natural_sort"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan, name


def test_natural_order_of_many_names(spark):
    names = [f"{c}_{k}.pt" for k in range(40) for c in ("chunk", "Chunk", "a")]
    random.Random(1).shuffle(names)
    got = {r.file: r.chunk_index for r in sp.natural_order(spark.createDataFrame([(n,) for n in names * 2], "file string").repartition(6)).collect()}
    want = sorted(set(names), key=lambda n: (n.split("_")[0].lower(), int(n.split("_")[1][:-3]), ".pt", n))
    assert got == {n: k for k, n in enumerate(want)}


@pytest.mark.parametrize("units", [1, 62, 63, 64, 200])
def test_dead_units_are_the_complement(spark, units):
    rng = random.Random(units)
    fired = [(s, rng.randrange(units), v) for s in range(1, 24) for v in (1.0, 0.0, -2.0, 3.0)] + [(3, units + 70, 1.0)]
    df = spark.createDataFrame(fired, "step long, feature_id int, activation_value double")
    steps = spark.range(1, 24).withColumnRenamed("id", "step")
    got = {(r.step_window, r.feature_id) for r in rs.dead_per_window(df, steps, units, 5).collect()}
    alive = {((s - 1) // 5, u) for s, u, v in fired if v > 0}
    assert got == {(w, u) for w in range(4) for u in range(units)} - alive
    assert rs.dead_per_window(df, steps.where("false"), units, 5).count() == 0


def test_dead_units_equal_the_streams_counts(spark):
    """What the incremental windows never count is what the batch calls dead."""
    from sparselens.streaming import incremental as inc
    rng = random.Random(9)
    df = spark.createDataFrame([(s, rng.randrange(90), 1.0) for s in range(1, 41) for _ in range(9)],
                               "step long, feature_id int, activation_value double")
    counted = {(r.step_window, r.feature_id) for r in inc.fire_counts(inc.fire_parts(df, 8), 8).collect()}
    dead = {(r.step_window, r.feature_id) for r in rs.dead_per_window(df, df.select("step"), 90, 8).collect()}
    assert dead == {(w, u) for w in range(5) for u in range(90)} - counted and dead
