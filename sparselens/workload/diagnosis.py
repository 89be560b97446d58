"""Queries on the health of features."""

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.operators import autoencoder as ae
from sparselens.operators import diagnostics as dg
from sparselens.streaming import incremental as inc
from sparselens.workload import frames as fr
from sparselens.workload.analysis import K, OTHER, PROBE
from sparselens.workload.extraction import R, TOP_ENC, fresh, sample_stream
from sparselens.workload.registry import register, rounded

FEATURES, DROPPED = 80, 3
RANKED = "row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, sample_id)"


@register("E1_firing_summary", "active", f"""
    SELECT {R('count(*) / (SELECT count(*) FROM samples)')} AS mean_active_features,
           {R(f'1.0 - count(DISTINCT feature_id) / {FEATURES}')} AS dead_fraction FROM active""")
def firing_summary(spark, d):
    return rounded(dg.firing_summary(fr.active(spark, d), fr.samples(spark, d), FEATURES), "mean_active_features", "dead_fraction")


@register("E1_firing_rate_histogram", "active", """
    SELECT CAST(least(floor(rate * 10), 9) AS INTEGER) AS bin, count(*) AS num_features FROM (
        SELECT feature_id, count(*) / (SELECT count(*) FROM samples) AS rate FROM active GROUP BY feature_id) GROUP BY ALL""")
def firing_rates(spark, d):
    return dg.rate_histogram(dg.firing_rates(fr.active(spark, d), fr.samples(spark, d)))


@register("E2_top_stability", "active enc w", f"""
    , a AS (SELECT feature_id, sample_id FROM (SELECT *, {RANKED} AS rk FROM active) WHERE rk <= {K}),
    b AS (SELECT feature_id, sample_id FROM (SELECT *, {RANKED} AS rk FROM enc) WHERE rk <= {K}),
    u AS (SELECT feature_id, sample_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
    SELECT CAST(feature_id AS INTEGER) AS feature_id, {R('sum((n = 2)::int) / count(*)')} AS jaccard FROM u GROUP BY feature_id""")
def stability(spark, d):
    """Strongest samples of the raw units against those of the encoder with the same ids."""
    coded = ae.encode(fr.samples(spark, d), fr.model(spark, d), top_k_samples=K)
    return rounded(dg.top_stability(fr.active(spark, d), coded, K), "jaccard")


@register("E3_error_without", "enc w samples", f"""
    , t AS {TOP_ENC},
    x AS (SELECT sample_id, generate_subscripts(vec, 1) - 1 AS i, unnest(CAST(vec AS DOUBLE[])) AS x FROM samples),
    u AS (SELECT feature_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM w),
    p AS (SELECT t.sample_id, u.i, sum(t.activation_value * u.x) AS s, sum(CASE WHEN t.feature_id % {DROPPED} <> 0 THEN t.activation_value * u.x END) AS q
          FROM t JOIN u ON u.feature_id = t.feature_id GROUP BY ALL)
    SELECT x.sample_id, {R('sum((x.x - coalesce(s, 0)) ** 2)')} AS error, {R('sum((x.x - coalesce(q, 0)) ** 2)')} AS error_without
    FROM x LEFT JOIN p ON p.sample_id = x.sample_id AND p.i = x.i GROUP BY x.sample_id""")
def error_without(spark, d):
    """Every third unit left out."""
    rows, model = fr.samples(spark, d), fr.model(spark, d)
    active = ae.encode(rows, model, 0.07, 25)
    dropped = model.weights.where(F.col("feature_id") % DROPPED == 0)
    return rounded(dg.error_without(rows, active, dropped, model, ae.decode), "error", "error_without")


@register("E5_top_purity", "li", f"""
    SELECT feature_id, {R('max(n) / sum(n)')} AS purity FROM (
        SELECT feature_id, token_id, count(*) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, token_id, chunk_id) AS rk FROM li)
        WHERE rk <= {K} GROUP BY ALL) GROUP BY feature_id""")
def purity(spark, d):
    return rounded(dg.top_purity(fr.line_activations(spark, d), K, ("token_id", "chunk_id")), "purity")


@register("E6_context_cosine", "act", f"""
    , m AS (SELECT feature_id, array_to_string(context_token_ids[9:13], ',') AS key, max(activation_value) AS a FROM act
        WHERE feature_id IN ({PROBE}, {OTHER}) GROUP BY ALL),
    p AS (SELECT key, max(CASE WHEN feature_id = {PROBE} THEN a END) AS a, max(CASE WHEN feature_id = {OTHER} THEN a END) AS b FROM m GROUP BY key)
    SELECT {R('coalesce(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 0)')} AS cosine_similarity FROM p""")
def context_cosine(spark, d):
    return rounded(dg.context_cosine(fr.activations(spark, d), PROBE, OTHER, schema.CONTEXT_WINDOW), "cosine_similarity")


@register("R5_rolling_top", "active", f"""
    SELECT feature_id, CAST(rk AS INTEGER) AS rank, sample_id, {R('activation_value')} AS activation_value
    FROM (SELECT *, {RANKED} AS rk FROM active) WHERE rk <= {K}""")
def rolling_top(spark, d):
    out, mark = fresh(spark, "tops"), fresh(spark, "marks")
    rows = inc.active_stream(sample_stream(spark, d), top_k_features=None).select("feature_id", "sample_id", "activation_value")
    dg.save_rolling_top(rows, out, mark, K).awaitTermination()
    return rounded(dg.rolling_top(spark, out, K).select("feature_id", "rank", "sample_id", "activation_value"), "activation_value")
