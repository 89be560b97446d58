"""Queries on the activations table: ranking, distributions, relations, text, reports."""

import pandas as pd
from pyspark.sql import functions as F

from sparselens.functions import text as X
from sparselens.functions import vectors as V
from sparselens.operators import activations as ac
from sparselens.operators import autoencoder as ae
from sparselens.operators import compare as cp
from sparselens.operators import features as ft
from sparselens.operators import relations as rel
from sparselens.operators import report as rp
from sparselens.operators import splits as sp
from sparselens.operators import text as tx
from sparselens.plans.blocks import sparse_products
from sparselens.plans.joins import lookup_join
from sparselens.plans.numbering import number_rows
from sparselens.plans.topk import top_k
from sparselens.session import settle
from sparselens.sources.catalog import memoise
from sparselens.workload import frames as fr
from sparselens.workload.extraction import R, word_rows
from sparselens.workload.registry import joined, register, rounded

PROBE, OTHER = 5, 10     # feature ids asked for by the one-feature queries
K = 20


def flagship(spark, d):
    """Contexts of the most selective feature."""
    act = fr.activations(spark, d)
    best = ft.rank_by_selectivity(act).limit(1).select("feature_id")
    rows = ft.for_listed_features(act, best, 1)
    top = tx.top_contexts_per_feature(rows, fr.vocab(spark), K, vocab_size=fr.VOCAB_SIZE)
    return rounded(top.select("feature_id", "rank", "sample_id", "activation_value", "token_text",
                              "context_string"), "activation_value")


# ---- restrictions ---------------------------------------------------------------------

@register("F1_for_feature", "li", f"SELECT token_id, chunk_id, {R('activation_value')} AS activation_value FROM li WHERE feature_id = {PROBE}")
def for_feature(spark, d):
    return rounded(ft.for_feature(fr.line_activations(spark, d), PROBE).select(
        "token_id", "chunk_id", "activation_value"), "activation_value")


@register("F2_for_token", "li", f"SELECT feature_id, chunk_id, {R('activation_value')} AS activation_value FROM li WHERE token_id = 7")
def for_token(spark, d):
    return rounded(ft.for_token(fr.line_activations(spark, d), 7).select(
        "feature_id", "chunk_id", "activation_value"), "activation_value")


@register("F3_for_features", "li", f"""
    SELECT feature_id, token_id, {R('activation_value')} AS activation_value FROM li WHERE feature_id IN ({PROBE}, {OTHER})""")
def for_features(spark, d):
    return rounded(ft.for_features(fr.line_activations(spark, d), [PROBE, OTHER]).select(
        "feature_id", "token_id", "activation_value"), "activation_value")


@register("F4_without_feature", "li", f"SELECT feature_id, count(*) AS n FROM li WHERE feature_id != {PROBE} GROUP BY feature_id")
def without_feature(spark, d):
    return ft.without_feature(fr.line_activations(spark, d), PROBE).groupBy("feature_id").agg(F.count("*").alias("n"))


@register("F5_at_least_percentile", "li", """
    , q AS (SELECT feature_id, quantile_cont(activation_value, 0.75) AS threshold FROM li GROUP BY feature_id)
    SELECT li.feature_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS tokens FROM li JOIN q ON q.feature_id = li.feature_id
    WHERE activation_value >= threshold GROUP BY li.feature_id""")
def at_least(spark, d):
    act = fr.line_activations(spark, d)
    cuts = ft.activation_quantile(act, 0.75, ["feature_id"])
    return lookup_join(act, cuts, "feature_id").where(F.col("activation_value") >= F.col("threshold")) \
        .groupBy("feature_id").agg(F.count("*").alias("n"), F.sum("token_id").alias("tokens"))


@register("F6_minimum_support", "active", "SELECT feature_id, count(*) AS num_activations FROM active GROUP BY feature_id HAVING count(*) >= 150")
def support(spark, d):
    return ft.with_minimum_support(ft.most_active_features(fr.active(spark, d)), 150)


@register("F7_index_range", "active", f"SELECT feature_id, count(*) AS n FROM active WHERE feature_id >= 0 AND feature_id < {fr.UNIVERSE} GROUP BY feature_id")
def index_range(spark, d):
    return ft.in_index_range(fr.active(spark, d), fr.UNIVERSE).groupBy("feature_id").agg(F.count("*").alias("n"))


SELECTIVITY = """
    SELECT feature_id, count(*) AS num_activations, avg(activation_value) AS mean_activation,
           count(DISTINCT token_id) AS unique_token_count,
           avg(activation_value) / log10(count(*) + 1) AS selectivity_score FROM {t} GROUP BY feature_id"""


@register("F8_display_frame", "active", f"""
    SELECT feature_id AS "Feature", num_activations AS "Activations", printf('%.4f', mean_activation) AS "Mean",
           printf('%.4f', selectivity_score) AS "Selectivity" FROM ({SELECTIVITY.format(t='active')})""")
def display(spark, d):
    return ft.display_frame(ft.rank_by_selectivity(fr.active(spark, d)), {
        "feature_id": "Feature", "num_activations": "Activations", "mean_activation": "Mean",
        "selectivity_score": "Selectivity"})


SELECTED = """, ranked AS (SELECT feature_id, avg(activation_value) / log10(count(*) + 1) AS score FROM active GROUP BY feature_id HAVING count(*) >= 10),
    selected AS ((SELECT feature_id, 'top-k' AS "group" FROM ranked ORDER BY score DESC, feature_id LIMIT 5)
                 UNION ALL (SELECT feature_id, 'bottom-k' AS "group" FROM ranked ORDER BY score, feature_id DESC LIMIT 5))"""


def selected(spark, d):
    return rp.select_features(fr.active(spark, d), 5)


@register("K3_head_and_tail", "active", SELECTED + 'SELECT feature_id, "group" FROM selected')
def head_and_tail(spark, d):
    return selected(spark, d)


@register("U1_union_of_groups", "active", SELECTED + 'SELECT "group", count(*) AS n, CAST(sum(feature_id) AS BIGINT) AS ids FROM selected GROUP BY "group"')
def union_groups(spark, d):
    return selected(spark, d).groupBy("group").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


@register("F10_group_column", "active", SELECTED + """
    SELECT a.feature_id, s."group", count(*) AS n FROM active a JOIN selected s ON s.feature_id = a.feature_id GROUP BY ALL""")
def group_column(spark, d):
    rows = ft.for_listed_features(fr.active(spark, d), selected(spark, d))
    return rows.groupBy("feature_id").agg(F.count("*").alias("n")).join(selected(spark, d), "feature_id")


# ---- aggregates -----------------------------------------------------------------------

@register("A1_most_active_features", "li", "SELECT feature_id, count(*) AS num_activations FROM li GROUP BY feature_id")
def most_active(spark, d):
    return ft.most_active_features(fr.line_activations(spark, d))


@register("A2_rank_selectivity", "li", f"""
    SELECT feature_id, num_activations, {R('mean_activation', 10)} AS mean_activation, unique_token_count,
           {R('selectivity_score', 10)} AS selectivity_score FROM ({SELECTIVITY.format(t='li')})""")
def rank_selectivity(spark, d):
    return rounded(ft.rank_by_selectivity(fr.line_activations(spark, d)), "mean_activation", "selectivity_score", digits=10)


@register("A3_feature_density", "li", f"""
    SELECT feature_id, {R('count(*) / (SELECT count(*) FROM li)', 10)} AS feature_density FROM li GROUP BY feature_id""")
def density(spark, d):
    return rounded(ft.feature_density(fr.line_activations(spark, d)), "feature_density", digits=10)


def distribution_sql(t, digits=6):
    return f"""
    SELECT feature_id, {R('avg(activation_value)', digits)} AS mean, {R('quantile_cont(activation_value, 0.5)', digits)} AS median,
           {R('stddev_samp(activation_value)', digits)} AS std, {R('quantile_cont(activation_value, 0.25)', digits)} AS p25,
           {R('quantile_cont(activation_value, 0.75)', digits)} AS p75, {R('max(activation_value)', digits)} AS max,
           count(*) AS count, count(DISTINCT token_id) AS unique_tokens FROM {t} GROUP BY feature_id"""


@register("A4_activation_distribution", "li", distribution_sql("li", 10))
def distribution(spark, d):
    return rounded(ft.distribution(fr.line_activations(spark, d)), "mean", "median", "std", "p25", "p75", "max", digits=10)


@register("A5_activation_stats", "active", distribution_sql("active") + f" HAVING feature_id = {PROBE}")
def stats(spark, d):
    rows = ft.for_feature(fr.active(spark, d), PROBE)
    return rounded(ft.distribution(rows), "mean", "median", "std", "p25", "p75", "max")


@register("A6_features_per_token", "li", """
    SELECT token_id, array_to_string(list(feature_id ORDER BY feature_id), ',') AS features_activated_by_token,
           count(*) AS num_features_activated_by_token FROM (SELECT DISTINCT token_id, feature_id FROM li) GROUP BY token_id""")
def per_token(spark, d):
    return joined(ft.features_per_token(fr.line_activations(spark, d)), "features_activated_by_token")


STRONG = """, strong AS (SELECT DISTINCT token_id FROM {t} WHERE feature_id = {p} AND activation_value >=
    (SELECT quantile_cont(activation_value, 0.75) FROM {t} WHERE feature_id = {p}))"""
COOC = STRONG + """, cooc AS (SELECT feature_id, count(*) AS co_occurrence_count,
        array_to_string(list(token_id ORDER BY token_id), ',') AS token_ids
    FROM (SELECT DISTINCT feature_id, token_id FROM {t} WHERE feature_id != {p} AND token_id IN (SELECT token_id FROM strong))
    GROUP BY feature_id)"""


@register("A7_co_occurring_features", "active", COOC.format(t="active", p=PROBE) + "SELECT * FROM cooc")
def co_occurring(spark, d):
    return joined(rel.co_occurring_features(fr.active(spark, d), PROBE), "token_ids")


@register("J3_strong_token_rows", "li", STRONG.format(t="li", p=PROBE) + """
    SELECT feature_id, count(*) AS n FROM li WHERE token_id IN (SELECT token_id FROM strong) GROUP BY feature_id""")
def strong_rows(spark, d):
    act = fr.line_activations(spark, d)
    return lookup_join(act, rel.strong_tokens(act, PROBE), "token_id", "left_semi") \
        .groupBy("feature_id").agg(F.count("*").alias("n"))


ALL_COOC = """, q AS (SELECT feature_id, quantile_cont(activation_value, 0.75) AS cut FROM {t} GROUP BY feature_id),
    s AS (SELECT DISTINCT {t}.feature_id, token_id FROM {t} JOIN q ON q.feature_id = {t}.feature_id WHERE activation_value >= cut),
    pr AS (SELECT DISTINCT feature_id, token_id FROM {t}),
    allcooc AS (SELECT CAST(s.feature_id AS BIGINT) AS source_feature_id, CAST(pr.feature_id AS BIGINT) AS feature_id, count(*) AS co_occurrence_count
                FROM s JOIN pr ON pr.token_id = s.token_id AND pr.feature_id != s.feature_id GROUP BY ALL)"""


@register("A7_co_occurrence_all_probes", "li", ALL_COOC.format(t="li") + "SELECT * FROM allcooc")
def co_occurrence_all(spark, d):
    return rel.co_occurrence_counts(fr.line_activations(spark, d))


@register("K4_top_co_occurring", "active", COOC.format(t="active", p=PROBE) + """
    SELECT feature_id, co_occurrence_count FROM cooc ORDER BY co_occurrence_count DESC, feature_id LIMIT 10""")
def top_co_occurring(spark, d):
    return rel.co_occurring_features(fr.active(spark, d), PROBE).orderBy(
        F.desc("co_occurrence_count"), "feature_id").limit(10).select("feature_id", "co_occurrence_count")


@register("A8_quantile", "li", f"""
    SELECT chunk_id, {R('quantile_cont(activation_value, 0.9)', 10)} AS threshold FROM li GROUP BY chunk_id""")
def quantile(spark, d):
    return rounded(ft.activation_quantile(fr.line_activations(spark, d), 0.9, ["chunk_id"]), "threshold", digits=10)


MAXIMA = ", m AS (SELECT feature_id, token_id, max(activation_value) AS a FROM {t} GROUP BY feature_id, token_id)"


@register("A9_token_maxima", "active", MAXIMA.format(t="active") + f"SELECT feature_id, token_id, {R('a')} AS activation FROM m")
def maxima(spark, d):
    return rounded(rel.token_maxima(fr.active(spark, d)), "activation")


@register("A10_token_norms", "li", MAXIMA.format(t="li") + f"SELECT feature_id, {R('sqrt(sum(a * a))')} AS norm FROM m GROUP BY feature_id")
def norms(spark, d):
    return rounded(rel.token_norms(rel.token_maxima(fr.line_activations(spark, d))), "norm")


COS = MAXIMA + """, nn AS (SELECT feature_id, sqrt(sum(a * a)) AS n FROM m GROUP BY feature_id),
    cosines AS (SELECT CAST(x.feature_id AS BIGINT) AS feature_i, CAST(y.feature_id AS BIGINT) AS feature_j,
                       sum(x.a * y.a) / (any_value(nx.n) * any_value(ny.n)) AS cosine_similarity
                FROM m x JOIN m y ON y.token_id = x.token_id AND x.feature_id < y.feature_id
                JOIN nn nx ON nx.feature_id = x.feature_id JOIN nn ny ON ny.feature_id = y.feature_id
                GROUP BY x.feature_id, y.feature_id)"""


@register("A11_cosine_similarity", "active", COS.format(t="active") + f"""
    SELECT {R('cosine_similarity')} AS cosine_similarity FROM cosines WHERE feature_i = {PROBE} AND feature_j = {OTHER}""")
def cosine(spark, d):
    return rounded(rel.cosine_similarity(fr.active(spark, d), PROBE, OTHER), "cosine_similarity")


COR = MAXIMA + """, mu AS (SELECT feature_id, avg(a) AS mean FROM m GROUP BY feature_id),
    c AS (SELECT m.feature_id, token_id, a - mean AS a FROM m JOIN mu ON mu.feature_id = m.feature_id),
    nn AS (SELECT feature_id, sqrt(sum(a * a)) AS n FROM c GROUP BY feature_id),
    cors AS (SELECT CAST(x.feature_id AS BIGINT) AS feature_i, CAST(y.feature_id AS BIGINT) AS feature_j,
                    sum(x.a * y.a) / (any_value(nx.n) * any_value(ny.n)) AS correlation
             FROM c x JOIN c y ON y.token_id = x.token_id AND x.feature_id < y.feature_id
             JOIN nn nx ON nx.feature_id = x.feature_id JOIN nn ny ON ny.feature_id = y.feature_id
             GROUP BY x.feature_id, y.feature_id)"""


@register("A12_correlation", "active", COR.format(t="active") + f"""
    SELECT {R('correlation')} AS correlation FROM cors WHERE feature_i = {PROBE} AND feature_j = {OTHER}""")
def correlation(spark, d):
    return rounded(rel.correlation(fr.active(spark, d), PROBE, OTHER), "correlation")


@register("A12_correlation_pairs", "active", COR.format(t="active") + f"""
    SELECT feature_i, feature_j, {R('correlation')} AS correlation FROM cors""")
def correlation_pairs(spark, d):
    return rounded(rel.correlation_pairs(fr.active(spark, d)), "correlation")


@register("A13_cosine_pairs", "li", COS.format(t="li") + f"""
    SELECT feature_i, feature_j, {R('cosine_similarity')} AS cosine_similarity FROM cosines""")
def cosine_pairs(spark, d):
    return rounded(rel.cosine_pairs(fr.line_activations(spark, d)), "cosine_similarity")


@register("A13_similarity_matrix", "active", COS.format(t="active") + SELECTED + f"""
    , ids AS (SELECT DISTINCT CAST(feature_id AS BIGINT) AS f FROM selected)
    SELECT a.f AS feature_i, b.f AS feature_j, {R('CASE WHEN a.f = b.f THEN 1.0::DOUBLE ELSE coalesce(c.cosine_similarity, 0) END')} AS cosine_similarity
    FROM ids a CROSS JOIN ids b LEFT JOIN cosines c ON c.feature_i = least(a.f, b.f) AND c.feature_j = greatest(a.f, b.f)""")
def matrix(spark, d):
    return rounded(rel.similarity_matrix(fr.active(spark, d), selected(spark, d)), "cosine_similarity")


@register("J4_shared_token_products", "active", MAXIMA.format(t="active") + f"""
    SELECT CAST(x.feature_id AS BIGINT) AS feature_i, CAST(y.feature_id AS BIGINT) AS feature_j, {R('sum(x.a * y.a)')} AS dot, count(*) AS shared
    FROM m x JOIN m y ON y.token_id = x.token_id AND x.feature_id <= y.feature_id GROUP BY ALL""")
def products(spark, d):
    return rounded(sparse_products(rel.token_maxima(fr.active(spark, d)), "token_id", "feature_id", "activation"), "dot")


@register("J5_centred_values", "active", MAXIMA.format(t="active") + f"""
    , mu AS (SELECT feature_id, avg(a) AS mean FROM m GROUP BY feature_id)
    SELECT m.feature_id, token_id, {R('a - mean')} AS centred FROM m JOIN mu ON mu.feature_id = m.feature_id""")
def centred(spark, d):
    m = rel.token_maxima(fr.active(spark, d))
    means = m.groupBy("feature_id").agg(F.avg("activation").alias("mean"))
    return rounded(lookup_join(m, means, "feature_id").select(
        "feature_id", "token_id", (F.col("activation") - F.col("mean")).alias("centred")), "centred")


# ---- dead units -----------------------------------------------------------------------

@register("J6_dead_in_table", "trimmed", f"SELECT CAST(i AS INTEGER) AS feature_id FROM range({fr.UNIVERSE}) r(i) WHERE i NOT IN (SELECT feature_id FROM trimmed)")
def dead_in_table(spark, d):
    return rel.dead_features(ac.strongest_per_sample(fr.active(spark, d)), fr.UNIVERSE)


@register("J6_dead_before_trim", "active", f"SELECT CAST(i AS INTEGER) AS feature_id FROM range({fr.UNIVERSE}) r(i) WHERE i NOT IN (SELECT feature_id FROM active)")
def dead_before(spark, d):
    return rel.dead_features(ac.alive_features(fr.active(spark, d)), fr.UNIVERSE)


@register("U3_set_difference", "trimmed", "SELECT feature_id FROM (SELECT DISTINCT feature_id FROM active EXCEPT SELECT DISTINCT feature_id FROM (SELECT feature_id FROM trimmed WHERE activation_value > 0.4::DOUBLE))")
def difference(spark, d):
    act = fr.active(spark, d)
    strong = ac.strongest_per_sample(act).where(F.col("activation_value") > 0.4)
    return act.select("feature_id").distinct().join(strong.select("feature_id").distinct(), "feature_id", "left_anti")


def unit_dead(spark, d):
    """Units that are not among the three strongest of any sample but their own."""
    model = fr.model(spark, d)
    stored = ae.encode(fr.samples(spark, d), model, 0.07, 4).where(F.col("feature_id") != F.col("sample_id"))
    return rel.dead_features(stored, model.size[0])


UNIT_DEAD = """, dead AS (SELECT feature_id FROM w WHERE feature_id NOT IN (SELECT feature_id FROM (
    SELECT sample_id, feature_id, row_number() OVER (PARTITION BY sample_id ORDER BY activation_value DESC, feature_id) AS rk
    FROM enc WHERE activation_value > CAST(0.07 AS DOUBLE)) WHERE rk <= 4 AND feature_id != sample_id))"""


@register("A15_dead_summary", "enc w", UNIT_DEAD + f"""
    SELECT count(*) AS dead_count, {R('count(*) / (SELECT count(*) FROM w)')} AS dead_proportion,
           (SELECT count(*) FROM w) - count(*) AS alive_count FROM dead""")
def dead_summary(spark, d):
    return rounded(rel.dead_summary(unit_dead(spark, d), fr.model(spark, d).size[0]), "dead_proportion")


@register("U4_tag_dead", "enc w", UNIT_DEAD + """
    SELECT feature_id, CASE WHEN feature_id IN (SELECT feature_id FROM dead) THEN 'dead' ELSE 'alive' END AS status FROM w""")
def tag_dead(spark, d):
    return rel.tag_dead(fr.weights(spark, d).select("feature_id"), unit_dead(spark, d))


PARTITION = """, gone AS (SELECT w.* FROM w WHERE feature_id IN (SELECT feature_id FROM dead)),
    live AS (SELECT w.* FROM w WHERE feature_id NOT IN (SELECT feature_id FROM dead))"""
NEAREST = PARTITION + """, near AS (
    SELECT a.feature_id, 'dead_alive' AS kind, max(list_dot_product(a.w, b.w)) AS similarity, arg_max(b.feature_id, list_dot_product(a.w, b.w)) AS nearest_id FROM gone a, live b GROUP BY a.feature_id
    UNION ALL SELECT a.feature_id, 'alive_alive', max(list_dot_product(a.w, b.w)), arg_max(b.feature_id, list_dot_product(a.w, b.w)) FROM live a, live b WHERE a.feature_id != b.feature_id GROUP BY a.feature_id)"""


def nearest(spark, d):
    return rel.nearest_alive(fr.weights(spark, d), unit_dead(spark, d))


@register("M3_similarity_block", "enc w", UNIT_DEAD + PARTITION + f"""
    SELECT CAST(a.feature_id AS BIGINT) AS left_id, CAST(b.feature_id AS BIGINT) AS right_id, {R('list_dot_product(a.w, b.w)')} AS dot FROM gone a, live b""")
def similarity_block(spark, d):
    w, gone = fr.weights(spark, d), settle(unit_dead(spark, d))
    return rounded(rel.similarity_block(w.join(gone, "feature_id", "left_semi"),
                                        w.join(gone, "feature_id", "left_anti")), "dot")


@register("J8_all_pairs", "w", f"""
    SELECT CAST(a.feature_id AS BIGINT) AS left_id, CAST(b.feature_id AS BIGINT) AS right_id, {R('list_dot_product(a.w, b.w)')} AS dot FROM w a, w b""")
def all_pairs(spark, d):
    w = fr.weights(spark, d)
    return rounded(rel.similarity_block(w, w), "dot")


@register("M4_nearest_neighbour", "enc w", UNIT_DEAD + NEAREST + f"""
    SELECT CAST(feature_id AS BIGINT) AS feature_id, kind, CAST(nearest_id AS BIGINT) AS nearest_id, {R('similarity')} AS similarity FROM near""")
def nearest_neighbour(spark, d):
    return rounded(nearest(spark, d), "similarity")


@register("A18_nearest_summary", "enc w", UNIT_DEAD + NEAREST + f"""
    SELECT kind, {R('avg(similarity)')} AS mean, {R('quantile_cont(similarity, 0.5)')} AS median,
           {R('stddev_pop(similarity)')} AS std, {R('max(similarity)')} AS max FROM near GROUP BY kind""")
def nearest_summary(spark, d):
    return rounded(rel.nearest_summary(nearest(spark, d)), "mean", "median", "std", "max")


@register("A22_near_duplicates", "enc w", UNIT_DEAD + NEAREST + f"""
    SELECT count(*) FILTER (similarity > 0.4::DOUBLE) AS duplicate_count,
           {R('100.0::DOUBLE * count(*) FILTER (similarity > 0.4::DOUBLE) / count(*)')} AS duplicate_percent FROM near WHERE kind = 'alive_alive'""")
def near_duplicates(spark, d):
    return rounded(rel.near_duplicates(nearest(spark, d), 0.4), "duplicate_percent")


@register("A21_fixed_edge_histogram", "enc w", UNIT_DEAD + NEAREST + f"""
    , h AS (SELECT kind, least(78, CAST(floor((similarity + 0.3::DOUBLE) / (1.0::DOUBLE - -0.3::DOUBLE) * 79) AS INTEGER)) AS bin, count(*) AS n
            FROM near WHERE similarity BETWEEN -0.3::DOUBLE AND 1.0::DOUBLE GROUP BY ALL),
    t AS (SELECT kind, sum(n) AS total FROM h GROUP BY kind)
    SELECT t.kind, CAST(b.i AS INTEGER) AS bin, {R('-0.3::DOUBLE + b.i * (1.3::DOUBLE / 79)')} AS bin_start, coalesce(h.n, 0) AS n,
           {R('coalesce(h.n, 0) / (t.total * (1.3::DOUBLE / 79))')} AS density
    FROM t CROSS JOIN range(79) b(i) LEFT JOIN h ON h.kind = t.kind AND h.bin = b.i""")
def fixed_histogram(spark, d):
    return rounded(rp.fixed_edge_histogram(nearest(spark, d), "similarity", by=["kind"]), "bin_start", "density")


def histogram_sql(t, v, bins, by):
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"r.{by} = e.{by}" if by else "true"
    return f"""
    , e0 AS (SELECT {g} min({v}) AS a, max({v}) AS b FROM {t} {group}),
    e AS (SELECT {g} CASE WHEN a = b THEN a - 0.5::DOUBLE ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5::DOUBLE ELSE b END AS hi FROM e0),
    h AS (SELECT {'r.' + by + ', ' if by else ''} least({bins - 1}, CAST(floor(({v} - lo) / (hi - lo) * {bins}) AS INTEGER)) AS bin, count(*) AS n
          FROM {t} r JOIN e ON {on} GROUP BY ALL)
    SELECT {'e.' + by + ', ' if by else ''} CAST(g.i AS INTEGER) AS bin, {R(f'lo + g.i * ((hi - lo) / {bins})')} AS bin_start,
           {R(f'lo + (g.i + 1) * ((hi - lo) / {bins})')} AS bin_end, coalesce(h.n, 0) AS n
    FROM e CROSS JOIN range({bins}) g(i) LEFT JOIN h ON h.bin = g.i {f'AND h.{by} = e.{by}' if by else ''}"""


@register("A20_histogram_per_feature", "li", histogram_sql("li", "activation_value", 30, "feature_id"))
def histogram_per_feature(spark, d):
    return rounded(rp.equal_width_histogram(fr.line_activations(spark, d), bins=30, by=["feature_id"]),
                   "bin_start", "bin_end")


@register("A20_histogram", "active", histogram_sql("active", "activation_value", 50, ""))
def histogram(spark, d):
    return rounded(rp.equal_width_histogram(fr.active(spark, d)), "bin_start", "bin_end")


@register("A23_any_value_of_norm", "active", MAXIMA.format(t="active") + f"""
    , nn AS (SELECT feature_id, sqrt(sum(a * a)) AS n FROM m GROUP BY feature_id)
    SELECT m.feature_id, count(*) AS tokens, {R('any_value(n)')} AS norm FROM m JOIN nn ON nn.feature_id = m.feature_id GROUP BY m.feature_id""")
def any_norm(spark, d):
    m = rel.token_maxima(fr.active(spark, d))
    return rounded(lookup_join(m, rel.token_norms(m), "feature_id").groupBy("feature_id").agg(
        F.count("*").alias("tokens"), F.any_value("norm").alias("norm")), "norm")


# ---- top rows -------------------------------------------------------------------------

def top_sql(order, limit):
    return f"""
    SELECT feature_id, sample_id, {R('activation_value')} AS activation_value FROM act WHERE feature_id = {PROBE}
    ORDER BY activation_value {order}, sample_id LIMIT {limit}"""


@register("K1_top_activations", "act", top_sql("DESC", K))
def top(spark, d):
    return rounded(ft.top_activations(fr.activations(spark, d), PROBE, K).select(
        "feature_id", "sample_id", "activation_value"), "activation_value")


@register("K1_lowest_activations", "act", top_sql("ASC", K))
def lowest(spark, d):
    return rounded(ft.top_activations(fr.activations(spark, d), PROBE, K, "ascending").select(
        "feature_id", "sample_id", "activation_value"), "activation_value")


@register("K1_top_per_feature", "li", f"""
    SELECT feature_id, CAST(rk AS INTEGER) AS rank, token_id, chunk_id, {R('activation_value')} AS activation_value FROM (
        SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, token_id, chunk_id) AS rk FROM li) WHERE rk <= {K}""")
def top_per_feature(spark, d):
    return rounded(ft.top_activations_per_feature(fr.line_activations(spark, d), K, tie=("token_id", "chunk_id")).select(
        "feature_id", "rank", "token_id", "chunk_id", "activation_value"), "activation_value")


@register("K2_ranking_order", "li", """
    SELECT feature_id, CAST(row_number() OVER (ORDER BY num_activations DESC, feature_id) AS INTEGER) AS position FROM (
        SELECT feature_id, count(*) AS num_activations FROM li GROUP BY feature_id)""")
def ranking_order(spark, d):
    ranking = ft.most_active_features(fr.line_activations(spark, d))
    return number_rows(ranking, [F.desc("num_activations"), "feature_id"], name="at").select(
        "feature_id", (F.col("at") + 1).cast("int").alias("position"))


@register("K5_strongest_rows", "li", f"""
    SELECT feature_id, count(*) AS n, {R('sum(activation_value)', 10)} AS total, {R('min(activation_value)', 10)} AS lowest FROM (
        SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC) AS rk FROM li) WHERE rk <= 200 GROUP BY feature_id""")
def strongest_rows(spark, d):
    rows = ft.top_activations_per_feature(fr.line_activations(spark, d), 200, tie=("token_id", "chunk_id"))
    return rounded(rows.groupBy("feature_id").agg(
        F.count("*").alias("n"), F.sum("activation_value").alias("total"),
        F.min("activation_value").alias("lowest")), "total", "lowest", digits=10)


@register("K6_first_rows", "active", f"""
    SELECT feature_id, sample_id, {R('activation_value')} AS activation_value FROM active ORDER BY feature_id, activation_value, sample_id LIMIT 20""")
def first_rows(spark, d):
    return rounded(ft.first_rows(fr.active(spark, d), 20, ("sample_id",)).select(
        "feature_id", "sample_id", "activation_value"), "activation_value")


NATURAL_KEY = r"""list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'),
    lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(CAST(length(regexp_replace(p, '^0+', '')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+', '')
                   ELSE lower(p) END)"""


@register("D12_natural_key", "", f"""
    SELECT page_id, array_to_string({NATURAL_KEY}, '~') AS key FROM pages""")
def natural_key(spark, d):
    return fr.read(spark, d, "pages").select("page_id", F.array_join(X.natural_key(F.col("url")), "~").alias("key"))


@register("K7_natural_sort", "files", """
    SELECT file, CAST(regexp_extract(file, '[0-9]+') AS BIGINT) AS number, CAST(row_number() OVER (ORDER BY
        lower(regexp_extract(file, '^[A-Za-z_]+')), CAST(regexp_extract(file, '[0-9]+') AS BIGINT),
        lower(regexp_extract(file, '[a-z]*[.]pt$')), file) - 1 AS INTEGER) AS chunk_index FROM files""")
def natural_sort(spark, d):
    return sp.natural_order(fr.chunk_files(spark, d)).select(
        "file", F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("number"), "chunk_index")


# ---- text -----------------------------------------------------------------------------

@register("J1_token_text", "active vocab", """
    SELECT a.sample_id, a.feature_id, v.token_text FROM active a JOIN vocab v ON v.token_id = a.token_id""")
def token_text(spark, d):
    return tx.with_token_text(fr.active(spark, d), fr.vocab(spark), fr.VOCAB_SIZE).select(
        "sample_id", "feature_id", "token_text")


CTX_TEXT = """, texts AS (SELECT c.sample_id, list(v.token_text ORDER BY c.i) AS context_text FROM (
        SELECT sample_id, unnest(range(21)) AS i, unnest(context_token_ids) AS token_id FROM ctx) c
    JOIN vocab v ON v.token_id = c.token_id GROUP BY c.sample_id)"""


@register("J2_context_text", "act vocab", CTX_TEXT + """
    SELECT a.sample_id, a.feature_id, array_to_string(t.context_text, '|') AS context_text
    FROM act a LEFT JOIN texts t ON t.sample_id = a.sample_id""")
def context_text(spark, d):
    out = tx.with_context_text(fr.activations(spark, d), fr.vocab(spark), fr.VOCAB_SIZE)
    return joined(out.select("sample_id", "feature_id", "context_text"), "context_text", sep="|")


@register("J2_context_text_joined", "act vocab", CTX_TEXT + """
    SELECT a.sample_id, a.feature_id, array_to_string(t.context_text, '|') AS context_text
    FROM act a LEFT JOIN texts t ON t.sample_id = a.sample_id""")
def context_text_joined(spark, d):
    out = tx.with_context_text(fr.activations(spark, d), fr.vocab(spark))
    return joined(out.select("sample_id", "feature_id", "context_text"), "context_text", sep="|")


STRINGS = CTX_TEXT + """, strs AS (SELECT a.sample_id, a.feature_id, a.activation_value, v.token_text, t.context_text,
        array_to_string(list_transform(list_zip(t.context_text, range(len(t.context_text))),
            lambda z: CASE WHEN z[2] = 10 THEN '**' || v.token_text || '**' ELSE z[1] END), '') AS context_string,
        array_to_string(t.context_text[1:10], '') || v.token_text || array_to_string(t.context_text[12:], '') AS token_joined_context,
        CAST(length(array_to_string(t.context_text[1:10], '')) AS INTEGER) AS char_offset
    FROM act a JOIN vocab v ON v.token_id = a.token_id LEFT JOIN texts t ON t.sample_id = a.sample_id)"""


def texts(spark, d):
    rows = tx.with_token_text(fr.activations(spark, d), fr.vocab(spark), fr.VOCAB_SIZE)
    return tx.with_context_text(rows, fr.vocab(spark), fr.VOCAB_SIZE)


@register("D1_context_string", "act vocab", STRINGS + "SELECT sample_id, feature_id, context_string FROM strs")
def context_string(spark, d):
    return tx.with_context_string(texts(spark, d)).select("sample_id", "feature_id", "context_string")


@register("D2_joined_context", "act vocab", STRINGS + "SELECT sample_id, feature_id, token_joined_context FROM strs")
def joined_context(spark, d):
    return tx.with_joined_context(texts(spark, d)).select("sample_id", "feature_id", "token_joined_context")


@register("D3_char_offset", "act vocab", STRINGS + "SELECT sample_id, feature_id, char_offset FROM strs")
def char_offset(spark, d):
    return texts(spark, d).select("sample_id", "feature_id", X.char_offset(F.col("context_text"), 10).alias("char_offset"))


STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
S = STRIP.format(t="token_text")
FLAGS = f"""
    CASE WHEN starts_with(token_text, ' ') THEN 'word_initial' ELSE 'word_medial' END AS subword_position,
    regexp_matches({S}, '^\\p{{Nd}}+$') AS is_numeric,
    ({S} = upper({S}) AND {S} != lower({S}) AND length({S}) > 1) AS is_upper,
    regexp_matches({S}, '^[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]*[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*([^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*)*[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]*$') AS is_title,
    {S} = '' AS is_whitespace, regexp_matches({S}, '^\\p{{P}}+$') AS is_punct"""


#: The word that covers the token's offset, and whether it is punctuation.
AFTER = "substr(token_joined_context, char_offset + 1)"
COVER = f"""CASE WHEN regexp_matches({AFTER}, '^[\\p{{L}}\\p{{N}}]')
    THEN regexp_extract(substr(token_joined_context, 1, char_offset), '[\\p{{L}}\\p{{N}}]*$') || regexp_extract({AFTER}, '^[\\p{{L}}\\p{{N}}]+')
    WHEN regexp_matches({AFTER}, '^\\S') THEN substr({AFTER}, 1, 1) END"""
COVERED = FLAGS.rpartition(", regexp")[0] + f""", coalesce(regexp_matches({COVER}, '^\\p{{P}}+$'), false) AS is_punct"""


@register("D4_D8_token_flags", "dict", f"SELECT token_text, {FLAGS} FROM dict")
def token_flags(spark, d):
    t = F.col("token_text")
    words = word_rows(spark, d).select(F.col("word").alias("token_text")).distinct()
    return words.select("token_text", X.subword_position(t).alias("subword_position"), X.is_numeric(t).alias("is_numeric"),
                        X.is_upper(t).alias("is_upper"), X.is_title(t).alias("is_title"),
                        X.is_whitespace(t).alias("is_whitespace"), X.is_punct(t).alias("is_punct"))


@register("D9_classify_tokens", "act vocab", STRINGS + f"""
    SELECT sample_id, feature_id, 'X' AS pos, 'O' AS ner, '' AS dep, coalesce(lower({COVER}) IN ('w1', 'w3', 'w5'), false) AS is_stop, {COVERED},
    char_offset FROM strs""")
def classify(spark, d):
    stop = fr.vocab(spark).where(F.col("token_id").isin(1, 3, 5)).select(F.col("token_text").alias("word"))
    return tx.classify_tokens(texts(spark, d), stop_words=stop).select(
        "sample_id", "feature_id", "pos", "ner", "dep", "is_stop", "subword_position", "is_numeric", "is_upper",
        "is_title", "is_whitespace", "is_punct", "char_offset")


def tag_by_shape(batches):
    """Small stand-in for a language model tagger."""
    for pdf in batches:
        digits = pdf["token_text"].str.strip().str.isdigit()
        yield pdf.assign(pos=digits.map({True: "NUM", False: "NOUN"}),
                         dep=[t[o:o + 1] for t, o in zip(pdf["token_joined_context"], pdf["char_offset"])])


@register("X4_tagger", "act vocab", STRINGS + f"""
    SELECT sample_id, feature_id, CASE WHEN regexp_matches({S}, '^[0-9]+$') THEN 'NUM' ELSE 'NOUN' END AS pos,
           substr(token_joined_context, char_offset + 1, 1) AS dep FROM strs""")
def tagger(spark, d):
    return tx.classify_tokens(texts(spark, d), tagger=tag_by_shape).select("sample_id", "feature_id", "pos", "dep")


PROPERTIES = ("pos", "ner", "is_stop", "is_punct", "dep", "subword_position", "is_numeric", "is_upper", "is_title", "is_whitespace")
BREAKDOWN = STRINGS + f""", best AS (SELECT feature_id, token_text, 'X' AS pos, 'O' AS ner, '' AS dep, false AS is_stop, {COVERED} FROM (
        SELECT s.*, rk FROM (SELECT sample_id, feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, sample_id) AS rk
            FROM act) r JOIN strs s ON s.sample_id = r.sample_id AND s.feature_id = r.feature_id) WHERE rk <= {{n}}),
    brk AS ({' UNION ALL '.join(f"SELECT feature_id, '{p}' AS property, CAST({p} AS VARCHAR) AS value FROM best" for p in PROPERTIES)})"""


@register("A14_token_type_breakdown", "act vocab", BREAKDOWN.replace("{n}", "1000") + """
    SELECT feature_id, property, value, count(*) AS count FROM brk GROUP BY ALL""")
def breakdown(spark, d):
    return tx.token_type_breakdown(fr.activations(spark, d), fr.vocab(spark), vocab_size=fr.VOCAB_SIZE)


TOP_STRINGS = STRINGS + """, tops AS (SELECT * FROM (SELECT s.*, a.rk AS rank FROM strs s JOIN (
        SELECT sample_id, feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, sample_id) AS rk FROM act) a
        ON a.sample_id = s.sample_id AND a.feature_id = s.feature_id) WHERE rank <= {k})"""


@register("K8_top_contexts", "act vocab", TOP_STRINGS.format(k=K) + f"""
    SELECT sample_id, {R('activation_value')} AS activation_value, token_text, context_string FROM tops WHERE feature_id = {PROBE}""")
def top_contexts(spark, d):
    out = tx.top_contexts(fr.activations(spark, d), PROBE, fr.vocab(spark), K, vocab_size=fr.VOCAB_SIZE)
    return rounded(out.select("sample_id", "activation_value", "token_text", "context_string"), "activation_value")


@register("K8_top_contexts_all_features", "act vocab", TOP_STRINGS.format(k=K) + f"""
    SELECT feature_id, CAST(rank AS INTEGER) AS rank, sample_id, {R('activation_value')} AS activation_value, token_text, context_string FROM tops""")
def top_contexts_all(spark, d):
    out = top_strings(spark, d, K)
    return rounded(out.select("feature_id", "rank", "sample_id", "activation_value", "token_text", "context_string"),
                   "activation_value")


def top_strings(spark, d, k):
    return tx.top_contexts_per_feature(fr.activations(spark, d), fr.vocab(spark), k, vocab_size=fr.VOCAB_SIZE)


PROMPT_HEAD, PROMPT_TAIL = tx.PROMPT.split("{contexts}")
PROMPTS = TOP_STRINGS.format(k=K) + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY rank) AS i FROM tops),
    prompts AS (SELECT feature_id, '{PROMPT_HEAD.replace("'", "''")}' ||
        string_agg(i || '. ' || context_string, chr(10) ORDER BY i) || '{PROMPT_TAIL.replace("'", "''")}' AS prompt, count(*) AS lines,
        first(token_text ORDER BY i) AS token FROM numbered GROUP BY feature_id)"""


@register("D10_prompts", "act vocab", PROMPTS + "SELECT feature_id, prompt FROM prompts")
def prompts(spark, d):
    return tx.prompts(top_strings(spark, d, K))


def label_by_first_line(batches):
    """Small stand-in for a language model: names the first marked token."""
    for pdf in batches:
        yield pd.DataFrame({"feature_id": pdf["feature_id"], "reply": [
            f"{p.count(chr(10))} lines read\nLabel: {p.split('**')[3]}" for p in pdf["prompt"]]})


@register("X5_label_features", "act vocab", PROMPTS + f"""
    SELECT t.feature_id, t.sample_id, {STRIP.format(t='p.token')} AS llm_label, (p.lines + 1) || ' lines read' AS llm_reasoning
    FROM tops t JOIN prompts p ON p.feature_id = t.feature_id""")
def label_features(spark, d):
    out = tx.label_features(top_strings(spark, d, K), label_by_first_line)
    return out.select("feature_id", "sample_id", "llm_label", "llm_reasoning")


OFFLINE = TOP_STRINGS.format(k=25) + f""", labelled AS (SELECT feature_id, {STRIP.format(t='token_text')} AS llm_label FROM (
        SELECT feature_id, token_text, row_number() OVER (PARTITION BY feature_id ORDER BY count(*) DESC, token_text) AS rk
        FROM tops GROUP BY feature_id, token_text) WHERE rk = 1)"""


@register("X5_offline_labels", "act vocab", OFFLINE + """
    SELECT t.feature_id, t.sample_id, l.llm_label FROM tops t JOIN labelled l ON l.feature_id = t.feature_id""")
def offline_labels(spark, d):
    return tx.label_features(top_strings(spark, d, 25)).select("feature_id", "sample_id", "llm_label")


REPLY_PARSE = r""", lines AS (SELECT conv_id, turn, "group", reply, list_filter(string_split_regex(regexp_replace(reply, '^\s+|\s+$', '', 'g'), '\r\n|[\n\r]'),
        lambda l: starts_with(lower(regexp_replace(l, '^\s+|\s+$', '', 'g')), 'label:'))[-1] AS line FROM replies),
    parsed AS (SELECT conv_id, turn, "group", regexp_replace(CASE WHEN line IS NULL THEN reply ELSE substr(line, instr(line, ':') + 1) END, '^\s+|\s+$', '', 'g') AS llm_label,
        CASE WHEN line IS NULL THEN '' ELSE regexp_replace(substr(reply, 1, length(reply) - (instr(reverse(reply), reverse(line)) - 1) - length(line)), '^\s+|\s+$', '', 'g') END AS llm_reasoning
    FROM lines)"""


@register("D11_parse_replies", "replies", REPLY_PARSE + "SELECT conv_id, turn, llm_label, llm_reasoning FROM parsed")
def parse_replies(spark, d):
    return tx.parse_replies(fr.replies(spark, d)).select("conv_id", "turn", "llm_label", "llm_reasoning")


@register("A16_monosemanticity", "replies", REPLY_PARSE + f"""
    SELECT CASE WHEN grouping("group") = 1 THEN 'overall' ELSE "group" END AS "group", count(*) AS total_count,
           count(*) FILTER (contains(upper(llm_label), 'POLYSEMANTIC')) AS polysemantic_count,
           {R("1 - count(*) FILTER (contains(upper(llm_label), 'POLYSEMANTIC')) / count(*)")} AS monosemanticity_rate
    FROM parsed GROUP BY ROLLUP ("group")""")
def monosemanticity(spark, d):
    return rounded(rp.monosemanticity(tx.parse_replies(fr.replies(spark, d))), "monosemanticity_rate")


@register("D13_alive_file_name", "", """
    SELECT page_id, 'alive_features_' || replace(string_split(url, '/')[-1], '?page=', '') || '.json' AS file FROM pages""")
def alive_file(spark, d):
    return fr.read(spark, d, "pages").select("page_id", X.alive_file_name(F.col("url"), "?page=").alias("file"))


@register("D14_short_label", "replies", REPLY_PARSE + """
    SELECT conv_id, turn, CASE WHEN length(llm_label) > 40 THEN substr(llm_label, 1, 40) || '...' ELSE llm_label END AS title,
           CASE WHEN length(llm_label) > 20 THEN substr(llm_label, 1, 20) || '...' ELSE llm_label END AS short FROM parsed""")
def short_label(spark, d):
    label = F.col("llm_label")
    return tx.parse_replies(fr.replies(spark, d)).select(
        "conv_id", "turn", X.short_label(label, 40).alias("title"), X.short_label(label, 20).alias("short"))


@register("D15_table_name", "", """
    SELECT part.p_partkey, 'hf_' || p_size || 'x_' || replace(CAST(round(p_retailprice, 2) AS VARCHAR), '.', '_') || '_full' AS name FROM part""")
def table_name(spark, d):
    price = F.round("p_retailprice", 2).cast("string")
    return fr.read(spark, d, "part").select("p_partkey", X.table_name(F.col("p_size"), price).alias("name"))


@register("D17_is_polysemantic", "replies", REPLY_PARSE + "SELECT conv_id, turn, contains(upper(llm_label), 'POLYSEMANTIC') AS polysemantic FROM parsed")
def polysemantic(spark, d):
    return tx.parse_replies(fr.replies(spark, d)).select("conv_id", "turn", X.is_polysemantic(F.col("llm_label")).alias("polysemantic"))


@register("D18_math", "", f"""
    SELECT event_id, {R('(value - 10) * (value - 10)')} AS square, {R('sqrt(value)')} AS root, {R('log10(value + 1)')} AS log,
           {R('abs(value - 10)')} AS absolute, {R('greatest(value - 10, 0)')} AS relu FROM events""")
def math(spark, d):
    v = F.col("value")
    return rounded(fr.read(spark, d, "events").select(
        "event_id", F.pow(v - 10, 2).alias("square"), F.sqrt(v).alias("root"), F.log10(v + 1).alias("log"),
        F.abs(v - 10).alias("absolute"), F.greatest(v - 10, F.lit(0.0)).alias("relu")),
        "square", "root", "log", "absolute", "relu")


# ---- windows, comparison --------------------------------------------------------------

@register("W1_rank_within_sample", "active", """
    SELECT sample_id, feature_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY activation_value DESC, feature_id) AS INTEGER) AS rank FROM active""")
def rank_in_sample(spark, d):
    return top_k(fr.active(spark, d), "sample_id", [F.desc("activation_value"), F.col("feature_id")], None).select(
        "sample_id", "feature_id", "rank")


@register("W2_row_frame", "ctx", "SELECT sample_id, array_to_string(context_token_ids[8:14], ',') AS context FROM ctx")
def row_frame(spark, d):
    out = ac.context_windows(fr.samples(spark, d), 3)
    return joined(out.select("sample_id", F.col("context_token_ids").alias("context")), "context")


@register("W3_smoothed_losses", "losses", f"""
    , x AS (SELECT split, step, loss, count(*) OVER (PARTITION BY split) AS n,
                   list(loss) OVER (PARTITION BY split ORDER BY step ROWS 49 PRECEDING) AS l FROM losses),
    y AS (SELECT *, CASE WHEN split = 'train' AND n > 50 THEN least(50, n // 10) WHEN split != 'train' AND n > 10 THEN least(10, n // 5) END AS win FROM x)
    SELECT split, step, round(loss, 10) AS loss, CAST(win AS INTEGER) AS window,
           round(list_avg(list_slice(l, greatest(len(l) - win + 1, 1), len(l))), 10) AS smoothed FROM y""")
def smoothed(spark, d):
    return rounded(rp.smoothed_losses(fr.losses(spark, d)), "loss", "smoothed", digits=10)


@register("A17_loss_statistics", "losses", f"""
    SELECT s.split, count(loss) AS num_batches, coalesce({R('avg(loss)', 10)}, 'nan'::DOUBLE) AS mean, coalesce({R('stddev_pop(loss)', 10)}, 'nan'::DOUBLE) AS std,
           coalesce({R('min(loss)', 10)}, 'nan'::DOUBLE) AS min, coalesce({R('max(loss)', 10)}, 'nan'::DOUBLE) AS max,
           coalesce({R('quantile_cont(loss, 0.5)', 10)}, 'nan'::DOUBLE) AS median
    FROM (SELECT unnest(['train', 'val', 'test', 'held_out']) AS split) s LEFT JOIN losses l ON l.split = s.split GROUP BY s.split""")
def loss_statistics(spark, d):
    return rounded(rp.loss_statistics(fr.losses(spark, d), ("train", "val", "test", "held_out"), 10),
                   "mean", "std", "min", "max", "median", digits=10)


@register("D16_rounded_statistics", "losses", f"""
    SELECT split, round(min(loss), 4) + 0.0 AS min, round(max(loss), 4) + 0.0 AS max FROM losses GROUP BY split""")
def rounded_statistics(spark, d):
    return rounded(rp.loss_statistics(fr.losses(spark, d), decimals=4).select("split", "min", "max"), "min", "max", digits=4)


@register("U5_row_counts", "trimmed", "SELECT (SELECT count(*) FROM active) AS count_a, (SELECT count(*) FROM trimmed) AS count_b")
def row_counts(spark, d):
    act = fr.active(spark, d)
    return cp.row_counts(act, ac.strongest_per_sample(act))


FIRST20 = "(SELECT feature_id, activation_value FROM {t} ORDER BY feature_id, activation_value LIMIT 20)"


@register("U6_same_first_rows", "trimmed", f"""
    SELECT count(*) = 0 AS identical FROM ((SELECT * FROM {FIRST20.format(t='active')} EXCEPT ALL SELECT * FROM {FIRST20.format(t='trimmed')})
        UNION ALL (SELECT * FROM {FIRST20.format(t='trimmed')} EXCEPT ALL SELECT * FROM {FIRST20.format(t='active')}))""")
def same_first_rows(spark, d):
    act = fr.active(spark, d)
    return cp.same_first_rows(act, ac.strongest_per_sample(act))


@register("U7_same_weights", "w", "SELECT bool_and(w = list_transform(w, lambda x: x * 1.0::DOUBLE)) AS identical FROM w")
def same_weights(spark, d):
    w = fr.weights(spark, d)
    return cp.same_weights(w, w.withColumn("w_enc", F.col("w_dec")))


# ---- report ---------------------------------------------------------------------------

SUMMARY = OFFLINE + SELECTED + f""", st AS ({distribution_sql('active')}),
    summary AS (SELECT s.feature_id, s."group", l.llm_label, st.mean AS mean_activation, st.median AS median_activation, st.std AS std_activation, st.unique_tokens
                FROM selected s JOIN st ON st.feature_id = s.feature_id LEFT JOIN labelled l ON l.feature_id = s.feature_id)"""


def summary(spark, d):
    labels = tx.feature_labels(tx.label_features(top_strings(spark, d, 25)))
    return rp.batch_summary(fr.active(spark, d), selected(spark, d), labels)


@register("A24_batch_summary", "act vocab", SUMMARY + "SELECT * FROM summary")
def batch_summary(spark, d):
    return rounded(summary(spark, d), "mean_activation", "median_activation", "std_activation")


@register("J7_summary_with_density", "act vocab", SUMMARY + f"""
    SELECT s.feature_id, s."group", {R('d.n / (SELECT count(*) FROM active)')} AS feature_density FROM summary s
    LEFT JOIN (SELECT feature_id, count(*) AS n FROM active GROUP BY feature_id) d ON d.feature_id = s.feature_id""")
def summary_density(spark, d):
    return rounded(rp.with_density(summary(spark, d), fr.active(spark, d)).select(
        "feature_id", "group", "feature_density"), "feature_density")


@register("S17_report_top_activations", "act vocab", OFFLINE + SELECTED + f"""
    SELECT t.feature_id, t.sample_id, {R('t.activation_value')} AS activation_value, t.context_string, l.llm_label, s."group"
    FROM tops t JOIN labelled l ON l.feature_id = t.feature_id JOIN selected s ON s.feature_id = t.feature_id""")
def report_top(spark, d):
    out = rp.report_top_activations(fr.activations(spark, d), selected(spark, d), fr.vocab(spark), vocab_size=fr.VOCAB_SIZE)
    return rounded(out.select("feature_id", "sample_id", "activation_value", "context_string", "llm_label", "group"),
                   "activation_value")


@register("S17_report_co_occurrence", "active", ALL_COOC.format(t="active") + SELECTED + """
    SELECT c.source_feature_id, c.feature_id, c.co_occurrence_count, s."group"
    FROM allcooc c JOIN selected s ON s.feature_id = c.source_feature_id""")
def report_co_occurrence(spark, d):
    return rp.report_co_occurrence(fr.active(spark, d), selected(spark, d))


@register("U2_concat_per_feature", "active", ALL_COOC.format(t="active") + SELECTED + """
    SELECT s."group", count(*) AS n, CAST(sum(c.co_occurrence_count) AS BIGINT) AS total
    FROM allcooc c JOIN selected s ON s.feature_id = c.source_feature_id GROUP BY s."group" """)
def concat_per_feature(spark, d):
    out = rp.report_co_occurrence(fr.active(spark, d), selected(spark, d))
    return out.groupBy("group").agg(F.count("*").alias("n"), F.sum("co_occurrence_count").alias("total"))


@register("S17_report_breakdown", "act vocab", BREAKDOWN.replace("{n}", "1000") + SELECTED + """
    SELECT b.feature_id, s."group", property, value, count(*) AS count FROM brk b JOIN selected s ON s.feature_id = b.feature_id GROUP BY ALL""")
def report_breakdown(spark, d):
    return rp.report_breakdown(fr.activations(spark, d), selected(spark, d), fr.vocab(spark), vocab_size=fr.VOCAB_SIZE)


@register("S17_report_dead", "enc w", UNIT_DEAD + "SELECT feature_id FROM dead")
def report_dead(spark, d):
    return unit_dead(spark, d)


@register("X6_all_features_at_once", "active", f"""
    , st AS ({distribution_sql('active')}),
    best AS (SELECT feature_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation_value DESC, sample_id) AS rk FROM active) WHERE rk = 1)
    SELECT st.feature_id, st.mean, st.median, st.count, b.sample_id AS best_sample FROM st JOIN best b ON b.feature_id = st.feature_id""")
def all_features(spark, d):
    act = fr.active(spark, d)
    best = ft.top_activations_per_feature(act, 1).select("feature_id", F.col("sample_id").alias("best_sample"))
    return rounded(ft.distribution(act).select("feature_id", "mean", "median", "count").join(best, "feature_id"), "mean", "median")


@register("X2_sample_transform", "samples", f"""
    SELECT sample_id, {R('sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) * 2')} AS norm FROM samples""")
def sample_transform(spark, d):
    doubled = fr.samples(spark, d).transform(lambda df: df.withColumn("vec", V.scaled(F.col("vec"), F.lit(2.0))))
    return rounded(doubled.select("sample_id", V.norm(F.col("vec")).alias("norm")), "norm")


@register("X7_memoised_counts", "active", "SELECT feature_id, count(*) AS n FROM active GROUP BY feature_id")
def memoised(spark, d):
    return memoise(fr.active(spark, d).groupBy("feature_id").agg(F.count("*").alias("n")))
