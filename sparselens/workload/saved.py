"""Queries that read back what was committed: finished chunks and saved reports."""

from pyspark.sql import functions as F

from sparselens.operators import activations as ac
from sparselens.operators import report as rp
from sparselens.sources import commits as cm
from sparselens.workload import frames as fr
from sparselens.workload.analysis import ALL_COOC, BREAKDOWN, OFFLINE, SELECTED, STRINGS, histogram_sql
from sparselens.workload.extraction import R, fresh
from sparselens.workload.registry import register, rounded

FEW = 0.35  # so high that chunks without any row occur


@register("S13_finished_chunks", "samples", f"""
    SELECT s.chunk_id, count(v) AS n FROM (SELECT chunk_id, unnest(vec) AS v FROM samples) s0
    RIGHT JOIN (SELECT DISTINCT chunk_id FROM samples) s ON s0.chunk_id = s.chunk_id AND CAST(v AS DOUBLE) > {FEW}
    GROUP BY s.chunk_id""")
def finished(spark, d):
    """Rows of each finished chunk; those without a row are finished as well."""
    rows, path = fr.samples(spark, d), fresh(spark, "chunks")
    cm.resume(rows, lambda todo: ac.active_entries(todo, FEW), path)
    counts = cm.read_finished(spark, path).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return cm.finished_chunks(spark, path).join(counts, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n"))


@register("S13_resumed_extraction", "active", f"""
    SELECT sample_id, chunk_id, feature_id, {R('activation_value')} AS activation_value FROM active""")
def resumed(spark, d):
    """Some chunks committed, others written by a job that died before its commit, the rest never begun."""
    rows, path = fr.samples(spark, d), fresh(spark, "chunks")
    early = rows.where("chunk_id % 3 = 0")
    cm.finish_chunks(ac.active_entries(early), early, path, chunks_per_folder=2)
    ac.active_entries(rows.where("chunk_id % 3 = 1")).withColumn("chunk_range", F.lit(0).cast("long")) \
        .write.partitionBy("chunk_range").parquet(f"{path}/data/rows/commit=died")
    cm.resume(rows, ac.active_entries, path)
    cm.resume(rows, ac.active_entries, path)  # nothing is left to do
    return rounded(cm.read_finished(spark, path).select("sample_id", "chunk_id", "feature_id", "activation_value"), "activation_value")


def saved_report(spark, d):
    path = fresh(spark, "report")
    rp.save_report(rp.report_tables(fr.activations(spark, d), fr.vocab(spark), k=5, vocab_size=fr.VOCAB_SIZE), path)
    return path


HIST_PARTS, HIST = histogram_sql("active", "activation_value", 50, "feature_id").rsplit("SELECT", 1)


@register("S17_saved_histograms", "active", SELECTED + HIST_PARTS.rstrip() + f""", hist AS (SELECT {HIST}),
    st AS (SELECT feature_id, avg(activation_value) AS mean, median(activation_value) AS median FROM active GROUP BY feature_id)
    SELECT h.feature_id, h.bin, h.bin_start, h.bin_end, h.n, {R('st.mean')} AS mean, {R('st.median')} AS median, s."group"
    FROM hist h JOIN selected s ON s.feature_id = h.feature_id JOIN st ON st.feature_id = h.feature_id""")
def saved_histograms(spark, d):
    """Histograms of the selected features out of a saved report."""
    path, act = fresh(spark, "report"), fr.active(spark, d)
    rp.save_report({"activation_histograms": rp.report_histograms(act, rp.select_features(act, 5))}, path)
    return rounded(rp.read_report(spark, path, "activation_histograms"), "bin_start", "bin_end", "mean", "median")


@register("S17_saved_report", "act vocab", OFFLINE + SELECTED + ALL_COOC.format(t="active") + BREAKDOWN.replace("{n}", "1000").replace(STRINGS, "") + """
    SELECT 'top_activations' AS name, count(*) AS n FROM tops t JOIN selected s ON s.feature_id = t.feature_id
    UNION ALL SELECT 'co_occurring_features', count(*) FROM allcooc c JOIN selected s ON s.feature_id = c.source_feature_id
    UNION ALL SELECT 'token_type_breakdown', count(*) FROM (
        SELECT DISTINCT b.feature_id, property, value FROM brk b JOIN selected s ON s.feature_id = b.feature_id)
    UNION ALL SELECT 'activation_histograms', 50 * count(*) FROM selected
    UNION ALL SELECT 'summary', count(*) FROM selected""")
def saved_tables(spark, d):
    """Rows of every table of a saved report."""
    path = saved_report(spark, d)
    names = sorted(cm.schemas_of(path, rp.report_versions(path)[-1]))
    counts = [rp.read_report(spark, path, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
