"""Batch report over selected features, loss statistics and histograms."""

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.functions.text import is_polysemantic
from sparselens.operators import features as ft
from sparselens.operators import relations as rel
from sparselens.operators import text as tx
from sparselens.plans.joins import lookup_join
from sparselens.plans.ordered import WIDTH, dense_index, over_neighbours
from sparselens.plans.quantiles import exact_quantiles
from sparselens.session import settle
from sparselens.sources.commits import commits, read_commit, write_commit

NAN = float("nan")


# ---- report tables ------------------------------------------------------------------

def select_features(act, k=25, min_activations=10):
    """The k most and k least selective features with their group (``feature_id, group``).

    Settled: all report tables read this short list, and the ranking behind it is one scan.
    """
    return settle(ft.head_and_tail(ft.selectivity(act, min_activations), k).select("feature_id", "group"))


def batch_summary(act, selected, labels, max_selected=None):
    """Per selected feature: group, label, mean, median, deviation, distinct tokens."""
    rows = ft.for_listed_features(act, selected, max_selected)
    stats = ft.distribution(rows).select(
        "feature_id", F.col("mean").alias("mean_activation"), F.col("median").alias("median_activation"),
        F.col("std").alias("std_activation"), "unique_tokens")
    return (selected.join(labels.select("feature_id", "llm_label"), "feature_id", "left")
            .join(stats, "feature_id"))


def with_density(summary, act):
    return summary.join(ft.feature_density(act), "feature_id", "left")


def report_top_activations(act, selected, vocab, k=25, vocab_size=None, labeller=None,
                           max_selected=None):
    """Strongest labelled contexts of every selected feature, tagged with its group."""
    rows = ft.for_listed_features(act, selected, max_selected)
    best = tx.top_contexts_per_feature(rows, vocab, k, vocab_size=vocab_size)
    return tx.label_features(best, labeller).join(selected, "feature_id")


def report_co_occurrence(act, selected, max_selected=None):
    """Co-occurring features of every selected feature (counts only), tagged with its group."""
    counts = rel.co_occurrence_counts(act, selected, max_features=max_selected)
    return counts.join(selected.withColumnRenamed("feature_id", "source_feature_id"), "source_feature_id")


def report_breakdown(act, selected, vocab, sample_size=1000, vocab_size=None, max_selected=None):
    """Token property counts of every selected feature, tagged with its group."""
    rows = ft.for_listed_features(act, selected, max_selected)
    return tx.token_type_breakdown(rows, vocab, sample_size, vocab_size=vocab_size).join(
        selected, "feature_id")


def report_histograms(act, selected, bins=50, max_selected=None):
    """Histogram of the values of every selected feature with its mean, median and group."""
    rows = ft.for_listed_features(act, selected, max_selected)
    centre = ft.distribution(rows).select("feature_id", "mean", "median")
    return (equal_width_histogram(rows, bins=bins, by=["feature_id"], max_groups=max_selected)
            .join(centre, "feature_id").join(selected, "feature_id"))


def report_tables(act, vocab, labels=None, k=25, min_activations=10, contexts=25, sample_size=1000, vocab_size=None, labeller=None):
    """All tables of a report by name, over the k most and k least selective features.

    ``labels`` (feature_id, llm_label) come from the strongest contexts unless they are given.
    """
    selected, most = select_features(act, k, min_activations), 2 * k
    top = report_top_activations(act, selected, vocab, contexts, vocab_size, labeller, most)
    if labels is None:
        top = settle(top)
        labels = top.select("feature_id", "llm_label").distinct()
    return {"summary": with_density(batch_summary(act, selected, labels, most), act),
            "top_activations": top,
            "co_occurring_features": report_co_occurrence(act, selected, most),
            "token_type_breakdown": report_breakdown(act, selected, vocab, sample_size, vocab_size, most),
            "activation_histograms": report_histograms(act, selected, max_selected=most)}


def save_report(tables, path):
    """Commit the named frames below ``path`` together under one version, whose id is returned."""
    return write_commit(path, tables)


def report_versions(path):
    return commits(path)


def read_report(spark, path, table, version=None):
    """A table of a saved report, by default of its last complete version."""
    return read_commit(spark, path, table, version)


def monosemanticity(labels):
    """Share of labels that are not POLYSEMANTIC, overall and per group."""
    poly = F.count_if(is_polysemantic(F.col("llm_label")))
    return labels.rollup("group").agg(
        F.grouping("group").alias("_all"), F.count("*").alias("total_count"),
        poly.alias("polysemantic_count"), (F.lit(1.0) - poly / F.count("*")).alias("monosemanticity_rate")) \
        .withColumn("group", F.when(F.col("_all") == 1, "overall").otherwise(F.col("group"))).drop("_all")


# ---- losses -------------------------------------------------------------------------

def loss_statistics(losses, splits=("train", "val", "test"), decimals=6):
    """Count, mean, population deviation, min, max, median of each split; NaN when empty."""
    names = losses.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    base = losses.groupBy("split").agg(
        F.count("*").alias("num_batches"), F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"),
        F.min("loss").alias("min"), F.max("loss").alias("max"))
    mid = exact_quantiles(losses, ["split"], "loss", {"median": 0.5})
    joined = names.join(base, "split", "left").join(mid, "split", "left")
    return joined.select("split", F.coalesce("num_batches", F.lit(0)).alias("num_batches"), *[
        F.coalesce(F.round(c, decimals), F.lit(NAN)).alias(c) for c in ("mean", "std", "min", "max", "median")])


def smoothed_losses(losses, width=WIDTH):
    """Losses with their rolling mean; the window depends on the length of the split.

    train: min(50, n // 10) when n > 50; other splits: min(10, n // 5) when n > 10; shorter
    series have no smoothed value.
    """
    indexed = dense_index(losses, "step", ["split"], "_at", width)
    counts = losses.groupBy("split").agg(F.count("*").alias("_n"))
    n, train = F.col("_n"), F.col("split") == "train"
    size = (F.when(train & (n > 50), F.least(F.lit(50), F.floor(n / 10)))
            .when(~train & (n > 10), F.least(F.lit(10), F.floor(n / 5)))).cast("int")
    recent = over_neighbours(indexed, "_at", {"_recent": lambda w: F.collect_list("loss").over(w)},
                             ["split"], before=49, width=width)
    rows = lookup_join(recent, counts.select("split", size.alias("window")), "split", measure=True)
    last = F.slice("_recent", F.greatest(F.size("_recent") - F.col("window") + 1, F.lit(1)), F.col("window"))
    mean = F.aggregate(last, F.lit(0.0), lambda s, x: s + x) / F.size(last)
    return rows.select("split", "step", "loss", "window",
                       F.when(F.col("window").isNotNull(), mean).alias("smoothed"))


# ---- histograms ---------------------------------------------------------------------

def _filled(counts, groups, by, bins):
    """Every bin of every group, zero where nothing fell into it."""
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def equal_width_histogram(df, value="activation_value", bins=50, by=(), max_groups=None):
    """Counts in ``bins`` equal cells from minimum to maximum of each group.

    The last cell is closed on the right; a constant group is widened by 0.5 on both sides.
    """
    by = list(by)
    v = F.col(value).cast("double")
    ends = df.where(v.isNotNull()).groupBy(*by).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.where(F.col("_a").isNotNull()).select(
        *by, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("hi"))
    rows = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    if by:
        rows = lookup_join(rows, ends, by, max_rows=max_groups, measure=True)
    else:
        rows = rows.withColumn("lo", ends.select("lo").scalar()).withColumn("hi", ends.select("hi").scalar())
    at = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = rows.groupBy(*by, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return _filled(counts, ends, by, bins).select(
        *by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "n")


def fixed_edge_histogram(df, value, lo=-0.3, hi=1.0, bins=79, by=()):
    """Counts and densities in equal cells of [lo, hi]; values outside are dropped."""
    by = list(by)
    v = F.col(value).cast("double")
    inside = df.where(v.between(lo, hi))
    at = F.floor((v - lo) / (hi - lo) * bins)
    counts = inside.groupBy(*by, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    width = (hi - lo) / bins
    return _filled(counts, totals, by, bins).select(
        *by, "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"), "n",
        (F.col("n") / (F.col("_total") * width)).alias("density"))


# ---- run catalogue ------------------------------------------------------------------

def run_configurations(spark, dim=schema.MODEL_DIM):
    """All published runs: expansions x lambdas x sampling, with their derived names."""
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(e) for e in schema.EXPANSIONS])).alias("expansion")).select(
        "expansion", F.explode(F.array(*[F.lit(x) for x in schema.LAMBDAS])).alias("lam_str")).select(
        "expansion", "lam_str", F.explode(F.array(F.lit(False), F.lit(True))).alias("sampling"))
    label = F.when(F.col("sampling"), "sampling").otherwise("no sampling")
    name = F.concat(F.col("expansion").cast("string"), F.lit("x_"), F.col("lam_str"),
                    F.when(F.col("sampling"), "_sampling").otherwise(""))
    return grid.select(
        F.concat(F.col("expansion").cast("string"), F.lit("x | λ="), "lam_str", F.lit(" | "), label).alias("key"),
        "expansion", F.col("lam_str").cast("double").alias("lam"), "lam_str", "sampling",
        F.concat(F.lit("features_"), name).alias("dataset"),
        (F.col("expansion") * dim).alias("num_features")).orderBy("expansion", "lam", "sampling")
