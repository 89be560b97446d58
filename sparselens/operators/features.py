"""Per-feature queries over the activations table, for one feature or for all at once."""

from pyspark.sql import functions as F

from sparselens.plans.joins import lookup_join
from sparselens.plans.quantiles import exact_quantiles
from sparselens.plans.topk import top_k


def value():
    return F.col("activation_value").cast("double")


# ---- restrictions -------------------------------------------------------------------

def for_feature(act, feature_id):
    return act.where(F.col("feature_id") == feature_id)


def for_token(act, token_id):
    return act.where(F.col("token_id") == token_id)


def for_features(act, feature_ids):
    return act.where(F.col("feature_id").isin(list(feature_ids)))


def without_feature(act, feature_id):
    return act.where(F.col("feature_id") != feature_id)


def in_index_range(df, num_features, column="feature_id"):
    return df.where(F.col(column).between(0, num_features - 1))


def with_minimum_support(counts, min_activations, column="num_activations"):
    """``None`` applies no filter."""
    return counts if min_activations is None else counts.where(F.col(column) >= min_activations)


def for_listed_features(act, features, max_rows=None):
    """Rows of the features in a frame of ids."""
    return lookup_join(act, features.select("feature_id").distinct(), "feature_id",
                       "left_semi", max_rows=max_rows, measure=True)


# ---- ranking, density ---------------------------------------------------------------

def most_active_features(act):
    """Records per feature, most first."""
    return (act.groupBy("feature_id").agg(F.count("*").alias("num_activations"))
            .orderBy(F.desc("num_activations"), "feature_id"))


def selectivity(act, min_activations=None):
    """count, mean, distinct tokens and mean / log10(count + 1) of each feature, unordered."""
    stats = act.groupBy("feature_id").agg(
        F.count("*").alias("num_activations"), F.avg(value()).alias("mean_activation"),
        F.count_distinct("token_id").alias("unique_token_count"))
    score = F.col("mean_activation") / F.log10(F.col("num_activations") + 1)
    return with_minimum_support(stats, min_activations).withColumn("selectivity_score", score)


def rank_by_selectivity(act, min_activations=None):
    return selectivity(act, min_activations).orderBy(F.desc("selectivity_score"), "feature_id")


def head_and_tail(ranking, k, score="selectivity_score"):
    """The k best and the k worst, tagged; a feature of a short ranking may be in both."""
    best = ranking.orderBy(F.desc(score), "feature_id").limit(k).withColumn("group", F.lit("top-k"))
    worst = ranking.orderBy(F.asc(score), F.desc("feature_id")).limit(k) \
        .withColumn("group", F.lit("bottom-k"))
    return best.unionByName(worst)


def feature_density(act):
    """Share of all records that belong to each feature."""
    counts = act.groupBy("feature_id").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select("feature_id", (F.col("_n") / total).alias("feature_density"))


# ---- distributions ------------------------------------------------------------------

def distribution(act, max_features=None):
    """Mean, median, sample deviation, quartiles, maximum, count, distinct tokens per feature."""
    base = act.groupBy("feature_id").agg(
        F.avg(value()).alias("mean"), F.stddev_samp(value()).alias("std"), F.max(value()).alias("max"),
        F.count("*").alias("count"), F.count_distinct("token_id").alias("unique_tokens"))
    cuts = exact_quantiles(act, ["feature_id"], "activation_value",
                           {"p25": 0.25, "median": 0.5, "p75": 0.75}, max_groups=max_features)
    return base.join(cuts, "feature_id").select(
        "feature_id", "mean", "median", "std", "p25", "p75", "max", "count", "unique_tokens")


def activation_quantile(act, p, by=(), max_groups=None):
    """Interpolated quantile of the activation value, overall or per group."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile must be between 0 and 1")
    return exact_quantiles(act, by, "activation_value", {"threshold": p}, max_groups=max_groups)


def features_per_token(act):
    """Sorted distinct features of each token, and how many."""
    pairs = act.select("token_id", "feature_id").distinct()
    return pairs.groupBy("token_id").agg(
        F.array_sort(F.collect_list("feature_id")).alias("features_activated_by_token"),
        F.count("*").alias("num_features_activated_by_token"))


# ---- strongest rows -----------------------------------------------------------------

def _directed(sort_order):
    if sort_order not in ("descending", "ascending"):
        raise ValueError("sort_order must be 'descending' or 'ascending'")
    return value().desc() if sort_order == "descending" else value().asc()


def top_activations(act, feature_id, k, sort_order="descending", tie=("sample_id",)):
    """The k largest or smallest records of one feature."""
    return for_feature(act, feature_id).orderBy(_directed(sort_order), *tie).limit(k)


def top_activations_per_feature(act, k, sort_order="descending", tie=("sample_id",)):
    """The same for every feature; ``rank`` starts at 1, ``None`` keeps all rows."""
    return top_k(act, "feature_id", [_directed(sort_order), *[F.col(t) for t in tie]], k)


def first_rows(act, n=20, tie=()):
    """First n rows in (feature, value) order, as used for a quick table comparison."""
    return act.orderBy("feature_id", "activation_value", *tie).limit(n)


# ---- display ------------------------------------------------------------------------

def display_frame(ranking, names, decimals=4):
    """Rename columns and write numbers of the given columns with fixed decimals."""
    numeric = {f.name for f in ranking.schema.fields if f.dataType.typeName() in ("double", "float")}
    return ranking.select(*[
        (F.format_string(f"%.{decimals}f", F.col(c)) if c in numeric else F.col(c)).alias(label)
        for c, label in names.items()])
