"""Relations between features: co-occurrence, similarity, dead units, nearest units."""

from pyspark.sql import functions as F

from sparselens.operators.features import activation_quantile, for_feature, value, without_feature
from sparselens.plans.blocks import dense_products, nearest_products, sparse_cosines, sparse_cross
from sparselens.plans.joins import lookup_join
from sparselens.plans.quantiles import exact_quantiles
from sparselens.plans.similarity import similar_features as similarity_join
from sparselens.plans.topk import top_k
from sparselens.session import settle

NAN = float("nan")


def strong_tokens(act, feature_id, percentile=0.75):
    """Distinct tokens on which the feature reaches its own percentile (inclusive)."""
    if not 0 <= percentile <= 1:
        raise ValueError("a percentile must be between 0 and 1")
    rows = for_feature(act, feature_id)
    cut = activation_quantile(rows, percentile).select("threshold").scalar()
    return rows.where(value() >= cut).select("token_id").distinct()


def co_occurring_features(act, feature_id, percentile=0.75):
    """Other features on the strong tokens of one feature: distinct count and sorted tokens.

    A feature without rows gives an empty result.
    """
    tokens = strong_tokens(act, feature_id, percentile)
    others = without_feature(act, feature_id).select("feature_id", "token_id")
    shared = lookup_join(others, tokens, "token_id", "left_semi", measure=True).distinct()
    return shared.groupBy("feature_id").agg(
        F.count("*").alias("co_occurrence_count"),
        F.array_sort(F.collect_list("token_id")).alias("token_ids"))


def _probe_tokens(act, probes, percentile, max_features):
    """Ones at (probe, token it is strong on) and at (feature, token it has)."""
    rows = act.select("feature_id", "token_id", value().alias("activation_value"))
    own = rows if probes is None else lookup_join(
        rows, probes.select("feature_id").distinct(), "feature_id", "left_semi",
        max_rows=max_features, measure=True)
    cuts = activation_quantile(own, percentile, ["feature_id"], max_features)
    strong = (lookup_join(own, cuts, "feature_id", max_rows=max_features, measure=True)
              .where(F.col("activation_value") >= F.col("threshold"))
              .select("feature_id", "token_id").distinct().withColumn("_one", F.lit(1.0)))
    return strong, rows.select("feature_id", "token_id").distinct().withColumn("_one", F.lit(1.0))


def co_occurrence_counts(act, probes=None, percentile=0.75, max_features=None):
    """Co-occurrence counts for many probe features at once, without their token lists.

    The count for (probe, other) is a product of two 0/1 matrices over tokens, computed in
    blocks; pairs of features are never listed per token. ``probes=None`` takes every feature.
    """
    strong, present = _probe_tokens(act, probes, percentile, max_features)
    counts = sparse_cross(strong, present, "token_id", "feature_id", "_one", ones=True)
    return (counts.where(F.col("left_id") != F.col("right_id"))
            .select(F.col("left_id").alias("source_feature_id"), F.col("right_id").alias("feature_id"),
                    F.col("shared").alias("co_occurrence_count")))


def strongest_co_occurrences(act, probes=None, percentile=0.75, max_features=None, top=None, cut=None):
    """``co_occurrence_counts`` bounded where it is computed: each probe's ``top`` features by count
    (lower ids first among equals), or those with at least ``cut`` shared tokens, or both."""
    strong, present = _probe_tokens(act, probes, percentile, max_features)
    own = F.col("left_id") == F.col("right_id")  # a probe is not its own partner: one more is asked for
    found = similarity_join(strong, "token_id", "feature_id", "_one", present, cut, None if top is None else top + 1, cosine=False)
    found = found.where(~own).select(F.col("left_id").alias("source_feature_id"), F.col("right_id").alias("feature_id"),
                                     F.col("shared").alias("co_occurrence_count"))
    if top is None:
        return found
    return top_k(found, "source_feature_id", [F.desc("co_occurrence_count"), F.col("feature_id")], top)


# ---- similarity in token space ------------------------------------------------------

def token_maxima(act):
    """Largest value per (feature, token): a sparse vector over tokens for each feature."""
    return act.groupBy("feature_id", "token_id").agg(F.max(value()).alias("activation"))


def token_norms(maxima):
    return maxima.groupBy("feature_id").agg(
        F.sqrt(F.sum(F.col("activation") * F.col("activation"))).alias("norm"))


def _pair_columns(act, i, j):
    """One row per token with the values of both features (null where one is missing)."""
    rows = act.where(F.col("feature_id").isin(i, j))
    return rows.groupBy("token_id").agg(
        F.max(F.when(F.col("feature_id") == i, value())).alias("a"),
        F.max(F.when(F.col("feature_id") == j, value())).alias("b"))


def cosine_similarity(act, i, j):
    """Cosine of two features over tokens; 0.0 without a shared token."""
    a, b = F.col("a"), F.col("b")
    return _pair_columns(act, i, j).agg(F.coalesce(
        F.sum(a * b) / (F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))), F.lit(0.0))
        .alias("cosine_similarity"))


def correlation(act, i, j):
    """Centred cosine: each side centred on the mean of its own tokens, shared tokens only in
    the product. 0.0 without a shared token, NaN when a side does not vary."""
    pair = _pair_columns(act, i, j)
    centred = pair.select((F.col("a") - pair.agg(F.avg("a")).scalar()).alias("a"),
                          (F.col("b") - pair.agg(F.avg("b")).scalar()).alias("b"))
    a, b = F.col("a"), F.col("b")
    size = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    product = F.sum(a * b)
    return centred.agg(F.when(product.isNull(), 0.0).when(size == 0, NAN)
                       .otherwise(product / size).alias("correlation"))


def _pairs(entries, name):
    found = sparse_cosines(entries, "token_id", "feature_id", "activation")
    return found.select("feature_i", "feature_j", F.col("cosine").alias(name))


def cosine_pairs(act):
    """Cosine of all feature pairs i < j with a shared token; all other pairs are 0."""
    return _pairs(token_maxima(act), "cosine_similarity")


def correlation_pairs(act, max_features=None):
    """Centred cosine of all feature pairs i < j with a shared token; all other pairs are 0."""
    return _pairs(_centred_maxima(act, max_features), "correlation")


def _centred_maxima(act, max_features=None):
    maxima = token_maxima(act)
    means = maxima.groupBy("feature_id").agg(F.avg("activation").alias("_mean"))
    return lookup_join(maxima, means, "feature_id", max_rows=max_features, measure=True).select(
        "feature_id", "token_id", (F.col("activation") - F.col("_mean")).alias("activation"))


def _bounded(entries, name, cut, top):
    found = similarity_join(entries, "token_id", "feature_id", "activation", cut=cut, top=top)
    named = [F.col("left_id").alias("feature_i"), F.col("right_id").alias("feature_j"), F.col("score").alias(name)]
    return found.select(*named, *(["rank"] if top is not None else []))


def similar_features(act, cut=None, top=None):
    """Pairs i < j whose cosine is at least ``cut``, or every feature's ``top`` most similar ones (both
    directions, with their ``rank``). Unlike ``cosine_pairs`` nothing grows with the square of the features."""
    return _bounded(token_maxima(act), "cosine_similarity", cut, top)


def correlated_features(act, cut=None, top=None, max_features=None):
    """``similar_features`` by centred cosine. A feature that does not vary has no partner."""
    return _bounded(_centred_maxima(act, max_features), "correlation", cut, top)


def similarity_matrix(act, features):
    """Full symmetric cosine matrix of a list of features (a frame of ids): diagonal 1,
    0 without a shared token. The list is a report selection; its square is the output."""
    ids = features.select(F.col("feature_id").cast("long").alias("feature_i")).distinct()
    all_ids = ids.agg(F.array_sort(F.collect_list("feature_i"))).scalar()
    grid = ids.withColumn("feature_j", F.explode(all_ids))
    listed = lookup_join(act, features.select("feature_id").distinct(), "feature_id", "left_semi",
                         measure=True)
    pairs = cosine_pairs(listed)
    both = pairs.unionByName(pairs.select(F.col("feature_j").alias("feature_i"),
                                          F.col("feature_i").alias("feature_j"), "cosine_similarity"))
    cosine = F.when(F.col("feature_i") == F.col("feature_j"), 1.0).otherwise(
        F.coalesce("cosine_similarity", F.lit(0.0)))
    return grid.join(both, ["feature_i", "feature_j"], "left").select(
        "feature_i", "feature_j", cosine.alias("cosine_similarity"))


# ---- dead units ---------------------------------------------------------------------

def all_units(spark, num_features):
    return spark.range(num_features).select(F.col("id").cast("int").alias("feature_id"))


def dead_features(alive, num_features):
    """Ids of the declared range that are not in ``alive``.

    Two readings exist: ``alive`` taken before the per-sample trim (units never above the
    threshold) or from the stored table (units without a stored record).
    """
    ids = alive.select(F.col("feature_id").cast("int").alias("feature_id")).distinct()
    return all_units(alive.sparkSession, num_features).join(ids, "feature_id", "left_anti")


def dead_summary(dead, num_features):
    n = F.count("*")
    return dead.agg(n.alias("dead_count"), (n / F.lit(num_features)).alias("dead_proportion"),
                    (F.lit(num_features) - n).alias("alive_count"))


def tag_dead(units, dead):
    """Every unit with status "dead" or "alive"."""
    marked = dead.select("feature_id", F.lit(True).alias("_dead"))
    return units.join(marked, "feature_id", "left").withColumn(
        "status", F.when(F.col("_dead"), "dead").otherwise("alive")).drop("_dead")


# ---- decoder geometry ---------------------------------------------------------------

def similarity_block(left, right, vec="w_dec"):
    """Dot products of all unit rows of two sets (unit-length rows give cosines)."""
    return dense_products(left, right, "feature_id", "feature_id", vec)


def similar_units(left, right=None, vec="w_dec", cut=None, top=None):
    """Unit rows whose cosine is at least ``cut``, or each left row's ``top`` nearest: (left_id, right_id,
    cosine_similarity). ``right=None`` compares the rows of one table."""
    def entries(units):
        return units.select("feature_id", F.posexplode(vec).alias("_dim", "_x"))

    found = similarity_join(entries(left), "_dim", "feature_id", "_x", None if right is None else entries(right), cut, top)
    return found.select("left_id", "right_id", F.col("score").alias("cosine_similarity"), *(["rank"] if top is not None else []))


def nearest_alive(weights, dead, vec="w_dec", num_features=None):
    """Nearest alive unit of every dead and of every (other) alive unit.

    ``kind`` is dead_alive or alive_alive; without any alive candidate the nearest is null.
    The dead ids are settled first: they usually end a pass over all samples. ``num_features`` is
    not needed any more: blocks hold the rows that are there.
    """
    tagged = tag_dead(weights.select("feature_id", vec), settle(dead.select("feature_id")))
    alive = tagged.where(F.col("status") == "alive")
    found = nearest_products(tagged, alive, "feature_id", "feature_id", vec, True)
    kind = F.when(F.col("status") == "dead", "dead_alive").otherwise("alive_alive")
    return found.withColumnRenamed("left_id", "feature_id").join(
        tagged.select("feature_id", kind.alias("kind")), "feature_id").select(
        "feature_id", "kind", "nearest_id", "similarity")


def nearest_summary(nearest):
    """Mean, median, population deviation and maximum of the nearest cosine per kind."""
    base = nearest.groupBy("kind").agg(
        F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std"),
        F.max("similarity").alias("max"))
    mid = exact_quantiles(nearest, ["kind"], "similarity", {"median": 0.5}, max_groups=2)
    return base.join(mid, "kind").select("kind", "mean", "median", "std", "max")


def near_duplicates(nearest, threshold=0.8):
    """Alive units whose nearest other alive unit is strictly above the threshold."""
    alive = nearest.where(F.col("kind") == "alive_alive")
    n, hit = F.count("*"), F.count_if(F.coalesce(F.col("similarity") > threshold, F.lit(False)))
    return alive.agg(hit.alias("duplicate_count"), F.when(n > 0, F.lit(100.0) * hit / F.nullif(n, F.lit(0)))
                     .alias("duplicate_percent"))
