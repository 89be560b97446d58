"""From dense unit values per sample to the long activations table."""

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.plans.ordered import WIDTH, dense_index, over_neighbours
from sparselens.plans.topk import top_k


def active_entries(samples, threshold=schema.ACTIVATION_THRESHOLD, vec="vec"):
    """One row per (sample, unit) whose value is strictly above the threshold; NaN never is."""
    keep = [c for c in samples.columns if c != vec]
    return (samples.select(*keep, F.posexplode(vec).alias("feature_id", "activation_value"))
            .withColumn("activation_value", F.col("activation_value").cast("double"))
            .where(~F.isnan("activation_value") & (F.col("activation_value") > F.lit(float(threshold)))))


def strongest_per_sample(active, top_k_features=schema.FEATURES_PER_SAMPLE,
                         sort_order="descending", sample="sample_id"):
    """Keep the k largest (or smallest) units of each sample; equal values keep lower ids.

    ``None`` keeps everything unchanged.
    """
    if sort_order not in ("descending", "ascending"):
        raise ValueError("sort_order must be 'descending' or 'ascending'")
    if top_k_features is None:
        return active
    value = F.col("activation_value")
    first = value.desc() if sort_order == "descending" else value.asc()
    return top_k(active, sample, [first, F.col("feature_id")], top_k_features).drop("rank")


def trimmed_entries(samples, threshold=schema.ACTIVATION_THRESHOLD,
                    top_k_features=schema.FEATURES_PER_SAMPLE, vec="vec"):
    """Threshold and per-sample trim of dense vectors in one row-wise step: no shuffle, no state."""
    keep = [c for c in samples.columns if c != vec]
    strongest = _strongest(vec, threshold, top_k_features)
    return samples.select(*keep, F.explode_outer(strongest).alias("_e")).where(F.col("_e").isNotNull()).select(
        *keep, F.col("_e.feature_id").alias("feature_id"), (-F.col("_e.neg")).alias("activation_value"))


def _strongest(vec, threshold, top_k_features):
    """Active entries of a dense vector as an array of (neg, feature_id), the strongest first; all in order of ids without a k."""
    entries = F.transform(F.col(vec), lambda v, i: F.struct(
        (-v.cast("double")).alias("neg"), i.alias("feature_id")))
    active = F.filter(entries, lambda e: ~F.isnan(e["neg"]) & (-e["neg"] > F.lit(float(threshold))))
    return active if top_k_features is None else F.slice(F.array_sort(active), 1, top_k_features)


def nested_entries(samples, threshold=schema.ACTIVATION_THRESHOLD, top_k_features=schema.FEATURES_PER_SAMPLE, vec="vec"):
    """Threshold and trim of dense vectors, one row a sample: ``features`` is an array of (feature_id,
    activation_value). Samples without an active unit have an empty one."""
    keep = [c for c in samples.columns if c != vec]
    entries = F.transform(_strongest(vec, threshold, top_k_features), lambda e: F.struct(
        e["feature_id"].alias("feature_id"), (-e["neg"]).alias("activation_value")))
    return samples.select(*keep, entries.alias("features"))


def alive_features(active):
    """Distinct units that fired."""
    return active.select("feature_id").distinct()


def alive_share(active, num_features):
    """How many units fired, and as a percentage of all units."""
    n = F.count_distinct("feature_id")
    return active.agg(n.alias("alive_count"),
                      (F.lit(100.0) * n / F.lit(num_features)).alias("alive_percent"))


def context_windows(samples, window=schema.CONTEXT_WINDOW, by=("chunk_id",), order="sample_id",
                    token="token_id", pos=None, width=WIDTH):
    """Token ids from ``window`` positions before to ``window`` after each sample.

    At either end of the group (a chunk, or a document) the edge token is repeated, so the
    list always has 2*window+1 elements. ``pos`` names a dense 0-based position inside the
    group if the table has one; otherwise it is derived from the unique integer ``order``.
    """
    by = list(by)
    rows = samples.select(*dict.fromkeys([order, *by, token, *([pos] if pos else [])]))
    if pos is None:
        pos = "_pos"
        rows = dense_index(rows, order, by, pos, width)
    around = over_neighbours(
        rows, pos, {"_seen": lambda w: F.collect_list(token).over(w)}, by, window, window, width)
    seen = F.col("_seen")
    left = F.greatest(F.lit(window) - F.col(pos), F.lit(0)).cast("int")
    right = F.lit(2 * window + 1) - F.size(seen) - left
    context = F.concat(F.array_repeat(F.element_at(seen, 1), left), seen,
                       F.array_repeat(F.element_at(seen, -1), right))
    return around.select(*dict.fromkeys([order, *by, token]), context.alias("context_token_ids"))


def activation_records(active, contexts, sample="sample_id"):
    """Activations with the context of their sample: the rows of the activations table."""
    return (active.join(contexts.select(sample, "context_token_ids"), sample)
            .select(sample, F.col("feature_id").cast("int").alias("feature_id"),
                    "activation_value", F.col("token_id").cast("int").alias("token_id"),
                    "context_token_ids", F.col("chunk_id").cast("int").alias("chunk_id")))


def nested_records(nested, contexts=None, sample="sample_id"):
    """``activation_records`` of samples with arrays of units: what meets the contexts is one row a
    sample, and the records are written out behind the join. ``contexts=None``: the rows have their
    ``context_token_ids`` already, and nothing moves."""
    met = nested.where(F.size("features") > 0)
    if contexts is not None:
        met = met.join(contexts.select(sample, "context_token_ids"), sample)
    return (met.select(sample, "token_id", "chunk_id", "context_token_ids", F.explode("features").alias("_e"))
            .select(sample, F.col("_e.feature_id").cast("int").alias("feature_id"), F.col("_e.activation_value").alias("activation_value"),
                    F.col("token_id").cast("int").alias("token_id"), "context_token_ids", F.col("chunk_id").cast("int").alias("chunk_id")))


def extract_activations(samples, model=None, threshold=schema.ACTIVATION_THRESHOLD,
                        top_k_features=schema.FEATURES_PER_SAMPLE,
                        window=schema.CONTEXT_WINDOW):
    """Vectors of all chunks to activation records.

    With a model the vectors are encoded, thresholded and trimmed in one pass over the
    samples without a shuffle; one short row a sample meets the contexts. Without one the
    vectors already hold unit values.
    """
    if model is not None:
        from sparselens.operators.autoencoder import encode_nested
        nested = encode_nested(samples, model, threshold, top_k_features)
    else:
        nested = nested_entries(samples, threshold, top_k_features)
    return nested_records(nested, context_windows(samples, window))
