"""Dead units per step window and their replacement by badly reconstructed samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparselens import schema
from sparselens.functions import vectors as V
from sparselens.plans.joins import lookup_join


def step_window(step, every=schema.RESAMPLE_EVERY):
    """Window of a training step; steps count from 1."""
    return F.floor((step - 1) / every)


UNITS_A_WORD = 63  # bits of a positive long


def fired_words(fired, every=schema.RESAMPLE_EVERY):
    """Per step window, the units with a positive value as words of 63 bits: (step_window, word, bits)."""
    unit = F.col("feature_id").cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(cast(feature_id as bigint), {UNITS_A_WORD}) as int))")
    return (fired.where(F.col("activation_value") > 0)
            .groupBy(step_window(F.col("step"), every).cast("long").alias("step_window"),
                     F.floor(unit / UNITS_A_WORD).cast("long").alias("word"))
            .agg(F.bit_or(bit).alias("bits")))


def dead_per_window(fired, steps, num_features, every=schema.RESAMPLE_EVERY):
    """Units that never fire in a complete step window: the bits missing from each window's words.

    ``fired`` has (step, feature_id, activation_value); ``steps`` has every step done, so the
    windows come from its rows and one row of each window lists the words of the declared units.
    A window is complete once the last step lies at or past its end.
    """
    complete = F.floor(steps.agg(F.coalesce(F.max("step"), F.lit(0))).scalar() / every)
    windows = steps.select(step_window(F.col("step"), every).cast("long").alias("step_window")).distinct().where(
        (F.col("step_window") >= 0) & (F.col("step_window") < complete))
    words = F.sequence(F.lit(0).cast("long"), F.lit(max(num_features - 1, 0) // UNITS_A_WORD).cast("long"))
    seen = windows.withColumn("word", F.explode(words)).join(fired_words(fired, every), ["step_window", "word"], "left")
    first = F.col("word") * UNITS_A_WORD
    silent = F.filter(F.sequence(F.lit(0), F.lit(UNITS_A_WORD - 1)), lambda b: (
        F.getbit(F.coalesce("bits", F.lit(0).cast("long")), b) == 0) & (first + b < num_features))
    return (seen.select("step_window", first.alias("_first"), F.explode(silent).alias("_bit"))
            .select("step_window", (F.col("_first") + F.col("_bit")).cast("int").alias("feature_id")))


def error_intervals(errors, by=("batch",), sample="sample_id", error="squared_error"):
    """Each sample's interval of cumulative error share inside its batch.

    A batch holds a fixed number of samples, so the window is small.
    """
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(sample).rowsBetween(Window.unboundedPreceding, 0)
    share = errors.withColumn("_total", F.sum(error).over(whole)) \
                  .withColumn("_hi", F.sum(error).over(upto))
    return share.select(*by, sample, ((F.col("_hi") - F.col(error)) / F.col("_total")).alias("cum_lo"),
                        (F.col("_hi") / F.col("_total")).alias("cum_hi"))


def draw_samples(dead, errors, every=schema.RESAMPLE_EVERY, seed=42):
    """One sample per dead unit, with replacement, with probability proportional to the error.

    The samples are those of the batch that ends the step window. The draw is a fixed
    function of unit, window and seed: the first sample whose cumulative error exceeds it.
    """
    batches = (errors.where(F.pmod(F.col("batch") + 1, F.lit(every)) == 0)
               .groupBy("batch").agg(F.array_sort(F.collect_list(
                   F.struct("sample_id", "squared_error"))).alias("_samples")))
    running = F.aggregate(
        "_samples", F.struct(F.array().cast("array<double>").alias("sums"), F.lit(0.0).alias("last")),
        lambda acc, e: F.struct(
            F.concat(acc["sums"], F.array(acc["last"] + e["squared_error"])).alias("sums"),
            (acc["last"] + e["squared_error"]).alias("last")))
    batches = batches.select("batch", "_samples", running.alias("_r"))
    drawn = dead.withColumn("batch", (F.col("step_window") + 1) * every - 1).withColumn(
        "draw", V.uniform(F.col("feature_id"), F.col("step_window"), F.lit(seed)))
    met = lookup_join(drawn, batches, "batch")
    target = F.col("draw") * F.col("_r.last")
    below = F.size(F.filter("_r.sums", lambda s: s <= target))
    at = F.least(below + 1, F.size("_samples"))
    return met.select("step_window", "feature_id", "batch", "draw",
                      F.element_at("_samples", at)["sample_id"].alias("sample_id"))


def reinitialise(weights, draws, samples, b_dec, seed=42, scale=0.05, bias_scale=0.01):
    """Weights with the drawn units replaced.

    The direction is the drawn sample minus ``b_dec``, unit length; the encoder row is scaled
    to 5 % of the mean encoder norm of the other units, the bias is a small negative number.
    """
    ids = draws.select("feature_id")
    mean_norm = weights.join(ids, "feature_id", "left_anti").agg(F.avg(V.norm(F.col("w_enc")))).scalar()
    centre = b_dec.select("b_dec").scalar()
    chosen = (draws.select("feature_id", "sample_id")
              .join(samples.select("sample_id", "vec"), "sample_id")
              .withColumn("_b", centre).withColumn("_scale", mean_norm * F.lit(scale))
              .select("feature_id", V.normalised(V.minus(F.col("vec"), F.col("_b"))).alias("_dec"), "_scale")
              .select("feature_id", "_dec", V.scaled(F.col("_dec"), F.col("_scale")).alias("_enc"),
                      (-V.uniform(F.col("feature_id"), F.lit(seed), F.lit("bias")) * F.lit(bias_scale))
                      .alias("_bias")))
    return weights.join(chosen, "feature_id", "left").select(
        "feature_id", F.coalesce("_enc", "w_enc").alias("w_enc"),
        F.coalesce("_dec", "w_dec").alias("w_dec"), F.coalesce("_bias", "b_enc").alias("b_enc"),
        F.col("_dec").isNotNull().alias("resampled"))
