"""Comparison of two tables of the same layout."""

from pyspark.sql import functions as F


def row_counts(a, b):
    return a.agg(F.count("*").alias("count_a")).withColumn("count_b", b.agg(F.count("*")).scalar())


def same_rows(a, b):
    """Whether two frames hold the same rows, counting duplicates."""
    extra = a.exceptAll(b).unionAll(b.exceptAll(a))
    return extra.agg((F.count("*") == 0).alias("identical"))


def same_first_rows(a, b, n=20, columns=("feature_id", "activation_value")):
    """Whether the first n rows in (feature, value) order agree."""
    def first(df):
        return df.select(*columns).orderBy(*columns).limit(n)
    return same_rows(first(a), first(b))


def same_weights(a, b, columns=("w_enc",)):
    """Whether two weight tables have the same units with equal values."""
    left = a.select("feature_id", F.lit(True).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select("feature_id", F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    equal = F.col("_a").eqNullSafe(F.col("_b"))
    for c in columns:
        equal = equal & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return left.join(right, "feature_id", "full").agg(
        F.coalesce(F.bool_and(equal), F.lit(True)).alias("identical"))
