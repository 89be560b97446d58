"""Best k rows per group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

# Up to this k one rank filter is enough: Spark trims every group to k rows per map task
# before the shuffle. Larger k would still bring k rows per map task to one reducer.
ONE_STAGE_K = 100
SALTS = 64


def top_k(df, by, order, k, rank="rank"):
    """Rows ranked 1..k by ``order`` (a total order) within ``by``; k=None ranks all rows."""
    by = [by] if isinstance(by, str) else list(by)
    if k is not None and k > ONE_STAGE_K:
        # The salt only decides which partial result a row competes in first;
        # the k best of the partial bests are the same for any salt.
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.spark_partition_id() % SALTS)
              .withColumn("_partial", F.row_number().over(first))
              .where(F.col("_partial") <= k)
              .drop("_salt", "_partial"))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)
