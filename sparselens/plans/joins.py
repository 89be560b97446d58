"""Joins of a very large side with a keyed lookup side, safe against hot keys."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselens.session import settle, staged

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
SALTS = 32
# Keys with at least this part of all rows are frequent, so there are no more of them than this.
FREQUENT = 1 << 18
# Below this estimated input size any single group fits one task.
SMALL_INPUT = 64 << 20


def estimated_bytes(df):
    """The optimizer's size estimate; derived frames are estimated from their inputs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def is_small(df):
    """True when the whole input is so small that any group of it fits one task."""
    return estimated_bytes(df) <= SMALL_INPUT


def fits_broadcast(df, max_rows=None):
    """True when a proven row bound or the optimizer's estimate allows a broadcast."""
    if max_rows is not None:
        return max_rows <= BROADCAST_ROWS
    return estimated_bytes(df) <= BROADCAST_BYTES


def lookup_join(big, small, on, how="inner", max_rows=None, measure=False, salts=None):
    """Join ``big`` with ``small`` without letting one hot key fill a task.

    ``max_rows`` is a bound the caller has proven for ``small`` (for example one row per
    id of a declared id range). Within the bound, or when the estimated size is small, the
    small side is broadcast and the big side is not moved. ``measure`` is for a small side
    that is an aggregate of a large input: its size cannot be estimated, so it is computed
    and counted first. Otherwise every row of the small side is copied once per salt and
    the big side spreads each key over all salts.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    if measure:
        small = settle(small)
        if fits_broadcast(small, small.count()):
            return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, salts)


def salted_join(big, small, keys, how="inner", salts=None):
    """Join on the keys and a salt: a hash of the other columns of the big row.

    Arrays are hashed only when there is nothing else to tell rows apart; rows of nothing but
    keys are spread by their partition.
    """
    salts = salts or SALTS
    others = [f for f in big.schema.fields
              if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    cheap = [f for f in others if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
    hashed = [f.name for f in (cheap or others)]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(salts)) if hashed \
        else F.pmod(F.spark_partition_id(), F.lit(salts)).cast("long")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    return (big.withColumn("_salt", salt)
            .join(small.withColumn("_salt", copies), [*keys, "_salt"], how)
            .drop("_salt"))


def frequent_join(big, small, on, frequent=None):
    """Inner join with a lookup side that may be nearly as large as ``big``, such as words with their ids.

    Rows of frequent keys meet a broadcast part of the small side and are not moved. The other keys are
    too rare to fill a task, so they meet in a plain join; neither side is copied.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), on)
    counts = staged(big.groupBy(on).agg(F.count("*").alias("_n")), "counts")
    least = counts.agg(F.sum("_n")).scalar() / F.lit(frequent or FREQUENT)
    hot = settle(counts.where(F.col(on).isNotNull() & (F.col("_n") >= least)).select(on))
    small = staged(small, "lookup")
    near = big.join(F.broadcast(small.join(F.broadcast(hot), on, "left_semi")), on)
    far = big.join(F.broadcast(hot), on, "left_anti").join(small.join(F.broadcast(hot), on, "left_anti"), on)
    return near.unionByName(far)
