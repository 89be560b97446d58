"""Positions, running totals and neighbourhoods over long ordered data.

A plain window without PARTITION BY, or with a hot partition, runs in one task. Here the
order key is cut into ranges of fixed width; only one total per range meets in a single
window, so the work per task is bounded by ``width`` rows plus (rows / width) range totals.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselens.plans.joins import estimated_bytes, is_small
from sparselens.plans.numbering import number_rows

WIDTH = 1 << 16
# Inputs beyond this estimate have so many ranges that their totals are summed in two steps.
VERY_LARGE = 1 << 40


def _range_of(order, width, shift=0):
    """Number of the width-sized range that holds order+shift (floor, also below zero)."""
    value = f"(cast(`{order}` as bigint) + {shift}L)"
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L")


def running_sum(df, order, values, by=(), width=WIDTH, very_large=VERY_LARGE):
    """Inclusive running totals of ``values`` ({output: input}) in integer ``order``.

    ``order`` must be unique within ``by``. Exact for integer inputs.
    """
    by = list(by)
    # Null groups and a null range meet too, as in a plain window: a struct is never null. It deals the
    # rows to the window and to the join, so that they move once.
    ranged = df.withColumn("_range", _range_of(order, width)).withColumn("_key", F.struct(*by, "_range"))
    sums = ranged.groupBy("_key").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in values.items()]).select("_key.*", *[f"_sum_{out}" for out in values])
    if estimated_bytes(df) > very_large:
        upto = running_sum(sums.withColumnRenamed("_range", "_fine"), "_fine",
                           {f"_upto_{out}": f"_sum_{out}" for out in values}, by, width,
                           float("inf")).withColumnRenamed("_fine", "_range")
        offsets = upto.select(*by, "_range", *[
            (F.col(f"_upto_{out}") - F.col(f"_sum_{out}")).alias(f"_before_{out}") for out in values])
    else:
        before = (Window.partitionBy(*by).orderBy("_range")
                  .rowsBetween(Window.unboundedPreceding, -1))
        offsets = sums.select(*by, "_range", *[
            F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}")
            for out in values])
    inside = (Window.partitionBy("_key").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.select("*", *[F.sum(src).over(inside).alias(f"_local_{out}")
                                 for out, src in values.items()])
    offsets = offsets.select(F.struct(*by, "_range").alias("_key"), *[f"_before_{out}" for out in values])
    return local.join(offsets, "_key").select(*[F.col(f"`{c}`") for c in df.columns], *[
        (F.col(f"_before_{out}") + F.col(f"_local_{out}")).alias(out) for out in values])


def dense_index(df, order, by=(), name="idx", width=WIDTH):
    """0-based position in unique ``order`` within ``by``, without a one-task sort.

    A small input is numbered by a plain window, a large one by ranges of an integer key or, for
    any other key, by sampled ranges.
    """
    if not is_small(df) and not isinstance(df.schema[order].dataType, T.IntegralType):
        return number_rows(df, [order], by, name)
    if is_small(df):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return df.withColumn(name, (place - 1).cast("long"))
    numbered = running_sum(df.withColumn("_one", F.lit(1).cast("long")), order,
                           {name: "_one"}, by, width)
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def hash_order(*keys, seed=""):
    """Deterministic shuffling key: md5 of the key texts and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def rank_by_hash(df, keys, seed="", name="rank", digits=3):
    """0-based rank of unique ``keys`` in md5 order.

    md5 spreads evenly, so each of the 16**digits leading-digit groups holds the same share
    of the rows; group totals (a fixed number of rows) give the offsets.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hashed = df.withColumn("_h", hash_order(*keys, seed=seed)) \
               .withColumn("_g", F.substring("_h", 1, digits))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("_g").agg(F.count("*").alias("_n")).select(
        "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g").orderBy("_h", *keys)
    return (hashed.withColumn("_local", F.row_number().over(inside))
            .join(offsets, "_g")
            .select(*df.columns, (F.col("_before") + F.col("_local") - 1).alias(name)))


def over_neighbours(df, pos, columns, by=(), before=0, after=0, width=WIDTH):
    """Evaluate window columns over rows [pos-before, pos+after] of dense position ``pos``.

    ``columns`` maps output name -> function of a WindowSpec. Rows near a range border are
    copied into the neighbouring range, so each task holds at most width+before+after rows
    even when one ``by`` value holds most of the data.
    """
    if max(before, after) > width:
        raise ValueError("the neighbourhood must not be wider than a range")
    by = list(by)
    copies = F.array_distinct(F.array(_range_of(pos, width), _range_of(pos, width, before), _range_of(pos, width, -after)))
    spread = (df.withColumn("_home", _range_of(pos, width))
              .withColumn("_range", F.explode(copies)))
    window = Window.partitionBy(*by, "_range").orderBy(pos).rowsBetween(-before, after)
    out = spread.select("*", *[make(window).alias(name) for name, make in columns.items()])
    return out.where(F.col("_home") == F.col("_range")).drop("_home", "_range")
