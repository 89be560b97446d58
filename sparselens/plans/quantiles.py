"""Exact interpolated quantiles per group without holding a group in one task."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparselens.plans.joins import is_small, lookup_join
from sparselens.session import staged

# Cells per doubling of magnitude. A float32 column has at most 2**23 values per doubling,
# so a cell holds at most 32,768 distinct values however many rows a group has.
CELLS_PER_OCTAVE = 256
_ZERO_GAP = 1100 * CELLS_PER_OCTAVE
# A cell with more rows and more than one value is cut into this many parts, again and again.
PARTS = 256
# Rows of a cell that are ranked in one task.
MOST_ROWS = 1 << 16


def value_cell(value):
    """Non-decreasing map of a number to an integer cell; fine near zero, coarse far out."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * CELLS_PER_OCTAVE) + _ZERO_GAP
    # infinities and NaN (the largest value, as in sorting) have cells of their own
    far = F.lit(2 * _ZERO_GAP)
    return (F.when(F.isnan(v), far + 1).when(v == float("inf"), far).when(v == float("-inf"), -far)
            .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long"))


def _ranks(probs):
    """The ranks that interpolation needs, from the group's number of rows."""
    return F.array(*[f(F.lit(float(p)) * (F.col("_total") - 1)) for p in probs.values() for f in (F.floor, F.ceil)])


def _targets(cells, probs):
    """Cells that hold a wanted rank."""
    hit = F.exists(_ranks(probs), lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))
    return cells.where(hit).select("_group", "_cell", "_start", "_total", "_c", "_low", "_high")


def _counted(rows, keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def _refined(rows, large, probs):
    """The cells of ``large`` cut into PARTS by value, with the rows in them: (staged rows, targets).

    A part is told by the cell's name and its number. Parts of one cell are at most PARTS rows here.
    """
    at = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS)
    inside = lookup_join(rows, large.select("_group", "_cell", "_low", "_high"), ["_group", "_cell"], measure=True)
    inside = staged(inside.select("_group", F.col("_cell").alias("_whole"), "_v",
                                  F.least(F.greatest(at, F.lit(0)), F.lit(PARTS - 1)).cast("int").alias("_part")), "cells")
    parts = _counted(inside, ["_group", "_whole", "_part"])
    before = Window.partitionBy("_group", "_whole").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    whole = large.select("_group", F.col("_cell").alias("_whole"), F.col("_start").alias("_first"), "_total")
    name = F.concat("_whole", F.lit("."), F.col("_part").cast("string"))
    cells = parts.join(whole, ["_group", "_whole"]).withColumn("_start", F.col("_first") + F.col("_before")).withColumn("_cell", name)
    return inside.select("_group", name.alias("_cell"), "_v"), staged(_targets(cells, probs), "cells")


def _ranked(rows, small):
    """Distinct values of small cells with their ranks [_lo, _hi)."""
    hit = lookup_join(rows, small.select("_group", "_cell", "_start", "_total"), ["_group", "_cell"], measure=True)
    inside = Window.partitionBy("_group", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (hit.groupBy("_group", "_cell", "_start", "_total", "_v").agg(F.count("*").alias("_m"))
            .withColumn("_hi", F.col("_start") + F.sum("_m").over(inside))
            .select("_group", "_total", "_v", (F.col("_hi") - F.col("_m")).alias("_lo"), "_hi"))


def exact_quantiles(df, by, value, probs, max_groups=None, count_name=None):
    """One row per group with the linearly interpolated quantiles in ``probs`` {name: p}.

    A small input goes through Spark's exact ``percentile``. Otherwise, first pass: rows per
    (group, cell) with their least and largest value, summed on the map side; the running count over
    the cells tells which cells hold the wanted ranks. A cell of one value is settled. A cell of more
    than MOST_ROWS rows is cut into parts by value, which are counted again, until the part with the
    rank has one value or few rows; only those rows are ranked. So the rows of a task are bounded
    however close the values of a column lie together. Nulls are ignored, NaN is the largest value.
    ``max_groups`` is a proven bound on the number of groups, if there is one.
    """
    by = list(by)
    if is_small(df):
        v = F.col(value).cast("double")
        count = [F.count(v).alias(count_name)] if count_name else []
        return df.where(v.isNotNull()).groupBy(*by).agg(
            *[F.percentile(v, float(p)).alias(n) for n, p in probs.items()], *count)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))  # null groups are equal inside a struct
    rows = df.where(F.col(value).isNotNull()).select(
        group.alias("_group"), F.col(value).cast("double").alias("_v")).withColumn("_cell", value_cell(F.col("_v")).cast("string"))
    whole = Window.partitionBy("_group")
    upto = whole.orderBy(F.col("_cell").cast("long")).rowsBetween(Window.unboundedPreceding, 0)
    cells = (_counted(rows, ["_group", "_cell"]).withColumn("_total", F.sum("_c").over(whole))
             .withColumn("_start", F.sum("_c").over(upto) - F.col("_c")))
    targets = staged(_targets(cells, probs), "cells")

    found = []
    while True:
        several = F.col("_low") != F.col("_high")
        found.append(targets.where(~several).select(
            "_group", "_total", F.col("_low").alias("_v"), F.col("_start").alias("_lo"), (F.col("_start") + F.col("_c")).alias("_hi")))
        found.append(_ranked(rows, targets.where(several & (F.col("_c") <= MOST_ROWS))))
        large = targets.where(several & (F.col("_c") > MOST_ROWS))
        if large.isEmpty():
            break
        rows, targets = _refined(rows, large, probs)
    values = reduce(lambda a, b: a.unionByName(b), found)

    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for suffix, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))
                         .alias(f"_{name}_{suffix}"))
    grouped = values.groupBy("_group").agg(F.max("_total").alias("_total"), *picks)
    out = [F.col("_group")[c].alias(c) for c in by]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi, part = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), at - F.floor(at)
        out.append(F.when((lo == hi) | (part == 0), lo).otherwise((1 - part) * lo + part * hi).alias(name))
    if count_name:
        out.append(F.col("_total").alias(count_name))
    return grouped.select(*out)
