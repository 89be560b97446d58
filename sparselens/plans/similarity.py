"""Bounded similarity join of the features of sparse matrices: only pairs above a cut, or the best partners, leave a task.

Features are cut into blocks and rows into strips. For each block and strip the largest length of a
feature's part is known, so by Cauchy-Schwarz the products of two blocks are bounded by the sum over
strips of the products of these lengths; block pairs below the cut are never computed. The others
are accumulated strip by strip in one task, which reads the files of both blocks, holds one
block-by-block result and one strip of each side, and keeps what passes the cut or the best per feature.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparselens.plans.blocks import BLOCK, TOKEN_WIDTH, _cells, block_products, write_blocks
from sparselens.plans.topk import top_k

_FOUND = "left_id long, right_id long, score double, shared long"
# Room for rounding between a bound and the product itself.
_SLACK = 1e-9


def _lengths(cells, name, cosine):
    """Per (block, strip) the largest length of a feature's part; shares of the whole length for cosines."""
    parts = cells.groupBy("_f", "_b", "_rows").agg(F.sum(F.col("_x") * F.col("_x")).alias("_s"))
    if cosine:  # a feature has at most one row a strip here
        whole = F.sum("_s").over(Window.partitionBy("_f"))
        parts = parts.withColumn("_s", F.coalesce(F.col("_s") / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))
    return parts.groupBy(F.col("_b").alias(name), "_rows").agg(F.sqrt(F.max("_s")).alias(f"_{name}_top"))


def block_pairs(left, right, cut, cosine, same):
    """(lb, rb): pairs of blocks whose bound reaches the cut; without a cut, those with a common strip."""
    met = _lengths(left, "lb", cosine).join(_lengths(right, "rb", cosine), "_rows")
    if same:
        met = met.where("lb <= rb")
    bounds = met.groupBy("lb", "rb").agg(F.sum(F.col("_lb_top") * F.col("_rb_top")).alias("_bound"))
    if cut is not None:
        bounds = bounds.where(F.col("_bound") >= cut - _SLACK * (1 + abs(cut)))
    return bounds.select("lb", "rb")


def _best(left, order, top):
    """Places of the ``top`` first entries of each left feature; ``order`` sorts all entries by feature first."""
    first = np.r_[True, left[order][1:] != left[order][:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < top]


def similar_features(left, row, feature, value, right=None, cut=None, top=None, cosine=True, block=BLOCK, row_width=TOKEN_WIDTH):
    """Pairs of features by cosine (or dot product) over common rows: ``left_id, right_id, score, shared``.

    ``cut`` keeps scores of at least that value, ``top`` each left feature's best partners (rank in
    ``rank``); one of them is needed. ``right=None`` compares the features of one matrix: a cut alone
    gives pairs left_id < right_id, ``top`` gives both directions. Pairs without a common row, and
    cosines with a feature of zero length, are not there. One value a (row, feature).
    """
    if cut is None and top is None:
        raise ValueError("give a cut or a number of partners: all pairs grow with the square of the features")
    same = right is None
    l = _cells(left, row, feature, value, block, row_width)
    r = l if same else _cells(right, row, feature, value, block, row_width)
    pairs = None if cut is None else block_pairs(l, r, cut, cosine, same)
    files = [write_blocks(cells, block, row_width) for cells in ([l] if same else [l, r])] + [None]

    def leave(product):
        score = product.cosines() if cosine else product.dots
        good = (product.shared > 0) & np.isfinite(score)
        if cut is not None:
            good &= score >= cut
        if same and product.alone:
            good &= ~np.eye(block, dtype=bool)
            if top is None:
                good = np.triu(good)
        if top is not None and top < block:  # no entry below a row's last good place is needed
            level = np.where(good, score, -np.inf)
            good &= level >= np.partition(level, block - top, axis=1)[:, block - top, None]
        i, j = np.nonzero(good)
        if top is None:  # the answer itself: by falling score, so that equal counts lie side by side
            order = np.lexsort((-score[i, j], i))
            i, j = i[order], j[order]
        return product.rows(i, j, score)

    def finish(columns):
        keep = _best(columns[0], np.lexsort((columns[1], -columns[2], columns[0])), top)
        return [c[keep] for c in columns]

    found = block_products(*files[:2], block, leave, _FOUND, pairs, same and top is not None, None if top is None else finish)
    if top is None:
        return found
    return top_k(found, "left_id", [F.desc("score"), F.col("right_id")], top)
