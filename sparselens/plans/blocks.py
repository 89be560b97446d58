"""Products of large matrices cut into blocks; no pair of rows is ever joined.

Rows are numbered by integer ids, so a block of ``block`` consecutive ids holds at most that
many rows. Each block is written once to the shared folder; what moves between tasks are pairs
of block numbers with the names of their files, and a finished product leaves its task once.
"""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparselens.plans.slabs import matrix, open_slab, place, write_rows
from sparselens.session import shared_dir, staged

BLOCK = 512
TOKEN_WIDTH = 4096
# Left vectors that a task of nearest products holds next to one block.
_ROWS = 2048
# Left and right rows whose dense products leave in one order: 128 MB of products.
_TILE = 4096, 4096
# Entries of a file that is read at a time: 16 MB.
_ENTRIES = 1 << 20
# Products that leave a task in one order, unless those of the last block are more: 128 MB.
_ORDERED = 1 << 22
# Blocks a task compares one block with at most before its best partners leave.
_PARTNERS = 64
# Tasks of a product at most, unless there are more cores; each has some 16 pairs before that.
_TASKS = 2000


def _block(name, width):
    value = f"cast(`{name}` as bigint)"
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L")


def _cells(df, row, feature, value, block, row_width):
    """Matrix entries with the number of their feature block and row block."""
    cells = df.select(F.col(row).cast("long").alias("_row"), F.col(feature).cast("long").alias("_f"),
                      F.col(value).cast("double").alias("_x"))
    return cells.withColumn("_b", _block("_f", block)).withColumn("_rows", _block("_row", row_width))


def write_blocks(cells, block, row_width):
    """Entries of each (feature block, strip of rows) as a file in the shared folder.

    Returns the table of the files: ``_b, files`` with the strips and names in order. A file counts
    once it is named there: files of lost attempts are never read. Entries without a row or a
    feature meet nothing and are left out.
    """
    folder = f"{shared_dir(cells.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"

    def save(key, pdf):
        b, strip = (int(k) for k in key)
        name = uuid.uuid4().hex
        fs, path = place(f"{folder}/{name}.arrow")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        table = pa.table({"f": (pdf["_f"].to_numpy() - b * block).astype("int32"),
                          "r": (pdf["_row"].to_numpy() - strip * row_width).astype("int32"), "x": pdf["_x"].to_numpy()})
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table, _ENTRIES)
        return pd.DataFrame({"_b": [b], "_rows": [strip], "name": [name]})

    met = cells.where(F.col("_row").isNotNull() & F.col("_f").isNotNull())
    files = staged(met.groupBy("_b", "_rows").applyInPandas(save, "_b long, _rows long, name string"), "blocks")
    return folder, files.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_rows", "name"))).alias("files"))


class _Product:
    """The product of two blocks, fed strip by strip."""

    def __init__(self, lb, rb, block, alone, ones=False):
        self.lb, self.rb, self.alone, self.ones = lb, rb, alone, ones  # alone: a block with itself, sent once
        self.shared = np.zeros((block, block))
        self.dots = self.shared if ones else np.zeros((block, block))
        self.squares, self.block = [np.zeros(block), np.zeros(block)], block

    def _dense(self, read):
        f, r, x = read
        width = 1 + int(r.max()) if len(r) else 0
        seen = np.zeros((width, self.block), dtype="float32")
        seen[r, f] = 1.0
        if self.ones:
            return None, seen
        m = np.zeros((width, self.block))
        m[r, f] = x
        return m, seen

    def add(self, *sides):
        """One strip: (features, rows, values) of the left and of the right block, or None."""
        dense = [None if side is None else self._dense(side) for side in sides]
        if self.alone:
            dense[1] = dense[0]
        for side, d in enumerate(dense):
            if d is not None and not self.ones:
                self.squares[side] += (d[0] * d[0]).sum(axis=0)
        if dense[0] is not None and dense[1] is not None:
            width = min(len(d[1]) for d in dense)
            if not self.ones:
                self.dots += dense[0][0][:width].T @ dense[1][0][:width]
            self.shared += dense[0][1][:width].T @ dense[1][1][:width]

    def cosines(self):
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.dots / np.outer(*(np.sqrt(s) for s in self.squares))

    def rows(self, i, j, score):
        """(left_id, right_id, score, shared) of some places."""
        return [i + self.lb * self.block, j + self.rb * self.block, score[i, j], self.shared[i, j].astype("int64")]


def _read(folder, name):
    fs, path = place(f"{folder}/{name}.arrow")
    with fs.open_input_file(path) as source:
        table = pa.ipc.open_file(source).read_all()
    return [c.to_numpy() for c in table.columns]


def common_strips(left, right, same):
    """(lb, rb): pairs of blocks with a common strip of rows."""
    l, r = (side.select(F.col("_b").alias(name), F.explode("files._rows").alias("_rows")) for side, name in ((left, "lb"), (right, "rb")))
    met = l.join(r, "_rows").select("lb", "rb").distinct()
    return met.where("lb <= rb") if same else met


def block_products(left, right, block, leave, schema, pairs=None, both=False, finish=None, ones=False, by=None):
    """Products of pairs of blocks, each in one task: ``leave(product)`` gives its columns.

    ``left`` and ``right`` come from ``write_blocks``; ``right=None`` is the left side again, where a
    pair is taken once unless ``both``. ``pairs`` replaces all pairs with a common strip. With
    ``finish`` the columns of up to 64 partners of a block meet in it before they leave. Without it
    a task has one right block or few: a written answer names its right ids in 9 or 10 bits. ``ones``: every
    entry is 1, so products are numbers of common rows and are not computed twice. ``by`` is the place of a column
    in whose order the products of some blocks leave, so that equal (rounded) values lie side by side.
    """
    same = right is None
    (lf, l), (rf, r) = left, left if same else right
    pairs = common_strips(l, r, same) if pairs is None else pairs
    if both:
        turned = F.struct(F.col("rb").alias("lb"), F.col("lb").alias("rb"))
        pairs = pairs.select(F.explode(F.array(F.struct("lb", "rb"), turned)).alias("_p")).select("_p.*").distinct()
    left_blocks = l.count()
    met = left_blocks * r.count()
    tasks = max(1, min(met, max(min(met // 16, _TASKS), l.sparkSession.sparkContext.defaultParallelism)))
    some = max(1, -(-met // tasks))  # left blocks next to one right block in a task
    group = F.expr(f"rb div {_PARTNERS}") if finish else _block("lb", some)
    met = (pairs.join(l.select(F.col("_b").alias("lb"), F.col("files").alias("lf")), "lb")
           .join(r.select(F.col("_b").alias("rb"), F.col("files").alias("rf")), "rb")
           .select("lb", "rb", "lf", "rf", group.alias("_group")))
    if finish:
        met = met.repartition(tasks, "lb", "_group").sortWithinPartitions("lb", "rb")
    else:
        groups = -(-left_blocks // some)  # of one right block, side by side; ids with gaps are only less even
        task = F.expr(f"cast(pmod(pmod(rb, {tasks}L) * {groups}L + pmod(_group, {tasks}L), {tasks}L) as int)")
        met = met.repartitionById(tasks, task).sortWithinPartitions("rb", "lb")

    def multiply(row):
        alone = same and row["lb"] == row["rb"]
        product = _Product(row["lb"], row["rb"], block, alone, ones)
        names = [{f["_rows"]: f["name"] for f in row[side]} for side in ("lf", "rf")]
        for strip in sorted({*names[0], *names[1]}):
            sides = [_read(folder, n[strip]) if strip in n else None for folder, n in zip((lf, rf), names if not alone else (names[0], {}))]
            product.add(*sides)
        return leave(product)

    def run(batches):
        held, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                found = multiply(row)
                if finish is None:
                    yield as_batch(found)
                    continue
                if held is not None and now != (row["lb"], row["_group"]):
                    yield as_batch(held)
                    held = None
                held, now = finish(found if held is None else [np.concatenate(c) for c in zip(held, found)]), (row["lb"], row["_group"])
        if held is not None:
            yield as_batch(held)

    def run_in_order(batches):
        held, count = [], 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            held.append(multiply(row))
            count += len(held[-1][0])
            if count >= _ORDERED:
                yield from in_order(held)
                held, count = [], 0
        if held:
            yield from in_order(held)

    def in_order(parts):
        columns = []
        while parts[0]:  # one column at a time is there twice
            columns.append(np.concatenate([part.pop(0) for part in parts]))
        order = np.argsort(columns[by])
        for lo in range(0, len(order), _ENTRIES // 8):
            yield as_batch([c[order[lo:lo + _ENTRIES // 8]] for c in columns])

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def as_batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return met.mapInArrow(run if by is None else run_in_order, schema)


def sparse_products(entries, row, feature, value, block=BLOCK, row_width=TOKEN_WIDTH):
    """Dot products of all feature pairs i <= j that share a row of a sparse matrix.

    ``entries`` has one value per (row, feature). Result: ``feature_i, feature_j, dot,
    shared`` with ``shared`` = number of common rows.
    """
    def leave(product):
        i, j = np.nonzero(np.triu(product.shared) if product.alone else product.shared)
        return product.rows(i, j, product.dots)

    return block_products(write_blocks(_cells(entries, row, feature, value, block, row_width), block, row_width), None,
                          block, leave, "feature_i long, feature_j long, dot double, shared long")


def sparse_cosines(entries, row, feature, value, block=BLOCK, row_width=TOKEN_WIDTH):
    """Cosines of all feature pairs i < j that share a row: ``feature_i, feature_j, cosine, shared``;
    NaN with a feature of zero length."""
    def leave(product):
        i, j = np.nonzero(np.triu(product.shared, 1) if product.alone else product.shared)
        return product.rows(i, j, product.cosines())

    return block_products(write_blocks(_cells(entries, row, feature, value, block, row_width), block, row_width), None,
                          block, leave, "feature_i long, feature_j long, cosine double, shared long", by=2)


def sparse_cross(left, right, row, feature, value, block=BLOCK, row_width=TOKEN_WIDTH, ones=False):
    """Dot products of the features of two sparse matrices over their common rows.

    Result: ``left_id, right_id, dot, shared`` for pairs with at least one common row. ``ones``: every value
    is 1, so both are the number of common rows, which leaves a task once.
    """
    def leave(product):
        i, j, dot, shared = product.rows(*np.nonzero(product.shared), product.dots)
        return [i, j, shared] if ones else [i, j, dot, shared]

    l, r = (write_blocks(_cells(df, row, feature, value, block, row_width), block, row_width) for df in (left, right))
    found = block_products(l, r, block, leave, "left_id long, right_id long, shared long" if ones else "left_id long, right_id long, dot double, shared long", ones=ones)
    return found.select("left_id", "right_id", F.col("shared").cast("double").alias("dot"), "shared") if ones else found


def _left_rows(left, left_id, vec, blocks):
    """Left vectors in even tasks: each is compared with every block, so a task has few rows."""
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(blocks, _TASKS))
    return left.select(F.col(left_id).cast("long").alias("_l"), F.col(vec).cast("array<double>").alias("_v")) \
        .where(F.col("_l").isNotNull()).repartition(tasks)


def _parts(batches):
    """(ids, matrix) of short slices of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield part.column(0).to_numpy(), matrix(part.column(1))


def _tiles(slabs, rows):
    """Names of consecutive slabs, put together up to that many rows."""
    tiles, held = [], 0
    for uri, units in slabs:
        if not tiles or held + units > rows:
            tiles.append([])
            held = 0
        tiles[-1].append(uri)
        held += units
    return tiles


def _gathered(uris):
    """(ids, matrix) of some slabs."""
    slabs = [open_slab(uri) for uri in uris]
    return np.concatenate([s.ids for s in slabs]), np.concatenate([s.w_enc for s in slabs])


def dense_products(left, right, left_id="id", right_id="id", vec="vec", block=BLOCK):
    """Every dot product of a left row with a right row: ``left_id, right_id, dot``.

    Both sides lie in slabs of ``block`` rows. A task multiplies tiles of some slabs of either side, and a
    tile leaves by rising product: equal (rounded) products lie side by side and a tile's ids are few,
    so that a written answer takes half the bytes.
    """
    r = write_rows(right, right_id, vec, block)
    l = r if left is right and left_id == right_id else write_rows(left, left_id, vec, block)
    spark, rows = right.sparkSession, _TILE
    cores = spark.sparkContext.defaultParallelism
    lefts, rights = (_tiles(side, n) for side, n in zip((l, r), rows))
    while len(lefts) * len(rights) < min(2 * cores, len(l) * len(r)):
        rows = [n // 2 for n in rows]
        lefts, rights = (_tiles(side, n) for side, n in zip((l, r), rows))
    met = len(lefts) * len(rights)
    some = max(1, -(-met // max(_TASKS, cores)))  # tiles of a task: one left tile, or few, next to right ones

    def run(batches):
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                a, b = divmod(tile, len(rights))
                (li, lv), (ri, rv) = _gathered(lefts[a]), _gathered(rights[b])
                dots = (lv @ rv.T).ravel()
                order = np.argsort(dots)
                for lo in range(0, len(order), _ENTRIES // 8):
                    at = order[lo:lo + _ENTRIES // 8]
                    i, j = np.divmod(at, len(ri))
                    yield pa.RecordBatch.from_arrays([pa.array(li[i]), pa.array(ri[j]), pa.array(dots[at])], ["left_id", "right_id", "dot"])

    return spark.range(met).repartitionById(max(1, -(-met // some)), F.expr(f"cast(id div {some}L as int)")) \
        .mapInArrow(run, "left_id long, right_id long, dot double")


def nearest_products(left, right, left_id="id", right_id="id", vec="vec", exclude_self=False, block=BLOCK):
    """For each left row the right row with the largest dot product (lowest id on ties).

    A left row with no candidate has null ``nearest_id`` and ``similarity``. Only the best of each
    left row leaves its task.
    """
    ids = left.select(F.col(left_id).cast("long").alias("left_id"))
    slabs = write_rows(right, right_id, vec, block)

    def run(batches):
        for li, rows in _parts(batches):
            best, at = np.full(len(li), -np.inf), np.zeros(len(li), "int64")
            for uri, _ in slabs:
                slab = open_slab(uri)
                dots = rows @ slab.w_enc.T
                if exclude_self:
                    dots[li[:, None] == slab.ids[None, :]] = -np.inf
                place = dots.argmax(axis=1)
                top = dots[np.arange(len(li)), place]
                better = np.isfinite(top) & (top > best)
                best[better], at[better] = top[better], slab.ids[place[better]]
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(li[ok]), pa.array(at[ok]), pa.array(best[ok])], ["left_id", "right_id", "dot"])

    found = _left_rows(left, left_id, vec, len(slabs)).mapInArrow(run, "left_id long, right_id long, dot double")
    top = found.groupBy("left_id").agg(
        F.max(F.struct("dot", (-F.col("right_id")).alias("neg"))).alias("_m"))
    return (ids.join(top, "left_id", "left")
            .select("left_id", (-F.col("_m.neg")).alias("nearest_id"),
                    F.col("_m.dot").alias("similarity")))
