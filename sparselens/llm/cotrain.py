"""Quality classifier by co-training of two views.

The text view reads a document's words (hashed pieces and word statistics), the page view what
is known about it without reading them: language, source, length, line layout, marks. One Arrow
pass writes what both views read of every document, some 150 bytes each, as a table in the shared
folder. In each round both views score every unlabelled document. In each stratum (hashed
language and source) a view hands its surest ``SHARE`` of the documents, beyond ``CONFIDENT``, to the
other view with the label it gives them; the cut is a cell of confidence, and cells are handed over
whole, so ties stay together. Then both views are fitted again: Newton steps over the labelled
documents and all those handed over, whose gradients and curvatures tasks add up. Who was handed
what is a function of a document's own numbers and the rounds so far, so no labels travel and nothing
that the driver holds grows with the corpus. In the end each view is calibrated on labelled
documents that no fit has seen, the calibrated log-odds are combined, and all documents are scored.

The labelled documents are a sample of at most ``limit`` (lowest hashes of the id); everything else
covers all documents, whole texts of any length. Documents handed over weigh half a labelled one
while they are few, and all of a view's together never more than half the labelled ones, so the fit
behaves alike at every size. Nulls: a null text counts as empty, null language and source as values of
their own, a null ``n_chars`` as zero; a document without id is an unlabelled one. Without labels of
both kinds every document has probability 0.5 and stays. Repeated rows count repeatedly and are scored
alike. An empty table gives an empty result; other columns may have any name.
"""

import copy
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import box_schema, boxed, sliced, staged
from sparselens.llm.textmodel import (CONTENT, LAYOUT, Logistic, Words, bent, labelled_sample, layout_numbers, piece_matrix,
                                      select_pieces, sigmoid, sums)

LIMIT, PIECES = 10_000, 500
ROUNDS, SHARE, CONFIDENT, WEIGHT = 3, 0.1, 0.98, 0.5
#: Hashed places for a language and for a source; a pair of them is a stratum.
PLACES = 32
#: Cells of confidence beyond ``CONFIDENT``, in eighths of log-odds; the last is open.
CELLS = 128
#: Newton steps, at most, of the first fit and of one after an exchange; each of the latter is one pass over the features.
FIRST, NEWTON = 40, 4

TABLE = "doc_id long, free boolean, x binary, numbers binary, places binary"


def features(texts, lang, source, n_chars, pieces):
    """What both views read of a batch: bits of the chosen pieces, numbers, places of language and source."""
    words = Words(texts)
    length = np.log1p(np.maximum(0, pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False)))
    places = np.empty((len(texts), 2), np.uint8)
    for k, names in enumerate((lang, source)):
        coded = names.dictionary_encode(null_encoding="encode")
        at = np.array([zlib.crc32(repr(v).encode()) % PLACES for v in coded.dictionary.to_pylist()], np.uint8)
        places[:, k] = at[coded.indices.to_numpy(zero_copy_only=False)]
    numbers = np.hstack([words.numbers(), layout_numbers(texts), length[:, None]]).astype("<f4")
    return piece_matrix(words, pieces).astype(bool), numbers, places


def packed(bits, numbers, places):
    return [pa.array([r.tobytes() for r in m], pa.binary()) for m in (np.packbits(bits, axis=1), numbers, places)]


def unpacked(x, numbers, places, n_pieces):
    """The features again, from their three binary columns."""
    wide = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return np.unpackbits(wide(x, np.uint8), axis=1, count=n_pieces).astype(bool), wide(numbers, "<f4"), wide(places, np.uint8)


def view_matrices(bits, numbers, places):
    """(text view, page view), one row a document."""
    content, layout, rest = np.split(numbers, [len(CONTENT), len(CONTENT) + len(LAYOUT)], axis=1)
    hot = np.zeros((len(bits), 2 * PLACES), np.float32)
    hot[np.arange(len(bits))[:, None], places + np.array([0, PLACES])] = 1
    return np.hstack([bits, bent(content)]).astype(np.float32), np.hstack([bent(layout), rest, hot]).astype(np.float32)


class View:
    """Ridge logistic regression on standardised columns, by Newton steps over sums that tasks can add up."""

    def __init__(self, x, penalty=3e-3):
        self.mean, self.scale, self.penalty = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3), penalty
        self.w = np.zeros(x.shape[1] + 1)

    def logit(self, x):
        w = self.w[:-1] / self.scale
        return x @ w.astype(np.float32) + np.float32(self.w[-1] - self.mean @ w)

    def slopes(self, x, y):
        """Gradient and curvature of the rows' loss as one vector."""
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1), np.float32)])
        p = sigmoid(z @ self.w.astype(np.float32))
        bend = (z * (p * (1 - p))[:, None].astype(np.float32)).T @ z
        return np.concatenate([(p - y).astype(np.float32) @ z, bend.ravel()]).astype(np.float64)

    def step(self, total, weight):
        """One step from the sums of ``slopes`` over rows that weigh ``weight`` together; the longest move of a weight."""
        ridge = np.full(len(self.w), self.penalty)
        ridge[-1] = 1e-9
        slope = total[:len(ridge)] / weight + ridge * self.w
        move = np.linalg.solve(total[len(ridge):].reshape(len(ridge), -1) / weight + np.diag(ridge), slope)
        move /= max(1.0, np.abs(move).max())
        self.w = self.w - move
        return np.abs(move).max()


def confidence(model, x):
    """(label given, cell of confidence or -1 below ``CONFIDENT``) of each row."""
    odds = model.logit(x)
    cell = np.floor((np.abs(odds) - np.log(CONFIDENT / (1 - CONFIDENT))) * 8)
    return (odds > 0).astype(np.int64), np.clip(cell, -1, CELLS - 1).astype(np.int64)


def strata(places):
    return places[:, 0].astype(np.int64) * PLACES + places[:, 1]


def handed(views, stratum, history):
    """The label that each view was handed for each row, -1 where none; one row a view."""
    label = np.full((2, len(stratum)), -1, np.int8)
    for models, cuts in history:
        for v in (0, 1):
            kind, cell = confidence(models[v], views[v])
            pick = (label[1 - v] < 0) & (cell >= cuts[v, kind, stratum])
            label[1 - v][pick] = kind[pick]
    return label


def count_confident(views, stratum, history, models):
    """Rows by view, label, stratum and cell that could be handed over, then rows by stratum."""
    label, out = handed(views, stratum, history), []
    for v in (0, 1):
        kind, cell = confidence(models[v], views[v])
        free = (label[1 - v] < 0) & (cell >= 0)
        at = (kind[free] * PLACES ** 2 + stratum[free]) * CELLS + cell[free]
        out.append(np.bincount(at, minlength=2 * PLACES ** 2 * CELLS))
    return np.concatenate([*out, np.bincount(stratum, minlength=PLACES ** 2)]).astype(np.float64)


def choose_cuts(counts):
    """(lowest cell handed over by view, label and stratum; rows that each view is handed)."""
    rows, counts = counts[-PLACES ** 2:], counts[:-PLACES ** 2].reshape(2, 2, PLACES ** 2, CELLS)
    above = counts[..., ::-1].cumsum(axis=-1)[..., ::-1] - counts  # rows surer than the cell's
    take = above < SHARE * rows[:, None]
    cuts = np.where(take.any(axis=-1), take.argmax(axis=-1), CELLS)
    return cuts, (counts * take).sum(axis=(1, 2, 3))[::-1]


class CoTrained:
    """Two fitted views and their calibrated combination."""

    def fit(self, views, y, calibrating, over_free):
        """Labelled rows come as matrices, of which ``calibrating`` ones are kept for calibration. ``over_free(make)``
        is the sum of ``make(views, stratum)`` over batches of all unlabelled documents, None if there are none."""
        known, want = [x[~calibrating] for x in views], y[~calibrating].astype(np.float32)
        self.models, history, taught = [View(x) for x in known], [], np.zeros(2)
        for model, x in zip(self.models, known):
            for _ in range(FIRST):
                if model.step(model.slopes(x, want), len(want)) < 1e-3:
                    break
        for _ in range(ROUNDS):
            models = copy.deepcopy(self.models)
            counts = over_free(lambda x, s, models=models: count_confident(x, s, history, models))
            if counts is None:
                break
            cuts, more = choose_cuts(counts)
            if not more.any():
                break
            history, taught = [*history, (models, cuts)], taught + more
            self.refit(known, want, history, taught, over_free)
        known = calibrating if len(set(y[calibrating])) == 2 else np.ones(len(y), bool)
        odds = [m.logit(x[known]) for m, x in zip(self.models, views)]
        self.calibration = [Logistic().fit(o[:, None], y[known], penalty=1e-4) for o in odds]
        fixed = np.stack([c.logit(o[:, None]) for c, o in zip(self.calibration, odds)], axis=1)
        self.joint = Logistic().fit(fixed, y[known], penalty=1e-3)
        return self

    def refit(self, known, want, history, taught, over_free):
        """Newton steps of both views over the labelled rows and all rows they were handed."""
        weight = WEIGHT * len(want) / (len(want) + taught)
        for _ in range(NEWTON):
            now = copy.deepcopy(self.models)

            def slopes(views, stratum):
                label = handed(views, stratum, history)
                return np.concatenate([m.slopes(x[t >= 0], t[t >= 0]) for m, x, t in zip(now, views, label)])

            size = len(now[0].w) * (len(now[0].w) + 1)
            parts = np.split(over_free(slopes), [size])
            moves = [m.step(m.slopes(x, want) + w * p, len(want) + w * n)
                     for m, x, p, w, n in zip(self.models, known, parts, weight, taught)]
            if max(moves) < 1e-3:
                break

    def predict(self, text, page):
        """Calibrated probabilities of the text view, the page view and both."""
        fixed = np.stack([c.logit(m.logit(x)[:, None]) for m, c, x in zip(self.models, self.calibration, (text, page))], axis=1)
        return *sigmoid(fixed).T.astype(np.float64), sigmoid(self.joint.logit(fixed)).astype(np.float64)


def views(docs):
    """The columns the classifier reads; those that are missing are null."""
    have = {c.lower() for c in docs.columns}
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return {c: (F.col(c) if c in have else F.lit(None)).cast(k) for c, k in kinds.items()}


def narrow(docs):
    return docs.select(*(c.alias(k) for k, c in views(docs).items()))


def feature_table(docs, pieces, known):
    """The features of every row, staged; rows whose id is in ``known`` (the labelled sample) are not free."""
    def run(batches):
        for batch in sliced(batches, 1):
            ids = batch.column(0)
            free = pa.array(~pc.is_in(ids, pa.array(known, pa.int64())).to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, free, *packed(*features(*batch.columns[1:5], pieces))], [c.split()[0] for c in TABLE.split(", ")])

    return staged(narrow(docs).mapInArrow(run, TABLE), "features")


def fit_quality(docs, labels, limit=LIMIT):
    """(pieces, fitted views, feature table), or None when the labels don't show both kinds."""
    labelled = labelled_sample(narrow(docs), labels, ["quality"], limit).withColumn("_y", (F.col("_quality") > 0).cast("int"))
    pieces = select_pieces(labelled, ["_y"], PIECES)

    def run(batches):
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed(*features(*batch.columns[1:5], pieces)), batch.column(5)],
                                             ["doc_id", "x", "numbers", "places", "y"])

    rows = labelled.select("doc_id", "text", "lang", "source", "n_chars", "_y")
    got = rows.mapInArrow(run, "doc_id long, x binary, numbers binary, places binary, y int").toPandas().sort_values("doc_id")  # at most limit rows
    y, ids = got.y.to_numpy(), got.doc_id.to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return None
    matrices = view_matrices(*unpacked(*(pa.array(got[c], pa.binary()) for c in ("x", "numbers", "places")), len(pieces)))
    table = feature_table(docs, pieces, ids)
    # what tasks send together stays at two vectors a core, however many files there are
    free = table.where("free").select("x", "numbers", "places").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)

    def over_free(make):
        def read(batch):
            got = unpacked(*batch.columns, len(pieces))
            return make(view_matrices(*got), strata(got[2]))

        return sums(free, ["x", "numbers", "places"], read)

    calibrating = ids % 104_729 % 5 == 0
    if not {0, 1} <= set(y[~calibrating]):
        calibrating[:] = False
    return pieces, CoTrained().fit(matrices, y, calibrating, over_free), table


def score_quality(docs, labels, threshold=0.5, limit=LIMIT):
    """(doc_id, p_text, p_page, p_quality, kept) for every document."""
    shape, fitted = "doc_id long, p_text double, p_page double, p_quality double, kept boolean", fit_quality(docs, labels, limit)
    if fitted is None:
        half = [F.lit(0.5).alias(c) for c in ("p_text", "p_page", "p_quality")]
        return narrow(docs).select("doc_id", *half, F.lit(0.5 >= threshold).alias("kept"))
    pieces, model, table = fitted
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, 1):
            p = sent.value.predict(*view_matrices(*unpacked(*batch.columns[1:], len(pieces))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= threshold)],
                                             ["doc_id", "p_text", "p_page", "p_quality", "kept"])

    return table.select("doc_id", "x", "numbers", "places").mapInArrow(run, shape)


def keep_quality(docs, labels, threshold=0.5, limit=LIMIT):
    """The documents that score at least ``threshold``, all columns as they are; nothing is shuffled."""
    fitted = fit_quality(docs, labels, limit)
    if fitted is None:
        return docs if 0.5 >= threshold else docs.limit(0)
    pieces, model, _ = fitted
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, 1):
            p = sent.value.predict(*view_matrices(*features(*batch.columns[1:], pieces)))
            yield batch.select([0]).filter(pa.array(p[2] >= threshold))

    return boxed(docs, **views(docs)).drop("doc_id").mapInArrow(run, box_schema(docs)).select("row.*")
