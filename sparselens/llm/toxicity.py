"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model also reads the
log-odds that the earlier ones gave. In training those come from models of other folds, so
a later model learns from log-odds as uncertain as those it meets in use.

``labels`` has one flag, toxic. The categories before it are read from the labelled documents:
a toxic document belongs to a category when it has one of the category's words, and to
``unlisted`` when it has none (other languages). The last link is the flag itself.

Models are fitted on at most ``limit`` labelled documents (those with the lowest hash of their
id); every document is scored, whole. Nulls: a null text counts as empty and is not toxic unless
the empty text is; a null ``doc_id`` is kept. Without labels nothing is toxic (probability 0).
Repeated rows are scored alike.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import sliced
from sparselens.llm.textmodel import CONTENT, Logistic, Words, labelled_sample, piece_matrix, select_pieces, sigmoid

#: Words that make a labelled toxic document one of the category.
CATEGORIES = {
    "insult": ("idiot", "moron", "clown", "loser", "stupid"),
    "contempt": ("pathetic", "worthless", "trash", "scum", "disgusting"),
}
CHAIN = (*CATEGORIES, "unlisted", "toxic")
FOLDS, LIMIT, PIECES = 4, 10_000, 250


def category_columns():
    """0/1 columns of a labelled document, one a link of the chain."""
    has = {k: F.lower("text").rlike(r"\b(?:" + "|".join(words) + r")\b") for k, words in CATEGORIES.items()}
    any_word = F.coalesce(F.lower("text").rlike(r"\b(?:" + "|".join(sum(CATEGORIES.values(), ())) + r")\b"), F.lit(False))
    toxic = F.col("_toxic") > 0
    return {**{k: (toxic & F.coalesce(c, F.lit(False))).cast("int") for k, c in has.items()},
            "unlisted": (toxic & ~any_word).cast("int"), "toxic": toxic.cast("int")}


class Chain:
    """Linear models in a row over piece columns and earlier log-odds."""

    def __init__(self, pieces):
        self.pieces, self.models = pieces, []

    def fit(self, x, targets, folds):
        for y in targets.T:
            held = np.zeros(len(y), np.float32)
            for f in range(FOLDS):
                out = folds == f
                if out.any() and not out.all():
                    held[out] = Logistic().fit(x[~out], y[~out]).logit(x[out])
            self.models.append(Logistic().fit(x, y))
            x = np.hstack([x, np.clip(held, -8, 8)[:, None]])
        return self

    def predict(self, x):
        """Log-odds of every link."""
        odds = []
        for model in self.models:
            odds.append(model.logit(x))
            x = np.hstack([x, np.clip(odds[-1], -8, 8)[:, None]])
        return np.stack(odds, axis=1)


def features(texts, chosen):
    words = Words(texts)
    return np.hstack([piece_matrix(words, chosen), words.numbers()])


def fit_chain(docs, labels, limit=LIMIT, per_category=PIECES):
    """A fitted chain, or None without labelled documents."""
    labelled = labelled_sample(docs.select("doc_id", "text"), labels, ["toxic"], limit)
    labelled = labelled.withColumns({f"_{k}": c for k, c in category_columns().items()})
    targets = [f"_{k}" for k in CHAIN]
    chosen = select_pieces(labelled, targets, per_category)

    def run(batches):
        for batch in sliced(batches, 1):
            words = Words(batch.column(1))
            x = np.packbits(piece_matrix(words, chosen).astype(bool), axis=1)
            numbers = words.numbers().astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in numbers], pa.binary()),
                 *batch.columns[2:]], ["_id", "x", "numbers", *targets])

    shape = "_id long, x binary, numbers binary, " + ", ".join(f"{t} int" for t in targets)
    rows = labelled.select("_id", "text", *targets).mapInArrow(run, shape).toPandas().sort_values("_id")  # at most limit short rows
    if not len(rows):
        return None
    bits = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in rows.x]), axis=1, count=len(chosen)) if len(chosen) \
        else np.zeros((len(rows), 0), np.uint8)
    numbers = np.stack([np.frombuffer(r, "<f4") for r in rows.numbers]).reshape(len(rows), len(CONTENT))
    folds = rows["_id"].to_numpy() % 104_729 % FOLDS
    return Chain(chosen).fit(np.hstack([bits.astype(np.float32), numbers]), rows[targets].to_numpy(np.float32), folds)


def score_toxicity(docs, labels, threshold=0.5, limit=LIMIT):
    """(doc_id, p_<category> ..., p_toxic, toxic) for every document."""
    chain = fit_chain(docs, labels, limit)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred numbers a link
    names = [f"p_{k}" for k in CHAIN]

    def run(batches):
        model = sent.value
        for batch in sliced(batches, 1):
            odds = np.full((batch.num_rows, len(CHAIN)), -np.inf) if model is None else \
                model.predict(features(batch.column(1), model.pieces)).astype(np.float64)
            p = np.where(np.isinf(odds), 0.0, sigmoid(np.maximum(odds, -30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pc.greater_equal(pa.array(p[:, -1]), threshold)],
                                             ["doc_id", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
