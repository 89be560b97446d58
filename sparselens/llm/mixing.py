"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document its probabilities of the domains
``high``, ``low`` and ``toxic``. A document is given a rate r (how often it is used on average), and
a domain's expected tokens are the sum of rate x words x probability. Accelerated projected
gradient steps fit rates between 0 and ``max_rate``, starting at 1, by least squares to the
targets, each domain scaled by the length of its column. A step needs just the domains'
totals, one aggregation over all documents; a document's rate is a function of its own numbers
and the totals so far, so no rates travel. In the end a rate becomes whole copies: its floor,
plus one when a hash of the row is below the fraction.

The classifier is fitted on at most ``limit`` labelled documents (lowest hashes of the id);
everything else covers all documents. Nulls: a null text has no words, keeps rate 1 and one
copy. Without labels all domains are equally likely. Repeated rows share their rate and number
of copies. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselens.llm.common import box_schema, boxed, sliced, staged
from sparselens.llm.textmodel import Logistic, Words, labelled_sample, piece_matrix, select_pieces, sigmoid

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.93, "low": 0.04, "toxic": 0.03}
NUMBERS = ["words", *(f"p_{d}" for d in DOMAINS)]
LIMIT, PIECES, MAX_RATE, STEPS, NEAR = 8_000, 150, 2.0, 40, 1e-3


class Domains:
    """One linear model a domain; the probabilities are made to sum to one."""

    def __init__(self, pieces, models):
        self.pieces, self.models = pieces, models

    def predict(self, words, x=None):
        x = np.hstack([piece_matrix(words, self.pieces), words.numbers()]) if x is None else x
        p = sigmoid(np.stack([m.logit(x) for m in self.models], axis=1)).astype(np.float64) + 1e-9
        return p / p.sum(axis=1, keepdims=True)


def fit_domains(docs, labels, limit=LIMIT):
    """The fitted domains, or None without labelled documents."""
    toxic, good = F.col("_toxic") > 0, F.col("_quality") > 0
    rows = labelled_sample(docs.select("doc_id", "text"), labels, ["quality", "toxic"], limit).select(
        "_id", "text", (good & ~toxic).cast("int").alias("_high"), (~good & ~toxic).cast("int").alias("_low"), toxic.cast("int").alias("_toxic"))
    targets = [f"_{d}" for d in DOMAINS]
    pieces = select_pieces(rows, targets, PIECES)

    def run(batches):
        for batch in sliced(batches, 1):
            words = Words(batch.column(1))
            x = np.packbits(piece_matrix(words, pieces).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.tobytes() for r in words.numbers().astype("<f4")], pa.binary()), *batch.columns[2:]], ["_id", "x", "numbers", *targets])

    got = rows.mapInArrow(run, "_id long, x binary, numbers binary, " + ", ".join(f"{t} int" for t in targets)).toPandas().sort_values("_id")
    if not len(got):
        return None
    bits = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in got.x]), axis=1, count=len(pieces)) if len(pieces) else np.zeros((len(got), 0))
    x = np.hstack([bits.astype(np.float32), np.stack([np.frombuffer(r, "<f4") for r in got.numbers])])
    return Domains(pieces, [Logistic().fit(x, got[t].to_numpy()) for t in targets])


def with_posteriors(docs, labels, limit=LIMIT):
    """Boxed rows with the columns words and p_<domain>; one Arrow pass, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_domains(docs, labels, limit))

    def run(batches):
        for batch in sliced(batches, 1):
            words = Words(batch.column(1))
            p = np.full((batch.num_rows, len(DOMAINS)), 1 / len(DOMAINS)) if sent.value is None else sent.value.predict(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts.astype(np.int64)), *map(pa.array, p.T)], ["row", *NUMBERS])

    shape = box_schema(docs, words=T.LongType(), **{c: T.DoubleType() for c in NUMBERS[1:]})
    return boxed(docs, text=F.col("text").cast("string")).mapInArrow(run, shape)


def rate_of(a, steps, max_rate):
    """Rates after ``steps`` [(gradient's residual, step length, momentum)] from the documents' scaled rows ``a``."""
    rate = ahead = np.ones(len(a))
    for residual, length, momentum in steps:
        moved = np.clip(ahead - length * (a @ residual), 0, max_rate)
        rate, ahead = moved, moved + momentum * (moved - rate)
    return rate, ahead


def fit_rates(scored, targets, max_rate=MAX_RATE, most=STEPS, near=NEAR):
    """(scale of each domain, steps): what ``rate_of`` needs; ``scored`` has words and p_<domain>."""
    k = len(DOMAINS)
    tokens = [F.col("words") * F.col(c) for c in NUMBERS[1:]]
    sums = [F.sum(x * y) for x in tokens for y in tokens]
    first = scored.agg(F.sum("words").alias("n"), F.array(*(F.coalesce(s, F.lit(0.0)) for s in sums)).alias("s")).first()
    if not first["n"]:
        return np.ones(k), []
    square = np.array(first["s"]).reshape(k, k)
    scale = np.sqrt(np.maximum(np.diag(square), 1e-12))
    length = 1 / np.linalg.eigvalsh(square / np.outer(scale, scale))[-1]
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS]) / sum(targets.values()) * first["n"] / scale

    def totals(steps):
        def run(batches):
            for batch in batches:
                a = batch.column(0).to_numpy()[:, None] * np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1) / scale
                rate, ahead = rate_of(a, steps, max_rate)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*[[x] for x in a.T @ rate], *[[x] for x in a.T @ ahead])], names)

        names = [f"t{i}" for i in range(2 * k)]
        got = scored.select(*NUMBERS).mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n) for n in names)).first()
        return np.array(got[:k]) - goal, np.array(got[k:]) - goal

    steps, pace = [], 1.0
    residual, ahead = totals(steps)
    best, enough = np.linalg.norm(residual), near * np.linalg.norm(goal)
    while len(steps) < most and best > enough:
        faster = (1 + np.sqrt(1 + 4 * pace ** 2)) / 2
        steps.append((ahead, length, (pace - 1) / faster))
        pace = faster
        residual, ahead = totals(steps)
        size = np.linalg.norm(residual)
        if len(steps) > 8 and abs(best - size) <= 1e-4 * enough:  # bounds keep it from the goal
            break
        best = size
    return scale, steps


def mixed(scored, targets=None, max_rate=MAX_RATE):
    """``scored`` with the columns rate and copies."""
    scale, steps = fit_rates(scored, targets or TARGETS, max_rate)

    def run(batches):
        for batch in batches:
            n, *p, draw = (c.to_numpy() for c in batch.columns[1:])
            rate = rate_of(n[:, None] * np.stack(p, axis=1) / scale, steps, max_rate)[0]
            copies = np.floor(rate) + (draw < rate - np.floor(rate))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rate), pa.array(copies.astype(np.int64))],
                                             ["row", *NUMBERS, "rate", "copies"])

    draw = F.pmod(F.xxhash64("row.doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    shape = T.StructType([*scored.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())])
    return scored.select("row", *NUMBERS, draw.alias("draw")).mapInArrow(run, shape)


def mixing_rates(docs, labels, targets=None, limit=LIMIT):
    """(doc_id, n_words, p_<domain> ..., rate, copies) for every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = staged(with_posteriors(docs, labels, limit).withColumn("row", F.struct("row.doc_id")), "posteriors")
    return mixed(scored, targets).select("row.doc_id", F.col("words").alias("n_words"), *NUMBERS[1:], "rate", "copies")


def mix(docs, labels, targets=None, limit=LIMIT):
    """The documents, each as often as its rate came out in whole copies."""
    scored = staged(with_posteriors(docs, labels, limit), "posteriors")
    times = F.explode(F.expr("array_repeat(0, int(copies))"))
    return mixed(scored, targets).select("row", times.alias("copy")).select("row.*")
