"""Hashed text features in Arrow batches and small linear models in numpy.

A document has the hashed pieces of its words: byte 4- and 6-grams of ``^word$`` and the whole
word. Pieces count once a document. Models use only the pieces that a selection over the labelled
documents keeps, so a scoring pass looks at the few words that hold one of them.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import sliced, staged, words_of

BITS = 18
GRAMS = (4, 6)
#: Names of the numbers ``Words.numbers`` and ``layout_numbers`` give.
CONTENT = ("log_words", "distinct_share", "mean_length", "upper_share", "letter_share", "echo_share", "distinct_power")
LAYOUT = ("log_chars", "log_lines", "log_line_length", "line_repeats", "mark_share", "space_share", "digit_share")
MARKS = r"[#*$%&|<>!=~_{}\[\]\\^]"


def pieces(unique):
    """(word index, piece) of an Arrow array of words, repeats included."""
    n = len(unique)
    big = pa.large_string()
    framed = pc.binary_join_element_wise(pa.scalar("^", big), unique, pa.scalar("$", big), pa.scalar("", big))
    sizes = pc.binary_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(framed.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))  # bytes up to the word's end
    mult, words, found = np.uint64(0x9E3779B97F4A7C15), [], []
    with np.errstate(over="ignore"):
        code = np.zeros(len(raw), np.uint64)
        for i in range(min(max(GRAMS), len(raw))):
            code = (code[:len(raw) - i] ^ raw[i:]) * mult
            code ^= code >> np.uint64(29)
            if i + 1 in GRAMS:
                inside = left[:len(code)] > i
                words.append(owner[:len(code)][inside]), found.append(code[inside] * mult)
        power = np.cumprod(np.full(int(sizes.max(initial=1)), mult | np.uint64(1)))
        position = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.add.reduceat((raw + np.uint64(1)) * power[position], np.cumsum(sizes) - sizes) if n else raw
        words.append(np.arange(n)), found.append((whole ^ whole >> np.uint64(31)) * mult)
    found = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(words), found


def distinct(values):
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Words:
    """The words of a batch of texts, spelled as they are, and which document has which."""

    def __init__(self, texts):
        self.codes, self.unique, bounds = words_of(texts, lower=False)
        self.counts, self.size = np.diff(bounds), max(1, len(self.unique))
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        pairs = distinct(doc * np.int64(self.size) + self.codes)
        self.doc, self.each, self.code = doc, pairs // self.size, pairs % self.size

    def pieces(self, wanted=None):
        """Distinct (document, piece); ``wanted`` (bool per piece) keeps only those."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, piece = pieces(pc.ascii_lower(self.unique))
        if wanted is not None:
            keep = wanted[piece]
            word, piece = word[keep], piece[keep]
        piece = piece[np.argsort(word, kind="stable")]
        count = np.bincount(word, minlength=len(self.unique))
        start = np.cumsum(count) - count
        has = count[self.code] > 0
        doc, code = self.each[has], self.code[has]
        size = count[code]
        at = np.repeat(start[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = distinct(np.repeat(doc, size) << BITS | piece[at])
        return both >> BITS, both & ((1 << BITS) - 1)

    def numbers(self):
        """One row of CONTENT numbers a document."""
        n = self.counts
        seen = np.bincount(self.each, minlength=len(n))
        sums = []
        for of in (pc.utf8_length(self.unique), *(pc.count_substring_regex(self.unique, r) for r in (r"\p{Lu}", r"\p{L}"))):
            of = of.to_numpy(zero_copy_only=False).astype(np.float64)
            sums.append(np.bincount(self.doc, of[self.codes], minlength=len(n)) if len(self.codes) else np.zeros(len(n)))
        chars, upper, letters = sums
        echo = np.flatnonzero((self.codes[1:] == self.codes[:-1]) & (self.doc[1:] == self.doc[:-1]))
        echo = np.bincount(self.doc[echo], minlength=len(n))
        return np.stack([np.log1p(n), share(seen, n), share(chars, n) / 10, share(upper, letters), share(letters, chars),
                         share(echo, n), np.log1p(seen) / np.log(2 + n)], axis=1).astype(np.float32)


def bent(numbers):
    """The numbers and their squares: a linear model may then prefer a middle range."""
    return np.hstack([numbers, numbers * numbers])


def share(part, whole):
    return part / np.maximum(whole, 1)


def layout_numbers(texts):
    """One row of numbers a document, from its length, lines and marks, not from its words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    bounds = lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
    n = np.diff(bounds)
    coded = lines.flatten().dictionary_encode()
    k, doc = max(1, len(coded.dictionary)), np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(doc * np.int64(k) + coded.indices.to_numpy(zero_copy_only=False)) // k, minlength=len(n))
    marks, spaces, digits = (pc.count_substring_regex(texts, r).to_numpy(zero_copy_only=False) for r in (MARKS, r"\s", r"[0-9]"))
    return np.stack([np.log1p(chars), np.log1p(n), np.log1p(share(chars, n)), 1 - share(distinct, n),
                     share(marks, chars), share(spaces, chars), share(digits, chars)], axis=1).astype(np.float32)


def labelled_sample(docs, labels, columns, limit):
    """At most ``limit`` labelled documents, those with the lowest hash of their id, all columns
    of ``docs`` and the label columns, as a staged table. Labels with a null are left out; of
    repeated labels the largest counts. The sample's keys are at most ``limit`` rows, so they
    are broadcast; of documents with one id the one with the lowest text is taken (ties: the lowest
    row; nulls come first)."""
    known = labels.dropna(subset=["doc_id", *columns]).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        *(F.max(c).alias(f"_{c}") for c in columns))
    chosen = staged(known.orderBy(F.xxhash64("_id"), "_id").limit(limit), "labels")
    least = F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("row")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id")).groupBy(*chosen.columns).agg(least)
    return staged(rows.select("row.*", *chosen.columns), "labelled")


def sums(frame, columns, make, name="sums"):
    """Sum of the vectors (float64, one length) that ``make(batch)`` gives, added per task, then together.

    The vectors travel in slices, so that the sums of many tasks meet in many places.
    """
    slices = 1 << 14

    def run(batches):
        total = None
        for batch in sliced(batches, 0):
            got = make(batch)
            total = got if total is None else total + got
        if total is not None:
            for i in range(0, len(total), slices):
                yield pa.RecordBatch.from_arrays([pa.array([i // slices], pa.int32()),
                                                  pa.array([total[i:i + slices].astype("<f8").tobytes()], pa.binary())], ["slice", "part"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column("part"):
                total = total + np.frombuffer(x.as_buffer(), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])

    parts = frame.select(*columns).mapInArrow(run, "slice int, part binary")
    whole = parts.groupBy("slice").applyInArrow(add, "slice int, part binary")
    rows = sorted(whole.collect(), key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["part"], "<f8") for r in rows]) if rows else None


def select_pieces(labelled, targets, per_target):
    """Pieces that tell the targets (0/1 columns ``_name``) apart, best chi-squared first."""
    def count(batch):
        doc, piece = Words(batch.column(0)).pieces()
        rows = [np.bincount(piece, minlength=1 << BITS)]
        size = [batch.num_rows]
        for k in range(len(targets)):
            y = batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float64)
            rows.append(np.bincount(piece, y[doc], minlength=1 << BITS)), size.append(y.sum())
        return np.concatenate([*rows, size]).astype(np.float64)

    got = sums(labelled, ["text", *targets], count)
    if got is None:
        return np.zeros(0, np.int64)
    size, got = got[-1 - len(targets):], got[:-1 - len(targets)].reshape(1 + len(targets), -1)
    seen, chosen = got[0], []
    for k in range(len(targets)):
        expected = seen * size[1 + k] / max(1, size[0])
        gap = np.abs(got[1 + k] - expected)
        chi = np.where(seen >= 3, gap ** 2 / np.maximum(expected, 1e-9) / np.maximum(1e-9, 1 - size[1 + k] / max(1, size[0])), 0)
        best = np.argsort(-chi, kind="stable")[:per_target]
        chosen.append(best[chi[best] > 6.6])
    return np.unique(np.concatenate(chosen))


def piece_matrix(words, chosen):
    """Float32 matrix documents x chosen pieces, 1 where the document has the piece."""
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    place = np.cumsum(wanted) - 1
    out = np.zeros((len(words.counts), len(chosen)), np.float32)
    doc, piece = words.pieces(wanted)
    out[doc, place[piece]] = 1
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised columns, full batches of Adam steps."""

    def fit(self, x, y, weight=None, penalty=3e-3, steps=200, rate=0.08, spread=True):
        x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
        self.mean = x.mean(axis=0) if spread else np.zeros(x.shape[1], np.float32)
        self.scale = x.std(axis=0) + 1e-3 if spread else np.ones(x.shape[1], np.float32)
        x = (x - self.mean) / self.scale
        weight = np.ones(len(y), np.float32) if weight is None else np.asarray(weight, np.float32)
        weight = weight / weight.sum()
        w, b = np.zeros(x.shape[1], np.float32), float(np.log((y @ weight + 1e-3) / (1 - y @ weight + 1e-3)))
        m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
        for t in range(1, steps + 1):
            gap = (sigmoid(x @ w + b) - y) * weight
            g = np.append(gap @ x + penalty * w, gap.sum()).astype(np.float32)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w / self.scale, float(b - (self.mean / self.scale) @ w)
        return self

    def logit(self, x):
        return x @ self.w + self.b
