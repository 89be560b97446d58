"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower case, edge punctuation cut) of all documents are coded by the vocabulary of the
   benchmark, and passage frequencies are counted over passages of ``PASSAGE`` words.
2. A randomised SVD of the TF-IDF passages of all documents: every task adds its share of
   A'(A O) for a random O, and the singular directions come from that sum (Nystroem form), so
   one pass over the passages is enough.
3. Items and windows of documents are folded into the latent space. Windows come in lengths that
   fit the items (powers of the square root of two), half a window apart; with its slack on both sides
   one of them holds any passage of that length whole. A common subsequence takes its words from both
   sides, each as often as both have it, so only pairs of a window with slack and an item with as many
   words in common as step 4 asks for are compared: that loses no leak. Pairs are candidates when the
   window, or the same window a quarter of its length earlier or later, has a latent cosine of at least
   ``COSINE`` with the item.
4. A candidate is a leak when the longest common subsequence of the item and the window (with some
   slack) has ``COPY`` of the item's words, or ``PARAPHRASE`` of them and the item's answer: the words
   after its last "answer:", or its last words, in order. Items of under ``SHORT`` words need all words.

The benchmark is a stated query set. Its words, their frequencies and the latent space are those of all
items; the search works through the items in blocks of ``BLOCK``, each against all documents, so rows and
cosines are the same for every block size. A task holds the benchmark's distinct words with ``RANK``
numbers each, and one block's items; neither grows with the corpus.

Nulls: a null text has no words and no leak; items with a null or empty text or a null id find nothing;
a null ``doc_id`` is kept. Repeated items are found once per ``item_id`` and text; repeated rows give
repeated hits. An empty benchmark or table gives no hits.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import boxed, sliced, staged, words_of
from sparselens.llm.textmodel import distinct, sums

PASSAGE, RANK, OVERSAMPLE, SEED = 32, 40, 8, 20
COSINE, COPY, PARAPHRASE, ANSWER, SHORT = 0.4, 0.8, 0.5, 0.75, 8
ANSWER_WORDS, BLOCK = 8, 1_000
#: Counts of words in windows that are held at a time.
CELLS = 1 << 22
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"
HIT = "doc_id long, item_id long, cosine double, overlap double, answer boolean"


def hashed_words(texts):
    """64-bit hash of each distinct word, the words of all texts as indices, and their bounds.
    Words that are only punctuation are left out."""
    codes, unique, bounds = words_of(texts, lower=False)
    plain = pc.utf8_lower(pc.utf8_trim(unique, characters=EDGES))
    gone = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(plain.to_numpy(zero_copy_only=False), categorize=False)
    if gone.any():
        keep = ~gone[codes]
        bounds, codes = np.concatenate([[0], np.cumsum(keep)])[bounds], codes[keep]
    return hashes, codes, bounds


class Vocabulary:
    """Hashes of the benchmark block's words; a word's code is its place, ``size`` for all others."""

    def __init__(self, hashes):
        self.hashes, self.size = hashes, len(hashes)
        self.kind = np.uint16 if self.size < 65_535 else np.uint32

    def code(self, texts):
        hashes, codes, bounds = hashed_words(texts)
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[place] == hashes, place, self.size).astype(self.kind)[codes], bounds


def items_of(rows):
    """[(item_id, word hashes, answer hashes)] of benchmark rows."""
    out = []
    for item, text in rows:
        at = [m.end() for m in re.finditer(r"(?i)\banswers?\s*:", text)]
        both = pa.array([text, text[at[-1]:] if at else ""], pa.large_string())
        hashes, codes, bounds = hashed_words(both)
        words = hashes[codes]
        whole, answer = words[:bounds[1]], words[bounds[1]:]
        if len(whole):
            out.append((item, whole, answer if len(answer) else whole[-ANSWER_WORDS:]))
    return out


def passages(bounds):
    """Passage number of every word: documents cut into runs of PASSAGE words."""
    size = np.diff(bounds)
    count = -(-size // PASSAGE)
    first = np.cumsum(count) - count
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    return np.repeat(first, size) + inside // PASSAGE, int(count.sum())


def unpacked(batch, kind, column=0):
    """Codes and bounds of a batch of the coded table."""
    lists = batch.column(column)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(lists).to_numpy(zero_copy_only=False))]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(lists.to_pylist()), kind), bounds.astype(np.int64)


def coded_table(docs, vocabulary):
    """(doc_id, words): every document's word codes, staged."""
    def run(batches):
        for batch in sliced(batches, 1):
            codes, bounds = vocabulary.code(batch.column(1))
            raw, at = codes.tobytes(), (bounds * codes.itemsize).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[s:e] for s, e in zip(at, at[1:])], pa.binary())],
                                             ["doc_id", "words"])

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                  .mapInArrow(run, "doc_id long, words binary"), "coded")


def idf_of(coded, vocabulary):
    """Inverse passage frequency of every code; the last one stands for all other words."""
    def count(batch):
        codes, bounds = unpacked(batch, vocabulary.kind)
        passage, n = passages(bounds)
        known = codes < vocabulary.size
        pairs = distinct(passage[known] * np.int64(vocabulary.size) + codes[known])
        return np.append(np.bincount(pairs % vocabulary.size, minlength=vocabulary.size), n).astype(np.float64)

    got = sums(coded, ["words"], count)
    got = np.zeros(vocabulary.size + 1) if got is None else got
    idf = np.log((got[-1] + 1) / (got[:-1] + 1)) + 1e-3
    return np.append(idf, idf.max()).astype(np.float32)


def folded(codes, starts, sizes, weights):
    """Sum of the weight rows of each run of codes (``starts``, ``sizes`` into ``codes``)."""
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    step = max(1, (1 << 18) // max(1, int(sizes.max(initial=1))))
    for lo in range(0, len(starts), step):
        size = sizes[lo:lo + step]
        ends = np.cumsum(size)
        at = np.repeat(starts[lo:lo + step] - (ends - size), size) + np.arange(size.sum())
        full = size > 0
        if full.any():
            out[lo:lo + step][full] = np.add.reduceat(weights[codes[at]], (ends - size)[full], axis=0)
    return out


def directions(coded, vocabulary, idf, rank=RANK):
    """Right singular directions (codes x rank) of the TF-IDF passages of all documents."""
    width = min(rank + OVERSAMPLE, vocabulary.size)
    probe = np.random.default_rng(SEED).standard_normal((vocabulary.size, width)).astype(np.float32)

    def share(batch):
        codes, bounds = unpacked(batch, vocabulary.kind)
        passage, n = passages(bounds)
        total = np.zeros((vocabulary.size, width))
        known = np.flatnonzero(codes < vocabulary.size)
        weighted, used, own = probe * idf[:-1, None], codes[known], passage[known]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
        lo = 0
        while lo < len(cuts) - 1:  # about a quarter of a million words, whole passages, at a time
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + (1 << 18))) - 1)
            part, first = used[cuts[lo]:cuts[hi]], cuts[lo:hi] - cuts[lo]
            sketch = np.add.reduceat(weighted[part], first, axis=0)
            row = np.repeat(np.arange(hi - lo), np.diff(cuts[lo:hi + 1]))
            order = np.argsort(part, kind="stable")
            ordered = part[order]
            at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            total[ordered[at]] += np.add.reduceat(sketch[row[order]], at, axis=0)
            lo = hi
        return (total * idf[:-1, None]).ravel()

    got = sums(coded, ["words"], share)
    if got is None or not got.any():
        return np.eye(vocabulary.size, width, dtype=np.float32)[:, :rank]
    got = got.reshape(vocabulary.size, width)
    small = probe.T.astype(np.float64) @ got
    small = (small + small.T) / 2
    low = 1e-9 * np.trace(small)
    values, vectors = np.linalg.eigh(small + low * np.eye(width))
    root = vectors / np.sqrt(np.maximum(values, low))
    found, _, _ = np.linalg.svd(got @ root, full_matrices=False)
    return found[:, :rank].astype(np.float32)


def subsequence(masks, full, words):
    """Length of the longest common subsequence, one addition on whole bit rows per word."""
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return (full ^ row).bit_count()


def masks_of(words):
    masks = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks, (1 << len(words)) - 1


class Bags:
    """Words of the items of one length, for what a window has in common with each of them.

    A word that an item has k times is k rows: held at least once, twice, up to k times."""

    def __init__(self, items, size):
        found = np.unique(np.concatenate([w for both in items for w in both]))
        self.place = np.full(size + 1, len(found), np.int32)
        self.place[found] = np.arange(len(found))
        self.levels, self.items = {}, []
        for words, answer in items:
            least = int(np.ceil(PARAPHRASE * len(words))) if len(words) >= SHORT else len(words)
            self.items.append((self.rows(words), len(words), least, self.rows(answer), len(answer)))
        word, times = map(np.array, zip(*self.levels))
        order = np.lexsort((word, times))  # the rows of single words come first, in the order of words
        self.more, self.times = word[order][len(found):], times[order][len(found):]
        place = np.argsort(order)
        self.items = [(place[rows], n, least, place[answer_rows], answer) for rows, n, least, answer_rows, answer in self.items]

    def rows(self, words):
        """The rows of each word, as often as it is there."""
        own, times = np.unique(self.place[words], return_counts=True)
        return np.array([self.levels.setdefault((int(w), k), len(self.levels)) for w, n in zip(own, times) for k in range(1, n + 1)])

    def held(self, own, begin, stop, width):
        """Rows x ``width`` windows: 1 where a window holds a row's word often enough. A word ``own`` lies in the
        windows from ``begin`` to before ``stop``; only words that an item has twice are counted."""
        out = np.zeros((len(self.levels), width), np.uint8)
        flat, first, last = out.ravel(), own * width + begin, own * width + stop
        while len(first):
            flat[first] = 1
            inside = first + 1 < last
            first, last = first[inside] + 1, last[inside]
        if len(self.more):
            again, row = np.unique(self.more, return_inverse=True)
            met = np.isin(own, again)
            own, cells = np.searchsorted(again, own[met]) * (width + 1), len(again) * (width + 1)
            change = np.bincount(own + begin[met], minlength=cells) - np.bincount(own + stop[met], minlength=cells)
            times = np.cumsum(change.reshape(-1, width + 1)[:, :-1], axis=1, dtype=np.int32)
            out[len(out) - len(row):] = times[row] >= self.times[:, None]
        return out

    def pairs(self, codes, left, right):
        """(windows, items) with enough words in common for a leak, some windows at a time;
        ``left`` and ``right`` ascend."""
        places = self.place[codes]
        known = np.flatnonzero(places < self.place[-1])
        longest = max(n for _, n, *_ in self.items)
        kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
        open_ = np.flatnonzero(np.searchsorted(known, right) - np.searchsorted(known, left) >= min(least for _, _, least, _, _ in self.items))
        most = max(16, CELLS // len(self.levels))
        for lo in range(0, len(open_), most):
            part = open_[lo:lo + most]
            at = known[np.searchsorted(known, left[part[0]]):np.searchsorted(known, right[part[-1]])]
            begin, stop = np.searchsorted(right[part], at, side="right"), np.searchsorted(left[part], at, side="right")
            used = begin < stop
            held = self.held(places[at[used]].astype(np.int64), begin[used], stop[used], len(part))
            windows, items = [], []
            for i, (rows, n, least, answer_rows, answer) in enumerate(self.items):
                common = np.add.reduce(held[rows], axis=0, dtype=kind)
                w = np.flatnonzero(common >= least)
                if len(w):
                    w = w[(common[w] / n >= COPY) | (held[answer_rows[:, None], w].sum(axis=0) >= ANSWER * answer)]
                    windows.append(part[w])
                    items.append(np.full(len(w), i))
            if sum(map(len, windows)):
                yield np.concatenate(windows), np.concatenate(items)


class Searcher:
    """Finds the block's items in coded documents."""

    def __init__(self, items, vocabulary, idf, latent):
        self.vocabulary = vocabulary
        self.weights = np.vstack([latent * idf[:-1, None], np.zeros((1, latent.shape[1]), np.float32)])
        self.groups = {}
        for item, words, answer in items:
            length = int(np.ceil(np.sqrt(2) ** np.ceil(np.log(max(SHORT, len(words))) / np.log(np.sqrt(2)) - 1e-9)))
            self.groups.setdefault(length, []).append((item, np.searchsorted(vocabulary.hashes, words), np.searchsorted(vocabulary.hashes, answer)))
        self.latent = {k: self.unit(np.stack([self.weights[w].sum(axis=0) for _, w, _ in v])) for k, v in self.groups.items()}
        self.masks = {k: [(masks_of(w.tolist()), masks_of(a.tolist())) for _, w, a in v] for k, v in self.groups.items()}

        self.bags = {k: Bags([(w, a) for _, w, a in v], vocabulary.size) for k, v in self.groups.items()}

    @staticmethod
    def unit(rows):
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def candidates(self, codes, bounds, length):
        """(document, start and end of the window with slack, item place, cosine) above COSINE."""
        step, size, slack = max(1, length // 2), np.diff(bounds), length // 4 + 1
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - length) // step)), 0)
        doc = np.repeat(np.arange(len(size)), count)
        start = bounds[:-1][doc] + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        first, stop = bounds[:-1][doc], bounds[1:][doc]
        left, right = np.maximum(start - slack, first), np.minimum(start + length + slack, stop)
        for w, item in self.bags[length].pairs(codes, left, right):
            used, place = np.unique(w, return_inverse=True)
            cosine = np.full(len(w), -1.0, np.float32)
            for move in (-(length // 4), 0, length // 4):
                begin = np.minimum(np.maximum(start[used] + move, first[used]), np.maximum(stop[used] - length, first[used]))
                rows = self.unit(folded(codes, begin, np.minimum(begin + length, stop[used]) - begin, self.weights))
                cosine = np.maximum(cosine, np.einsum("ij,ij->i", rows[place], self.latent[length][item]))
            near = cosine >= COSINE
            w, item = w[near], item[near]
            yield from zip(doc[w].tolist(), left[w].tolist(), right[w].tolist(), item.tolist(), cosine[near].tolist())

    def hits(self, codes, bounds):
        """[(document, item_id, cosine, overlap, answer)], the best window of each document and item."""
        best = {}
        for length, items in self.groups.items():
            for doc, start, end, item, cosine in self.candidates(codes, bounds, length):
                key = (doc, items[item][0], item, length)
                if key in best and best[key][1] == 1.0:
                    continue
                words = codes[start:end].tolist()
                (masks, full), (answer_masks, answer_full) = self.masks[length][item]
                overlap = subsequence(masks, full, words) / full.bit_length()
                if overlap < (PARAPHRASE if full.bit_length() >= SHORT else 1.0):
                    continue
                answer = subsequence(answer_masks, answer_full, words) >= ANSWER * answer_full.bit_length()
                if (overlap >= COPY or answer) and (key not in best or overlap > best[key][1]):
                    best[key] = (cosine, overlap, answer)
        found = {}
        for (doc, item, _, _), hit in best.items():
            if (doc, item) not in found or hit[1] > found[doc, item][1]:
                found[doc, item] = hit
        return [(doc, item, *hit) for (doc, item), hit in sorted(found.items())]


def usable(benchmark):
    """Distinct items with an id and a text, staged."""
    return staged(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct(), "benchmark")


def blocks(items, size=BLOCK):
    """The items, ``size`` at a time."""
    last = None
    while True:
        more = items if last is None else items.where(F.struct("item_id", "text") > F.struct(F.lit(last[0]).alias("item_id"), F.lit(last[1]).alias("text")))
        block = [tuple(r) for r in more.orderBy("item_id", "text").limit(size).collect()]
        if not block:
            return
        yield block
        last = block[-1]


def vocabulary_of(items):
    """The distinct words of all items, found in the tasks; None without any."""
    def run(batches):
        for batch in sliced(batches, 0):
            found = [w for _, words, answer in items_of(enumerate(batch.column(0).to_pylist())) for w in (words, answer)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64))], ["word"])

    words = items.select("text").mapInArrow(run, "word long").distinct().toPandas()["word"].to_numpy("int64")
    return Vocabulary(np.sort(words.view(np.uint64))) if len(words) else None


def searchers(docs, benchmark):
    """(searcher, coded documents) of each block, all with the words and directions of the whole benchmark."""
    items = usable(benchmark)
    vocabulary = vocabulary_of(items)
    if vocabulary is None:
        return
    coded = coded_table(docs, vocabulary)
    idf = idf_of(coded, vocabulary)
    latent = directions(coded, vocabulary, idf)
    for block in blocks(items):
        found = items_of(block)
        if found:
            yield Searcher(found, vocabulary, idf, latent), coded


def find_leaks(docs, benchmark):
    """(doc_id, item_id, cosine, overlap, answer): the benchmark items each document holds."""
    spark, found = docs.sparkSession, None
    for searcher, coded in searchers(docs, benchmark):
        sent = spark.sparkContext.broadcast(searcher)

        def run(batches, sent=sent):
            for batch in sliced(batches, 1):
                hits = sent.value.hits(*unpacked(batch, sent.value.vocabulary.kind, 1))
                if hits:
                    doc, *rest = zip(*hits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, rest)],
                                                     [c.split()[0] for c in HIT.split(", ")])

        hits = coded.mapInArrow(run, HIT)
        found = hits if found is None else found.union(hits)
    return spark.createDataFrame([], HIT) if found is None else found


def drop_leaks(docs, benchmark):
    """The documents without a benchmark item, all columns as they are; nothing is shuffled."""
    clean = boxed(docs)
    for searcher, _ in searchers(docs, benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches, sent=sent):
            for batch in sliced(batches, 1):
                bad = {h[0] for h in sent.value.hits(*sent.value.vocabulary.code(batch.column(1)))}
                keep = np.ones(batch.num_rows, bool)
                keep[list(bad)] = False
                yield batch.select([0]).filter(pa.array(keep))

        clean = clean.select("row", F.col("row.text").cast("string").alias("text")).mapInArrow(run, clean.schema)
    return clean.select("row.*")
