"""Language-model scores: a gated recurrent model over the frequent words, unigrams for the rest.

1. Texts are cut into words once. For every chunk of documents the distinct words (64-bit hashes) and
   their training counts go to buckets by hash; a bucket adds the counts of all chunks and answers each
   chunk. A word is sent once a chunk, so no frequent word gathers in one place, and the number of
   buckets grows with the corpus.
2. The most frequent words, the end of a text and "any other word" are the network's vocabulary.
3. Training documents are dealt to rounds by a hash of their id. In a round every task trains on its own
   documents of the round from the same parameters, all windows of all of them; the parameters are then
   averaged, weighted by tokens.
4. Every document is scored whole, the state carried across windows. The probability of another word is the
   network's for "other" times the word's share (plus one) of all others in training.

Documents whose crc32(doc_id) modulo ``FOLDS`` is ``HELD`` are held out of all learning. Nulls: a null text is
empty and has only its end; a null ``doc_id`` is a training document. Repeated rows count and learn
repeatedly. An empty table gives an empty result; without training documents all words are unknown.
"""

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from sparselens.llm import gru
from sparselens.llm.common import folder, sliced, words_of
from sparselens.llm.textmodel import sums

FOLDS, HELD, VOCABULARY, ROUNDS = 7, 2, 1_024, 3
#: Ids of the end of a text and of all words outside the vocabulary.
END, OTHER = 0, 1
BUCKET_WORDS = 1 << 20

CHUNKS = "chunk string, doc_id array<long>, held binary, size binary, codes binary, hashes binary, counts binary, n_unique long"
PIECES = "bucket int, chunk string, hashes binary, counts binary"
ANSWERS = "chunk string, bucket int, counts binary, n long, v long, top binary, top_n binary"
READY = "doc_id array<long>, held binary, size binary, known binary, base binary, rest binary, ids binary"


def packed(df, name):
    """Staged, with the stronger compression that long runs of codes deserve."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(docs):
    """One row a chunk: its documents as codes into the chunk's distinct words."""
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, 1):
            codes, unique, bounds = words_of(batch.column(1))
            held = batch.column(2).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            counts = np.bincount(codes[~held[doc]], minlength=len(unique)).astype("<u4") if len(codes) else np.zeros(len(unique), "<u4")
            hashes = pd.util.hash_array(unique.to_numpy(zero_copy_only=False), categorize=False).astype("<u8")
            # distinct spellings are sorted by hash, so that buckets are slices
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            row = [f"{part}-{k}", batch.column(0).to_pylist(), held.astype(np.uint8).tobytes(), np.diff(bounds).astype("<i8").tobytes(),
                   place[codes].tobytes(), hashes[order].tobytes(), counts[order].tobytes(), len(unique)]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (
                pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64()))], [c.split()[0] for c in CHUNKS.split(", ")])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return packed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held")).mapInArrow(run, CHUNKS), "chunks")


def numbers(cell, kind):
    return np.frombuffer(cell.as_buffer() if cell.as_buffer() is not None else b"", kind)


def counted(chunks, vocabulary):
    """The buckets' answers: for each chunk the training counts of its words, and each bucket's totals and top words."""
    total = chunks.agg(F.sum("n_unique")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total) / BUCKET_WORDS))))

    def ask(batches):
        for batch in batches:
            for chunk, hashes, counts in zip(batch.column(0), batch.column(1), batch.column(2)):
                h, c = numbers(hashes, "<u8"), numbers(counts, "<u4")
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else []
                spans = list(zip(cuts, [*cuts[1:], len(h)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[s]) for s, _ in spans], pa.int32()), pa.array([chunk.as_py()] * len(spans), pa.string()),
                     pa.array([h[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([c[s:e].tobytes() for s, e in spans], pa.binary())],
                    ["bucket", "chunk", "hashes", "counts"])

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, counts = [], [], []
        for batch in batches:
            names += batch.column("chunk").to_pylist()
            hashes += [numbers(x, "<u8") for x in batch.column("hashes")]
            counts += [numbers(x, "<u4") for x in batch.column("counts")]
        unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
        whole = np.bincount(place, np.concatenate(counts), minlength=len(unique)).astype("<i8")
        order = np.lexsort((unique, -whole))[:vocabulary]
        at = np.cumsum([0, *map(len, hashes)])
        mine = whole[place]
        rest = [[int(whole.sum())], [int((whole > 0).sum())], [unique[order].astype("<u8").tobytes()], [whole[order].tobytes()]]
        for i, name in enumerate(names):
            extra = rest if i == 0 else [[0], [0], [None], [None]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([key[0].as_py()], pa.int32()), pa.array([mine[at[i]:at[i + 1]].tobytes()], pa.binary()),
                 *(pa.array(x, t) for x, t in zip(extra, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))],
                [c.split()[0] for c in ANSWERS.split(", ")])

    pieces = chunks.select("chunk", "hashes", "counts").mapInArrow(ask, PIECES)
    return packed(pieces.groupBy("bucket").applyInArrow(answer, ANSWERS), "answers")


def top_words(answers, vocabulary):
    """(hashes, counts) of the most frequent training words, ties by hash, chosen by Spark from the buckets' own."""
    def spread(batches):
        for batch in batches:
            for top, n in zip(batch.column(0), batch.column(1)):
                h, c = numbers(top, "<i8"), numbers(n, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "n"])

    rows = answers.where("top is not null").select("top", "top_n").mapInArrow(spread, "h long, n long").where("n > 0") \
        .orderBy(F.desc("n"), "h").limit(vocabulary).collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)


def prepared(chunks, answers, tops, totals):
    """One row a chunk: network ids of all documents, and their sums that need no network."""
    n, v, ends = totals["n"] + totals["ends"], totals["v"] + (totals["ends"] > 0), totals["ends"]
    hashes, counts = tops
    order = np.argsort(hashes)
    sorted_tops, ids_of = hashes[order], (order + 2).astype(np.uint16)
    rest_n, rest_v = totals["n"] - int(counts.sum()), totals["v"] - len(counts)
    end_log = np.log10((ends + 1) / (n + v + 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                size, codes, h = numbers(row["size"], "<i8"), numbers(row["codes"], "<u4"), numbers(row["hashes"], "<u8")
                got = sorted(row["answers"].as_py() or [], key=lambda a: a["bucket"])
                c = np.frombuffer(b"".join(a["counts"] for a in got), "<i8")
                place = np.minimum(np.searchsorted(sorted_tops, h), max(0, len(sorted_tops) - 1))
                known = sorted_tops[place] == h if len(sorted_tops) else np.zeros(len(h), bool)
                ids = np.where(known, ids_of[place] if len(sorted_tops) else 0, OTHER).astype("<u2")
                base = np.log10((c + 1) / (n + v + 1))
                rest = np.where(known, 0.0, np.log10((c + 1) / (rest_n + rest_v + 1)))
                doc = np.repeat(np.arange(len(size)), size)
                add = lambda w: np.bincount(doc, w[codes], minlength=len(size)) if len(codes) else np.zeros(len(size))
                ended = np.insert(ids[codes], np.cumsum(size), END)
                out = [row["doc_id"].as_py(), row["held"].as_py(), (size + 1).astype("<i8").tobytes(),
                       (add((c > 0).astype(float)) + (ends > 0)).astype("<i8").tobytes(), (add(base) + end_log).astype("<f8").tobytes(),
                       add(rest).astype("<f8").tobytes(), ended.astype("<u2").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.list_(pa.int64()), *[pa.binary()] * 6))],
                                                 [x.split()[0] for x in READY.split(", ")])

    replies = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))  # as long as the chunk's words
    joined = chunks.select("chunk", "doc_id", "held", "size", "codes", "hashes").join(replies, "chunk", "left").drop("chunk")
    return packed(joined.mapInArrow(run, READY), "ready")


def documents_of(batch):
    """Ids, bounds, held flags and ids of the documents of a batch of chunk rows."""
    size = np.concatenate([numbers(x, "<i8") for x in batch.column("size")] or [np.zeros(0, np.int64)])
    held = np.concatenate([numbers(x, np.uint8) for x in batch.column("held")] or [np.zeros(0, np.uint8)]).astype(bool)
    ids = np.concatenate([numbers(x, "<u2") for x in batch.column("ids")] or [np.zeros(0, np.uint16)])
    return ids, np.concatenate([[0], np.cumsum(size)]), held, batch.column("doc_id").flatten()


def chosen(ids, bounds, keep):
    size = np.diff(bounds)
    return ids[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


#: Documents that train side by side. A step of the optimizer comes after each window of a group.
GROUP = 256


def train(ready, params, rounds=ROUNDS):
    """Parameters after ``rounds`` rounds of averaging; every training document is in one round."""
    for r in range(rounds):
        sent = ready.sparkSession.sparkContext.broadcast(params)

        def learn(batches, r=r, sent=sent):
            trainer = gru.Trainer(sent.value)
            for batch in batches:
                ids, bounds, held, doc_ids = documents_of(batch)
                of = np.array([0 if d is None else d * 2_654_435_761 % (1 << 32) * rounds >> 32 for d in doc_ids.to_pylist()], np.int64)
                ids, bounds = chosen(ids, bounds, ~held & (of == r))
                order = np.argsort(-np.diff(bounds), kind="stable")
                for lo in range(0, len(order), GROUP):
                    keep = np.zeros(len(order), bool)
                    keep[order[lo:lo + GROUP]] = True
                    trainer.train(*chosen(ids, bounds, keep))
            if trainer.tokens:
                yield np.append(gru.flat(trainer.p).astype(np.float64) * trainer.tokens, trainer.tokens)

        got = sums_of(ready.select("doc_id", "held", "size", "ids"), learn)
        if got is not None:
            params = gru.unflat(got[:-1] / got[-1], params)
    return params


def sums_of(frame, make):
    """Sum of the vectors that each task's ``make(batches)`` yields."""
    def run(batches):
        for vector in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array([vector.astype("<f8").tobytes()], pa.binary())], ["v"])

    vectors = frame.mapInArrow(run, "v binary")
    return sums(vectors, ["v"], lambda batch: sum(numbers(x, "<f8") for x in batch.column(0)))


def fit_and_prepare(docs, vocabulary=VOCABULARY, rounds=ROUNDS):
    """(prepared chunks, parameters, number of training tokens)."""
    chunks = chunked(docs)
    answers = counted(chunks, vocabulary)
    got = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    train_docs = docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))).count()
    totals = {"n": got["n"] or 0, "v": got["v"] or 0, "ends": train_docs}
    tops = top_words(answers, vocabulary - 2)
    ready = prepared(chunks, answers, tops, totals)
    counts = [totals["ends"], totals["n"] - int(tops[1].sum()), *tops[1].tolist()]
    return ready, train(ready, gru.start(counts), rounds), totals["n"] + totals["ends"]


def score_documents(docs, vocabulary=VOCABULARY, rounds=ROUNDS):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    ready, params, n = fit_and_prepare(docs, vocabulary, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        for batch in batches:
            ids, bounds, held, doc_ids = documents_of(batch)
            read = lambda c, kind: np.concatenate([numbers(x, kind) for x in batch.column(c)] or [np.zeros(0, kind)])
            score = gru.score(sent.value, ids, bounds) + read("rest", "<f8")
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(held), pa.array(np.diff(bounds)), pa.array(read("known", "<i8")),
                 pa.array(np.full(len(held), n, np.int64)), pa.array(read("base", "<f8")), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
