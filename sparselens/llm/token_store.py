"""Token ids as directly addressable codes.

A store is a folder of shard files and a Parquet manifest with one row per shard. A shard
holds the ids of consecutive documents in ascending ``doc_id``. Ids are split into chunks of
eight bits, lowest first. Level 0 has the lowest chunk of every id; level l+1 has a chunk for
just those ids of level l whose continuation bit is set. A rank directory (set bits before
each block of 512) turns position i of a level into the position in the next one, so any
token is read from at most one byte, one bit and one directory entry per level.

File layout, little-endian: the magic ``DACTOK01``; four uint64: tokens, documents, levels,
length of the header with its table; the table with, for each level, four uint64: chunks,
offset of chunks, of bitmap words (uint64), of the directory (uint64); then the doc ids
(int64), the first position of each document plus the end (uint64), and the level parts.

Nulls: a null text is an empty document that has only the end id. Rows with a null ``doc_id``
come first. Repeated ids are kept, ordered by a hash of the text. An empty table gives a store without shards.
"""

import functools
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from sparselens.llm.common import folder, sliced, staged

MAGIC, CHUNK_BITS, BLOCK_WORDS, END_ID = b"DACTOK01", 8, 8, 2
VOCABULARY = "word_bpe_49k.json"
#: A shard is closed once it holds this many tokens; one document is never divided.
SHARD_TOKENS = 1 << 21
#: Spellings a task remembers before it starts anew.
CACHE_WORDS = 300_000

MANIFEST = "path string, first_doc long, n_docs long, n_tokens long, part int, shard int"


class Encoder:
    """Whole texts to ids. White space ends every token of this vocabulary, so each distinct
    run between blanks and line ends is encoded once and its ids are put together by position."""

    #: Stands between runs that are encoded as one text; a run that has it is encoded alone.
    BETWEEN = "\x01"

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.code(self.BETWEEN)
        if len(self.between) != 1:
            raise ValueError("the vocabulary has no single id for the character between runs")
        self.forget()

    def code(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self):
        self.seen, self.ids, self.starts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, runs):
        """Append the ids of new runs; a cut at each separator gives them back one by one."""
        plain = [r for r in runs if self.BETWEEN not in r]
        joined = (f" {self.BETWEEN} ".join(plain[lo:lo + 2_000]) + f" {self.BETWEEN}" for lo in range(0, len(plain), 2_000))
        ids = [np.array(self.tokenizer.encode_batch_fast([j], add_special_tokens=False)[0].ids, np.uint32) for j in joined]
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        cut = ids == self.between[0]
        ends = np.flatnonzero(cut) - np.arange(len(plain))
        odd = [self.code(r) for r in runs if self.BETWEEN in r]
        ids = np.concatenate([ids[~cut], *(np.array(o, np.uint32) for o in odd)])
        ends = np.concatenate([ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(o) for o in odd], dtype=np.int64)])
        names = plain + [r for r in runs if self.BETWEEN in r]
        self.seen.update(zip(names, range(len(self.starts) - 1, len(self.starts) - 1 + len(names))))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts):
        """Ids of all texts in a row, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are spelled in lower case only
            texts = pc.ascii_lower(texts)
        texts = texts.cast(pa.large_string())  # after lowering, which goes wrong on a cast slice
        # a letter and the mark after it are never one token, so fewer spellings do
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])", r"\1 \2")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        if len(self.seen) > CACHE_WORDS:
            self.forget()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([u for u in unique if u not in self.seen])
        place = np.fromiter(map(self.seen.__getitem__, unique), np.int64, len(unique))
        begin, size = self.starts[:-1][place], np.diff(self.starts)[place]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat((begin[codes] - ends[:-1]).astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)
        return self.ids[flat], np.diff(ends[bounds])


@functools.lru_cache(maxsize=1)
def encoder(path):
    """The encoder of this Python worker; what it has learnt serves the tasks that follow."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def pack(ids, doc_ids, counts):
    """The bytes of one shard."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        going = more > 0
        bits = np.packbits(going, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % (8 * BLOCK_WORDS)), np.uint64)
        ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), words, directory))
        if not going.any():
            break
        rest = more[going]
    head = len(MAGIC) + 32 + 32 * len(levels)
    at, rows, parts = head + 8 * (2 * len(doc_ids) + 1), [], []
    for chunks, words, directory in levels:
        padded = chunks.tobytes() + bytes(-len(chunks) % 8)
        rows += [len(chunks), at, at + len(padded), at + len(padded) + words.nbytes]
        at += len(padded) + words.nbytes + directory.nbytes
        parts += [padded, words.tobytes(), directory.tobytes()]
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
    return b"".join([MAGIC, np.array([len(ids), len(doc_ids), len(levels), head], np.uint64).tobytes(),
                     np.array(rows, np.uint64).tobytes(), np.asarray(doc_ids, np.int64).tobytes(), first.tobytes(), *parts])


class Shard:
    """Random access to a shard's bytes (any buffer, a memory map too)."""

    def __init__(self, buffer):
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.tokens, docs, levels, head = (int(x) for x in np.frombuffer(buffer, np.uint64, 4, 8))
        table = np.frombuffer(buffer, np.uint64, 4 * levels, 40).reshape(levels, 4).tolist()
        self.doc_ids = np.frombuffer(buffer, np.int64, docs, head)
        self.first = np.frombuffer(buffer, np.uint64, docs + 1, head + 8 * docs).astype(np.int64)
        self.levels = []
        for n, chunks, words, directory in table:
            self.levels.append((np.frombuffer(buffer, np.uint8, n, chunks),
                                np.frombuffer(buffer, np.uint64, (directory - words) // 8, words),
                                np.frombuffer(buffer, np.uint64, (directory - words) // 8 // BLOCK_WORDS + 1, directory)))

    def take(self, positions):
        """The ids at any positions, each by rank alone."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.tokens):
            raise IndexError("position outside the shard")
        ids, where = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, words, directory) in enumerate(self.levels):
            ids[where] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            going = (words[word] >> bit & np.uint64(1)).astype(bool)
            at, word, bit, where = at[going], word[going], bit[going], where[going]
            if not len(at):
                break
            rank = directory[word // BLOCK_WORDS].astype(np.int64)
            rank += np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            for back in range(1, BLOCK_WORDS):  # whole words of the block before this one
                rank += np.where(word % BLOCK_WORDS >= back, np.bitwise_count(words[word - back]), 0).astype(np.int64)
            at = rank
        return ids

    def all(self):
        """All ids, level by level from the last."""
        ids = np.zeros(0, np.uint32)
        for chunks, words, _ in reversed(self.levels):
            going = np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            if len(ids):
                here[going] |= ids << np.uint32(CHUNK_BITS)
            ids = here
        return ids

    def document(self, k):
        return self.take(np.arange(self.first[k], self.first[k + 1]))


def place(uri):
    """File system and path of a URI or plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri) if ":/" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def open_shard(uri):
    fs, path = place(uri)
    return Shard(memoryview(fs.open_input_file(path).read_buffer()))


def write_store(docs, path, tokenizer_path, end_id=END_ID, shard_tokens=SHARD_TOKENS):
    """Encode whole texts and write shards in ascending doc_id below ``path``; returns the manifest.

    Documents are dealt to tasks by ranges of doc_id and sorted within. A task writes each
    shard under a name of its own attempt and only then reports it: shards of lost attempts
    are not in the manifest. A task holds one shard and one Arrow batch at a time.
    """
    def run(batches):
        import uuid

        from pyspark import TaskContext
        coder, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held, names, counts, shard = [], [], [], 0

        def close():
            uri = f"{path}/{part:06d}-{shard:05d}-{uuid.uuid4().hex}.dac"
            fs, name = place(uri)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(pack(np.concatenate(held), names, counts))
            row = [uri, int(names[0]), len(names), int(sum(counts)), part, shard]
            held.clear(), names.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([dict(zip(columns, row))], schema=shape)

        for batch in sliced(batches, 1):
            ids, sizes = coder.encode(batch.column(1))
            doc_ids = pc.fill_null(batch.column(0), -1 << 63).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(sizes):  # the documents that fill the open shard
                room = shard_tokens - sum(counts)
                hi = min(len(sizes), lo + 1 + int(np.searchsorted(np.cumsum(sizes[lo:] + 1), room)))
                held.append(np.insert(ids[at[lo]:at[hi]], at[lo + 1:hi + 1] - at[lo], end_id))
                names.extend(doc_ids[lo:hi].tolist()), counts.extend((sizes[lo:hi] + 1).tolist())
                lo = hi
                if sum(counts) >= shard_tokens:
                    yield close()
                    shard += 1
        if names:
            yield close()

    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    shape = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()),
                       ("n_tokens", pa.int64()), ("part", pa.int32()), ("shard", pa.int32())])
    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")))
    found = staged(ordered.mapInArrow(run, MANIFEST), "manifest")
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return staged(found.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long"))), "manifest")


def read_store(manifest):
    """(doc_id, start, n_tokens, ids_crc32) read back from the shard files, a shard at a time."""
    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(uri)
                raw, first = memoryview(shard.all().astype("<u4").tobytes()), shard.first
                ends = (4 * first).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if d == -1 << 63 else d for d in shard.doc_ids.tolist()], pa.int64()),
                    pa.array(start + first[:-1]), pa.array(np.diff(first)),
                    pa.array([zlib.crc32(raw[s:e]) for s, e in zip(ends, ends[1:])], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, min(manifest.count(), 100_000))  # a short list that would otherwise be read by one task
    return (manifest.select("path", "start").repartition(shards, "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def fetch_tokens(manifest, positions, granule=1 << 16):
    """(position, token_id): tokens at any global positions, by rank, without decoding a shard.

    Shards and positions meet on ``granule``: a shard is listed under each one it touches.
    """
    spans = manifest.select("path", "start", (F.col("start") + F.col("n_tokens")).alias("end")).withColumn(
        "_g", F.explode(F.expr(f"sequence(start div {granule}, (end - 1) div {granule})")))
    wanted = positions.select(F.col("position").cast("long")).withColumn("_g", F.expr(f"position div {granule}"))
    met = (wanted.join(spans, "_g").where("position >= start and position < end")
           .select("path", "position", (F.col("position") - F.col("start")).alias("at")))

    def run(batches):
        open_path, shard = None, None
        for batch in batches:
            paths = batch.column(0).to_pylist()
            position, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if paths[lo] != open_path:
                    open_path, shard = paths[lo], open_shard(paths[lo])
                yield pa.RecordBatch.from_arrays([pa.array(position[lo:hi]), pa.array(shard.take(at[lo:hi]).astype(np.int64))],
                                                 ["position", "token_id"])

    return met.repartitionByRange("path", "position").sortWithinPartitions("path", "position").mapInArrow(
        run, "position long, token_id long")


def store_tokens(docs, tokenizer_path=None):
    """Write a store into the shared folder and read it back, one row per document."""
    path = folder(docs.sparkSession, "tokens")
    manifest = write_store(docs, path, tokenizer_path or public_tokenizers.path(VOCABULARY))
    return read_store(manifest)
