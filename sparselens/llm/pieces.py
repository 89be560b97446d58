"""SentencePiece encoding that keeps offsets, and decoding.

Normalising walks a text by the longest prefix the model's compiled character map knows and notes,
for every byte it writes, the byte of the source it stands for. The pieces of the normalised text
(merged by the sentencepiece library under the model's own scores, with its normaliser switched off)
are then projected back: piece k covers the source bytes ``ends[k - 1]`` to ``ends[k]``. All texts of a
slice are projected at once. Decoding puts the bytes of pieces together again.

Odd rows: a null text is empty; an empty text has the begin and end ids only. Bytes that are not
UTF-8 become U+FFFD, one each. Very long texts are whole; a slice of a batch holds about 4 MB of
text or one document. Repeated rows and null ids are kept, ties do not arise, other columns are
ignored. An empty table gives no row.
"""

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sparselens.llm.common import sliced

MODEL = "piece_bpe_32k.model"
SPACE, REPLACEMENT = "▁".encode(), "�".encode()
#: Kinds of pieces in the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ENCODED = "doc_id long, ids array<int>, ends array<long>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"


class CharMap:
    """The compiled character map: a double array of 32-bit units, then replacements that end in a zero byte."""

    def __init__(self, blob):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.strings = np.frombuffer(blob, "<u4", size // 4, 4 if blob else 0).tolist(), blob[4 + size:]
        self.first = bytes(c for c in range(256) if self._step(0, c) is not None) if self.units else b""

    def _step(self, node, byte):
        """The unit reached from ``node`` by a byte, and its place; None if there is none."""
        unit = self.units[node]
        at = node ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def _value(self, node):
        unit = self.units[node]
        leaf = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        start = self.units[leaf] & 0x7FFFFFFF
        return self.strings[start:self.strings.index(b"\0", start)]

    def longest(self, data, at):
        """Length and replacement of the longest rule that matches at a place; (0, None) without one."""
        node, best, ends = 0, 0, None
        if not self.units:
            return 0, None
        for length, byte in enumerate(data[at:], 1):
            node = self._step(node, byte)
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                best, ends = length, node
        return (best, self._value(ends)) if best else (0, None)


def character(data, at):
    """Length of the UTF-8 character at a place, 0 where there is none."""
    for size in range(1, 5):
        try:
            data[at:at + size].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return min(size, len(data) - at)
    return 0


class Normaliser:
    """A model's normalisation: ``apply(data)`` gives the bytes and, for each, the source byte it starts from."""

    def __init__(self, spec, suffix=False, symbols=()):
        self.map, self.suffix = CharMap(spec.precompiled_charsmap), suffix
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = SPACE if self.escape else b" "
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)
        starts = {s[0] for s in self.symbols} | set(self.map.first) | {0x20}
        self.plain = not (starts - {0x20}) and 0x20 not in self.map.first and not self.squeeze

    def prefix(self, data, at):
        """The normalised form of the longest prefix at a place, and its length in the source."""
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        size, value = self.map.longest(data, at)
        if size:
            return value, size
        size = character(data, at)
        return (data[at:at + size], size) if size else (REPLACEMENT, 1)

    def apply(self, data):
        out, source, at = [], [], 0
        if self.squeeze:
            while at < len(data) and (found := self.prefix(data, at))[0] == b" ":
                at += found[1]
        if at >= len(data):
            return b"", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            out.append(self.space)
            source += [at] * len(self.space)
        blank = self.squeeze
        while at < len(data):
            value, size = self.prefix(data, at)
            if blank:
                value = value.lstrip(b" ")
            if value:
                written = value.replace(b" ", SPACE) if self.escape else value
                out.append(written)
                source += [at] * len(written)
                blank = value.endswith(b" ")
            at += size
            blank = blank and self.squeeze
        text = b"".join(out)
        if self.squeeze:
            while text.endswith(self.space):
                text = text[:-len(self.space)]
                at = source[len(text)]
            del source[len(text):]
        if self.dummy and self.suffix:
            text += self.space
            source += [at] * len(self.space)
        return text, np.array([*source, at], np.int64)

    def apply_all(self, texts):
        """Normalised texts, and one after the other for each text what ``apply`` notes: the source byte of every
        byte, and where the last one ends."""
        if not self.plain or not all(map(is_utf8, texts)):
            found = [self.apply(t) for t in texts]
            return [f for f, _ in found], np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])
        # nothing but blanks changes
        front, back = (b"", self.space) if self.suffix else (self.space, b"")
        front, back = (front, back) if self.dummy else (b"", b"")
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        width = np.where(np.frombuffer(b"".join(texts), np.uint8) == 0x20, len(self.space), 1)
        place = np.concatenate([[0], np.cumsum(width)])  # where each byte of the source starts
        source = np.repeat(np.arange(base[-1]) - np.repeat(base[:-1], np.diff(base)), width)
        full = np.diff(base) > 0  # an empty text gets no blank
        lead, tail = (len(front) * full, len(back) * full + 1)
        where, value = np.stack([place[base[:-1]], place[base[1:]]], axis=1), np.stack([0 * base[1:], np.diff(base)], axis=1)
        extra = np.stack([lead, tail], axis=1).ravel()
        source = np.insert(source, np.repeat(where.ravel(), extra), np.repeat(value.ravel(), extra))
        return [front + t.replace(b" ", self.space) + back if t else b"" for t in texts], source


def is_utf8(data):
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class PieceModel:
    """Encoding and decoding with one model file."""

    def __init__(self, proto):
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.spec, trainer = model.normalizer_spec, model.trainer_spec
        kinds = np.array([p.type for p in model.pieces])
        names = [p.piece.encode() for p in model.pieces]
        self.normaliser = Normaliser(self.spec, trainer.treat_whitespace_as_suffix,
                                     [p.piece for p in model.pieces if p.type == USER_DEFINED])
        bare = sentencepiece_model_pb2.ModelProto.FromString(proto)
        bare.normalizer_spec.CopyFrom(sentencepiece_model_pb2.NormalizerSpec(
            name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.bos, self.eos, self.unknown = trainer.bos_id, trainer.eos_id, trainer.unk_id
        # decoding: the bytes of each piece, with blanks for their mark
        self.byte, self.control = kinds == BYTE, kinds == CONTROL
        self.raw = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else trainer.unk_surface.encode() if k == UNKNOWN
                    else n.replace(SPACE, b" ") for n, k in zip(names, kinds)]
        self.named = [n.startswith(SPACE) and k in (NORMAL, USER_DEFINED, UNUSED) for n, k in zip(names, kinds)]
        self.sizes = np.array([len(r) for r in self.raw])
        self.table, self.first = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(self.sizes) - self.sizes
        # normalised bytes a piece stands for; a byte's are counted with the last one of its character
        self.width = np.where(kinds == BYTE, 0, [len(n) for n in names])
        self.values = np.array([r[0] if k == BYTE else 0 for r, k in zip(self.raw, kinds)], np.uint8)

    def encode(self, texts):
        """Ids and ends of the texts of an Arrow array in a row, and the number of ids of each; without begin and end ids."""
        texts = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        forms, source = self.normaliser.apply_all(texts)
        lists = self.merger.encode([f.decode() for f in forms], out_type=int, num_threads=1) if forms else []
        counts = np.array([len(i) for i in lists], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(i, np.int32) for i in lists)])
        width = self.width[ids]
        lasting = np.flatnonzero(self.byte[ids])
        if len(lasting):  # a character's bytes count with the last one
            lead = np.flatnonzero((self.values[ids[lasting]] & 0xC0) != 0x80)
            size = np.diff(np.append(lead, len(lasting)))
            width[lasting[lead + size - 1]] = size
        first = np.concatenate([[0], np.cumsum(counts)])
        for k in np.unique(np.searchsorted(first, np.flatnonzero(ids == self.unknown), side="right") - 1):
            found = self.merger.encode(forms[k].decode(), return_type="proto")  # an unknown piece may stand for several characters
            width[first[k]:first[k + 1]] = [p.end - p.begin for p in found.pieces]
        return ids, source[np.cumsum(width) + np.repeat(np.arange(len(counts)), counts)], counts

    def decode(self, ids, bounds):
        """Decoded bytes of each run ``ids[bounds[i]:bounds[i + 1]]``."""
        ids, sizes = np.asarray(ids), self.sizes[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.table[np.repeat(self.first[ids] - to[:-1], sizes) + np.arange(to[-1])].tobytes()
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            text = flat[to[lo]:to[hi]]
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                text = self._mended(ids[lo:hi])
            out.append(text[self._blanks(ids[lo:hi]):])
        return out

    def _blanks(self, ids):
        """How many bytes the blanks in front take that encoding had put there."""
        if not (self.normaliser.dummy or self.normaliser.squeeze):
            return 0
        gone = 0
        for k in ids:
            if self.control[k]:
                continue
            if not self.named[k]:
                break
            gone += 1
            if not self.normaliser.squeeze or self.sizes[k] > 1:
                break
        return gone

    def _mended(self, ids):
        """Joined pieces where runs of byte pieces are not UTF-8: each byte outside a character is U+FFFD."""
        parts, run = [], b""
        for k in [*ids.tolist(), -1]:
            if k >= 0 and self.byte[k]:
                run += self.raw[k]
                continue
            at = 0
            while at < len(run):
                size = character(run, at)
                parts.append(run[at:at + size] if size else REPLACEMENT)
                at += size or 1
            run = b""
            if k >= 0:
                parts.append(self.raw[k])
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def model(proto):
    """The model of this Python worker."""
    return PieceModel(proto)


def read_model(path=None):
    """The bytes of a model file (some hundred kB): they go to the tasks, which need not see the file."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def _with_ends(coder, ids, ends, counts):
    """Begin and end ids around each text's own; they cover no bytes."""
    first = np.concatenate([[0], np.cumsum(counts)])
    stop = np.zeros(len(counts), np.int64)
    stop[counts > 0] = ends[first[1:][counts > 0] - 1]
    places = np.stack([first[:-1], first[1:]], axis=1).ravel()
    ids = np.insert(ids, places, np.tile([coder.bos, coder.eos], len(counts)))
    ends = np.insert(ends, places, np.stack([np.zeros_like(stop), stop], axis=1).ravel())
    return ids, ends, first + 2 * np.arange(len(first))


def _mapped(docs, proto, schema, rows):
    """``rows(coder, ids, ends, bounds)`` gives the columns behind doc_id for a slice of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        coder = model(shared.value)
        for batch in sliced(batches, 1):
            ids, ends, bounds = _with_ends(coder, *coder.encode(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows(coder, ids, ends, bounds)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_documents(docs, model_path=None):
    """(doc_id, ids, ends): ids with begin and end id; ``ends[k]`` is the source byte behind piece k, where piece k + 1 starts."""
    def rows(coder, ids, ends, bounds):
        bounds = pa.array(bounds.astype(np.int32))
        return [pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(ends))]

    return _mapped(docs, read_model(model_path), ENCODED, rows)


def decode_documents(encoded, model_path=None):
    """(doc_id, text) of rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        coder = model(shared.value)
        for batch in batches:
            lists = batch.column(1)
            texts = [coder.decode(np.array(i, np.int64), [0, len(i)])[0] for i in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.expr("array()")).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def token_digest(docs, model_path=None):
    """One row a document: n_tokens (begin and end id counted), SHA-256 of the ids as little-endian 32-bit
    numbers, of the decoded text, and of the pieces' ends as little-endian 64-bit numbers."""
    def rows(coder, ids, ends, bounds):
        raw, spans, b = memoryview(ids.astype("<u4").tobytes()), memoryview(ends.astype("<i8").tobytes()), bounds.tolist()
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array(np.diff(bounds)), pa.array([sha(raw[4 * s:4 * e]) for s, e in zip(b, b[1:])]),
                pa.array([sha(t) for t in coder.decode(ids, b)], pa.string()), pa.array([sha(spans[8 * s:8 * e]) for s, e in zip(b, b[1:])])]

    return _mapped(docs, read_model(model_path), DIGEST, rows)
