import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from sparselens.llm import pieces

PROTO = pieces.read_model()
SIGNS = ["a", "b", "the", "ing", " th", " ", "  ", "\n", "\t", "　", "▁", "é", "é", "日本", "😀", "\x1f", "\x00", "<s>", "<0x41>",
         "ﬁ", "Ａ", "１", "‍", "\xa0", "…", "½", "ẛ̣", "한", "가", "�", "㍿"]


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", None, " ", "   ", "▁", "a ", " a", "x" * 9_000]


def variant(rule="identity", dummy=True, squeeze=False, suffix=False, fallback=True, symbols=(), norm_map=None):
    """The public model under another normaliser; without byte pieces unknown characters stay unknown."""
    model = sentencepiece_model_pb2.ModelProto.FromString(PROTO)
    made = sentencepiece.SentencePieceNormalizer(norm_map=norm_map) if norm_map else sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = dummy, squeeze
    model.trainer_spec.treat_whitespace_as_suffix = suffix
    for k, symbol in enumerate(symbols):
        model.pieces[20_000 + k].piece, model.pieces[20_000 + k].type = symbol, pieces.USER_DEFINED
    if not fallback:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            if p.type == pieces.BYTE:
                p.type = pieces.UNUSED
    return model.SerializeToString()


def against_library(proto, texts):
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.PieceModel(proto)
    ids, ends, counts = own.encode(pa.array(texts, pa.string()))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    decoded = own.decode(ids, bounds)
    for k, text in enumerate(t or "" for t in texts):
        lo, hi = bounds[k], bounds[k + 1]
        want = library.encode(text, return_type="proto")
        assert ids[lo:hi].tolist() == [p.id for p in want.pieces], repr(text)
        assert ends[lo:hi].tolist() == [p.end for p in want.pieces], repr(text)
        assert decoded[k].decode() == library.decode(ids[lo:hi].tolist()), repr(text)


def test_the_public_model():
    against_library(PROTO, some_texts(1, 3_000))


@pytest.mark.parametrize("dummy,squeeze", [*itertools.product([True, False], repeat=2)])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_compiled_maps_and_blanks(rule, dummy, squeeze):
    against_library(variant(rule, dummy, squeeze), some_texts(2, 400))


def test_longest_rule_wins_and_replacements_may_be_empty_or_hold_blanks():
    rules = {"a": "b", "ab": "the ing", "abc": "", "x ": "y", " ": "  ", "é": "e"}
    against_library(variant(norm_map=[*rules.items()]), some_texts(3, 300) + ["abcab abx ax  aab", "abc", "ab abc", "x x "])
    found = pieces.CharMap(sentencepiece_model_pb2.ModelProto.FromString(variant(norm_map=[*rules.items()])).normalizer_spec.precompiled_charsmap)
    assert [found.longest(t, 0) for t in (b"abd", b"abcd", b"ad", b"d", b"x ")] == [(2, b"the ing"), (3, b""), (1, b"b"), (0, None), (2, b"y")]


def test_unknown_characters_and_own_symbols():
    texts = some_texts(4, 400) + ["\U0001f9ff\U0001f9ff x \U0001f9ff", "<own>the<own>", "日<ow"]
    against_library(variant(fallback=False), texts)
    against_library(variant("nmt_nfkc", symbols=["<own>", "½½"]), texts + ["½½½ <own> ½"])


def test_blank_behind_words():
    against_library(variant(suffix=True), some_texts(5, 400))


def test_decoding_of_any_ids():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=PROTO), pieces.PieceModel(PROTO), random.Random(6)
    pool = [0, 1, 2, *range(3, 290), 400, 31_990]
    for _ in range(3_000):
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, np.int64), [0, len(ids)])[0].decode() == library.decode(ids), ids


def test_bytes_that_are_not_text():
    own = pieces.PieceModel(PROTO)
    broken = pa.array([b"ab\xff c", b"\xe2\x96", b"fine \xc3\xa9"], pa.binary()).view(pa.string())
    ids, ends, counts = own.encode(broken)
    library = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    assert ids.tolist() == [i for t in ("ab� c", "��", "fine é") for i in library.encode(t)]
    assert [ends[e - 1] for e in np.cumsum(counts)] == [5, 2, 7]


def brute(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = pieces.token_digest(docs)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows)


def test_spans_and_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    encoded = pieces.encode_documents(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded).collect()} == texts
    library = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    for r in encoded.limit(20).collect():
        data, ends = texts[r["doc_id"]].encode(), r["ends"]
        assert ends[0] == 0 and ends[-1] == len(data) and ends == sorted(ends)
        for k, lo, hi in zip(r["ids"][1:-1], ends, ends[1:]):
            piece = library.id_to_piece(k)
            if not piece.startswith("<0x"):
                assert data[lo:hi].decode() == piece.replace("▁", " ").removeprefix(" " if lo == 0 else "")


def test_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r)[:4] for r in pieces.token_digest(odd_docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert pieces.token_digest(no_docs).count() == 0 and pieces.encode_documents(no_docs).count() == 0
    empty = pieces.decode_documents(pieces.encode_documents(odd_docs).selectExpr("doc_id", "cast(null as array<int>) as ids", "1 as text"))
    assert {r["text"] for r in empty.collect()} == {""}
