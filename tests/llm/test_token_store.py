import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sparselens.llm import token_store as store
from sparselens.llm.common import folder

PATH = public_tokenizers.path(store.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return store.Encoder(PATH)


def test_runs_encode_like_whole_texts(encoder):
    rng, signs = random.Random(1), "aAbÉé\u0301'sI1 \n\t.,<|endoftext|> ΣßİKÅ!@#\U0001f600\u200d\x01\x85\xa0"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4_000)] + [None, "", "x<|endoftext|>y <|ENDOFTEXT|>", "a.,b"]
    column = pa.array(texts)
    for lo in range(0, len(texts), 701):
        part = column[lo:lo + 701]
        ids, counts = encoder.encode(part)
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("top", [1, 200, 255, 256, 70_000, 1 << 31])
def test_any_token_of_a_shard(top):
    ids = np.random.default_rng(top).integers(0, top, 5_000).astype(np.uint32)
    shard = store.Shard(store.pack(ids, [4, 9], [2_000, 3_000]))
    places = np.random.default_rng(0).integers(0, len(ids), 900)
    assert (shard.all() == ids).all() and (shard.take(places) == ids[places]).all() and (shard.document(1) == ids[2_000:]).all()
    with pytest.raises(IndexError):
        shard.take([5_000])


def test_empty_shard():
    assert len(store.Shard(store.pack([], [], [])).all()) == 0


def brute(encoder, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_the_table(spark, encoder, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(tuple(r) for r in store.store_tokens(docs).collect()) == brute(encoder, rows)
    manifest = store.write_store(docs, folder(spark, "t"), PATH, shard_tokens=5_000)
    flat = [i for _, t in rows for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    places = spark.range(0, len(flat), 1_009).withColumnRenamed("id", "position")
    assert manifest.count() > 5
    assert sorted(tuple(r) for r in store.fetch_tokens(manifest, places, 4_096).collect()) == [(p, flat[p]) for p in range(0, len(flat), 1_009)]


def test_odd_rows(encoder, odd_docs, no_docs):
    got = sorted((tuple(r) for r in store.store_tokens(odd_docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda d: (d is not None, d))
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append(brute(encoder, [(r["doc_id"], r["text"])])[0][2:])
    assert all(r[2:] in texts[r[0]] for r in got) and [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert store.store_tokens(no_docs).count() == 0
