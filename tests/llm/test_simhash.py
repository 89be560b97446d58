import numpy as np
import pytest
import xxhash

from sparselens.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = np.array([p for _, p in rows], np.uint64)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1:]) <= 4) + i + 1:
            a, b = group[i], group[j]
            if a != b:
                group = [a if g == b else g for g in group]
    ids = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [ids[g] for g in group]


def check(docs):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(rows, brute_components(rows))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want


def test_whole_table_equals_brute_force(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.fixture
def crowded(spark):
    """Prints near a few centres, chains of them, and prints that differ in all three segments."""
    rng, prints = np.random.default_rng(5), set()
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(150):
            p = centre
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                p ^= 1 << int(b)
            prints.add(p)
            prints.add(p ^ 1 << 3 ^ 1 << 30 ^ 1 << 50 ^ 1 << 60)
    return sorted(prints)


def test_no_link_of_a_crowded_group_is_lost(spark, crowded):
    signed = [(int(np.uint64(p).astype(np.int64)), 1) for p in crowded]
    got = dict(tuple(r) for r in simhash.link(spark.createDataFrame(signed, "fp long, weight long")).collect())
    want = brute_components([(s, p) for (s, _), p in zip(signed, crowded)])
    groups = {}
    for (s, _), w in zip(signed, want):
        groups.setdefault(w, set()).add(got[s])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_one_of_each_group_stays(odd_docs):
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(odd_docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, None, None, 4, 6, -3], key=str)
    assert simhash.drop_near_duplicates(odd_docs).columns == odd_docs.columns
