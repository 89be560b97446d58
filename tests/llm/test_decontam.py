import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from sparselens.llm import decontam


def prose(rng, n):
    common = "the of and to in is that it was for on are as with his they at be this from have".split()
    return [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(n)]


@pytest.fixture
def case(spark, make_docs):
    rng = random.Random(4)
    items = {k: prose(rng, rng.randint(14, 70)) for k in range(12)}
    rows, want = [], set()
    for doc in range(120):
        words = prose(rng, rng.randint(0, 900))
        if doc % 4 == 0:  # whole, shouted, or with a few words changed
            item = doc // 4 % 12
            leak = list(items[item])
            if doc % 12 == 4:
                leak = [w.upper() + "!!" for w in leak]
            if doc % 12 == 8:
                for i in range(2, len(leak) - 1, 6):
                    leak[i] = "changed" + str(doc)
            at = rng.randint(0, len(words))
            words[at:at] = leak
            want.add((doc, item))
        rows.append((doc, " ".join(words)))
    rows += [(500, None), (501, ""), (None, " ".join(items[3]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, ""), (None, "some text"), (3, " ".join(items[3]))],
                                  "item_id long, text string")
    return make_docs(rows), bench, want | {(None, 3)}


def test_leaks_are_found_and_clean_documents_left(case):
    docs, bench, want = case
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == want
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_every_verbatim_copy_in_the_table(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = bench.collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if i["text"] in d["text"]}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}


def test_blocks_find_the_same(case, monkeypatch):
    """Rows, cosines and overlaps do not depend on the size of a block."""
    docs, bench, want = case
    whole = sorted(map(str, decontam.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam.blocks, "__defaults__", (5,))
    found = decontam.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and sorted(map(str, found)) == whole


def test_a_window_with_slack_holds_any_passage():
    """Half a window apart, with slack: a passage of a window's length lies in one of them, wherever it starts."""
    for length in (8, 12, 16, 17, 23, 33, 46, 65, 91):
        step, slack = max(1, length // 2), length // 4 + 1
        for size in (length, length + 1, 3 * length + 2, 200):
            starts = np.arange(1 + max(0, -(-(size - length) // step))) * step
            for x in range(max(1, size - length + 1)):
                assert any(max(0, s - slack) <= x and x + length <= min(size, s + length + slack) or size < length for s in starts)


def test_nothing_to_find(odd_docs, no_docs, case, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(odd_docs, none).count() == 0 and decontam.drop_leaks(odd_docs, none).count() == odd_docs.count()
    assert decontam.find_leaks(no_docs, case[1]).count() == 0 and decontam.drop_leaks(no_docs, case[1]).count() == 0


def test_paraphrases_in_unseen_words(spark, make_docs):
    """40 to 50% of an item's words replaced by words that are nowhere else, its last eight words kept:
    every pair that brute-force common subsequences confirm is looked at and found."""
    rng = random.Random(11)
    items = {k: prose(rng, rng.randint(24, 60)) for k in range(12)}
    rows, want = [], set()
    for doc in range(48):
        words, leak = prose(rng, rng.randint(0, 300)), list(items[doc % 12])
        for i in rng.sample(range(len(leak) - 8), int(len(leak) * rng.uniform(0.4, 0.5))):
            leak[i] = f"unseen{doc}x{i}"
        at = rng.randint(0, len(words))
        rows.append((doc, " ".join(words[:at] + leak + words[at:])))
        want.add((doc, doc % 12))
    docs, bench = make_docs(rows), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}

    searcher = next(decontam.searchers(docs, bench))[0]
    codes, bounds = searcher.vocabulary.code(__import__("pyarrow").array([t for _, t in rows]))
    for length, own in searcher.groups.items():
        left = np.concatenate([np.arange(s, e, 5) for s, e in zip(bounds, bounds[1:])])
        right = np.concatenate([np.minimum(np.arange(s, e, 5) + length * 3 // 2, e) for s, e in zip(bounds, bounds[1:])])
        got = {(w, i) for part in searcher.bags[length].pairs(codes, left, right) for w, i in zip(*map(np.ndarray.tolist, part))}
        for w, (s, e) in enumerate(zip(left, right)):
            for i, ((masks, full), (answer_masks, answer_full)) in enumerate(searcher.masks[length]):
                overlap = decontam.subsequence(masks, full, codes[s:e].tolist()) / full.bit_length()
                answer = decontam.subsequence(answer_masks, answer_full, codes[s:e].tolist()) >= decontam.ANSWER * answer_full.bit_length()
                assert (w, i) in got or not (overlap >= decontam.COPY or overlap >= decontam.PARAPHRASE and answer)


def test_words_held_by_windows(monkeypatch):
    """Which words windows hold, and how often, as counted one by one, without wide numbers for all rows and windows."""
    monkeypatch.setattr(decontam, "CELLS", 1 << 20)
    rng = np.random.default_rng(3)
    items = [(w, w[-8:]) for w in (np.append(rng.integers(0, 2000, 30), rng.integers(0, 20, 10)) for _ in range(40))]
    bags = decontam.Bags(items, 2000)
    codes = np.where(rng.random(60_000) < 0.3, rng.integers(0, 2001, 60_000), rng.integers(0, 25, 60_000))
    for at in range(0, 60_000, 600):
        codes[at:at + 40] = items[at // 600 % 40][0]
        codes[at:at + rng.integers(0, 30)] = 2000
    left = np.arange(0, 60_000, 23)
    right = np.minimum(left + 70, len(codes))
    tracemalloc.start()
    got = {(w, i) for part in bags.pairs(codes, left, right) for w, i in zip(*map(np.ndarray.tolist, part))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bags.levels) * len(left) > decontam.CELLS and peak < 6 * decontam.CELLS

    want = set()
    wanted = [(Counter(w.tolist()), Counter(a.tolist()), len(w), len(a)) for w, a in items]
    for w, (s, e) in enumerate(zip(left, right)):
        there = Counter(codes[s:e].tolist())
        for i, (words, answer, n, m) in enumerate(wanted):
            common = (words & there).total()
            if common >= decontam.PARAPHRASE * n and (common / n >= decontam.COPY or (answer & there).total() >= decontam.ANSWER * m):
                want.add((w, i))
    assert got == want and got


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 30)).tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks, full = decontam.masks_of(a)
        assert decontam.subsequence(masks, full, b) == table[-1, -1]


def test_singular_directions(spark, make_docs):
    """The directions of the sketch span those of a full decomposition."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    docs = make_docs([(i, " ".join(rng.choices(words[i % 4 * 10:i % 4 * 10 + 10], k=64))) for i in range(80)])
    hashes, codes, _ = decontam.hashed_words(__import__("pyarrow").array([" ".join(words)]))
    vocabulary = decontam.Vocabulary(np.sort(hashes[codes]))
    coded = decontam.coded_table(docs, vocabulary)
    idf = decontam.idf_of(coded, vocabulary)
    rows = []
    for r in coded.collect():
        c = np.frombuffer(r["words"], vocabulary.kind)
        rows += [np.bincount(c[i:i + decontam.PASSAGE], minlength=vocabulary.size) * idf[:-1] for i in range(0, len(c), decontam.PASSAGE)]
    exact = np.linalg.svd(np.array(rows), full_matrices=False)[2][:4]
    got = decontam.directions(coded, vocabulary, idf, rank=4)
    assert np.linalg.norm(exact @ got) ** 2 > 3.8
