import hashlib
import random
import zlib

import pytest

from sparselens.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, token string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE).repartition(3)


def plain(conversations, rebuild=True):
    """The trie by plain dictionaries; ``conversations``: conv_id to its turns in order."""
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        origin = conversations.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        rebuilt[c] = origin[:h] + own[h:]
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(seed, n, words=3):
    """Many shared beginnings, copies, conversations of one turn and of 60 turns."""
    rng = random.Random(seed)
    made = {}
    for c in rng.sample(range(-20, 4 * n), n):
        kind = rng.random()
        size = 60 if kind < 0.03 else rng.randint(1, 9)
        made[c] = [("user" if k % 2 else "assistant", f"é{rng.randrange(words)}" * (k % 3)) for k in range(size)]
        if kind > 0.7:  # a third are copies of one conversation
            made[c] = [("user", "hello"), ("assistant", "yes"), ("user", "bye")]
    return made


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_trie_against_plain_dictionaries(spark, ranges):
    made = some(ranges, 250)
    rows = [(c, t, role, text) for c, path in made.items() for t, (role, text) in enumerate(path)]
    assert got(trie.prefix_trie(trie.rebuilt_paths(frame(spark, rows)), ranges)) == plain(made)


def test_conversations_as_they_are(spark):
    made = some(9, 60)
    rows = [(c, 2 * t - 5, role, text) for c, path in made.items() for t, (role, text) in enumerate(path)]
    assert got(trie.prefix_trie(trie.conversation_paths(frame(spark, rows)), 5)) == plain(made, rebuild=False)


def test_ends_of_a_large_group_of_copies(spark, monkeypatch):
    """The ids of one hot node are spread over ranges and several blocks of each."""
    monkeypatch.setattr(trie, "BLOCK_IDS", 7)
    made = {c: [("user", "same"), ("assistant", "too")] for c in range(300)}
    rows = [(c, t, role, text) for c, path in made.items() for t, (role, text) in enumerate(path)]
    paths = trie.conversation_paths(frame(spark, rows))
    sample = [(bytes(r["path"]), r["conv_id"]) for r in paths.collect()]
    assert len(trie.choose_splitters(sample, 6)) == 5
    assert got(trie.prefix_trie(paths, 6)) == plain(made, rebuild=False)


def test_odd_rows(spark):
    """Null roles and texts are empty, null ids belong to nobody, null turns come first, repeated rows are turns."""
    rows = [(5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 7, "user", "x" * 100_000), (6, 1, "user", None),
            (None, 1, "user", "nobody"), (None, None, None, None), (-7, 3, "", ""), (-5, 1, "a", "b"), (2, 1, "user", "first"), (2, 1, "user", "first")]
    made = {5: [("user", "first"), ("", ""), ("", ""), ("user", "x" * 100_000)], 6: [("user", "")], -7: [("", "")], -5: [("a", "b")],
            2: [("user", "first")] * 2}
    assert got(trie.prefix_trie(trie.rebuilt_paths(frame(spark, rows)))) == plain(made)
    assert got(trie.prefix_trie(trie.conversation_paths(frame(spark, rows)), 3)) == plain(made, rebuild=False)


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "ab", "c"), (6, 0, "a", "bc"), (11, 0, "", "abc")]
    assert len(got(trie.prefix_trie(trie.conversation_paths(frame(spark, rows))))) == 4


def test_equal_turns_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, "user", w) for w in "abcdef"]
    one, two = (got(trie.prefix_trie(trie.conversation_paths(frame(spark, r)))) for r in (rows, rows[::-1]))
    assert one == two and len(one) == 7


def test_empty_table(spark):
    none = trie.prefix_trie(trie.rebuilt_paths(frame(spark, []).limit(0)))
    assert none.count() == 0 and none.columns == [c.split()[0] for c in trie.NODES.split(", ")]


def test_splitters_part_the_sample_evenly():
    paths = [bytes([k // 16, k % 16]) * 10 for k in range(256)]
    cuts = trie.choose_splitters([(p, k) for k, p in enumerate(paths)], 8)
    assert len(cuts) == 7 and all(len(p) % trie.TOKEN == 0 for p, _ in cuts)
    from bisect import bisect_right
    sizes = [0] * 8
    for k, p in enumerate(paths):
        sizes[bisect_right(cuts, (p, k))] += 1
    assert min(sizes) >= 31 and max(sizes) <= 33
