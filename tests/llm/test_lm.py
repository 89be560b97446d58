import collections
import math
import zlib

import numpy as np
import pytest

from sparselens.llm import gru, lm


def brute(rows):
    words = [[*(w.decode() for w in (t or "").encode().lower().split()), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (d, _), h, ws in zip(rows, held, words)]


def check(docs, **options):
    got = sorted((tuple(r) for r in lm.score_documents(docs, **options).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-9 * abs(w[5]) for g, w in zip(got, want))
    return got


def test_base_scores_and_a_better_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in check(docs) if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_rows(odd_docs, no_docs):
    assert all(math.isfinite(r[6]) for r in check(odd_docs, vocabulary=64))
    assert lm.score_documents(no_docs).count() == 0


@pytest.fixture
def net():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.standard_normal(v.shape) * 0.2 for k, v in gru.start(rng.integers(1, 50, 70)).items()}
    return p, rng.integers(0, 70, 90), np.array([0, 35, 35, 41, 90])


def test_scores_carry_the_state(net):
    """Windows give the same as one long step-by-step pass; probabilities over the vocabulary sum to one."""
    p, ids, bounds = net
    want = []
    for lo, hi in zip(bounds, bounds[1:]):
        h, total, last = np.zeros(gru.HIDDEN), 0.0, 0
        for w in ids[lo:hi]:
            n, a, s = gru.HIDDEN, p["input"][last], h @ p["state"]
            z, r = 1 / (1 + np.exp(-(a[:n] + s[:n]))), 1 / (1 + np.exp(-(a[n:2 * n] + s[n:2 * n])))
            h = (1 - z) * np.tanh(a[2 * n:] + r * s[2 * n:]) + z * h
            cls = h @ p["class"] + p["class_bias"]
            cls = np.exp(cls - cls.max()) / np.exp(cls - cls.max()).sum()
            inner = np.exp(np.einsum("h,chs->cs", h, p["word"]) + p["word_bias"])
            whole = cls[:, None] * inner / inner.sum(axis=1, keepdims=True)
            assert abs(whole.sum() - 1) < 1e-9
            total += math.log10(whole.ravel()[w])
            last = w
        want.append(total)
    assert np.allclose(gru.score(p, ids.astype(np.uint16), bounds), want, rtol=1e-4)


def test_gradients(net, monkeypatch):
    p, ids, bounds = net
    monkeypatch.setattr(gru, "STEPS", 64)
    monkeypatch.setattr(gru.Trainer, "step", lambda self, g, n: setattr(self, "g", g))
    trainer = gru.Trainer(p)
    trainer.train(ids.astype(np.uint16), bounds)
    loss = lambda: -gru.score(p, ids.astype(np.uint16), bounds).sum() * gru.LOG10
    for k in p:
        flat = p[k].ravel()
        at = np.argsort(-np.abs(trainer.g[k].ravel()))[:5]
        for j in at:
            old = flat[j]
            flat[j] = old + 1e-3
            up = loss()
            flat[j] = old - 1e-3
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-3 - trainer.g[k].ravel()[j]) < 2e-2 * max(1, abs(trainer.g[k].ravel()[j]))
