"""A gated recurrent network with a class-factored softmax, in numpy.

Words are numbered by falling frequency; class c has the words c * SIZE to (c + 1) * SIZE - 1. The
probability of a word is that of its class times that of the word within the class, so a step costs
classes plus class size, not the vocabulary. Documents run side by side, longest first; the state
goes on from window to window, gradients stop at a window's start.
"""

import numpy as np

HIDDEN, SIZE, STEPS = 16, 32, 32
LOG10 = float(np.log(10))


def log_softmax(x):
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start(counts, seed=7):
    """Parameters for a vocabulary with these counts: outputs begin at the words' frequencies."""
    words, rng = len(counts), np.random.default_rng(seed)
    classes = -(-words // SIZE)
    mass = np.zeros(classes * SIZE)
    mass[:words] = np.asarray(counts, float) + 0.5
    grid = mass.reshape(classes, SIZE)
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(grid / grid.sum(axis=1, keepdims=True)), -30)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"input": draw(classes * SIZE, 3 * HIDDEN), "state": draw(HIDDEN, 3 * HIDDEN),
            "class": np.zeros((HIDDEN, classes), np.float32), "class_bias": np.log(grid.sum(axis=1) / mass.sum()).astype(np.float32),
            "word": np.zeros((classes, HIDDEN, SIZE), np.float32), "word_bias": inner.astype(np.float32)}


def flat(params):
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(vector, like):
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(vector[at:at + like[k].size], np.float32).reshape(like[k].shape)
        at += like[k].size
    return out


def windows(ids, bounds):
    """(documents, inputs, targets, valid) of each window; arrays are steps x documents, longest first."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    for first in range(0, int(size.max(initial=0)), STEPS):
        active = int(np.searchsorted(-size, -first))  # documents with words left
        steps = min(STEPS, int(size[0]) - first)
        at = bounds[order[:active]] + first + np.arange(steps)[:, None]
        valid = first + np.arange(steps)[:, None] < size[:active]
        targets = np.where(valid, ids[np.minimum(at, len(ids) - 1)], 0).astype(np.int64)
        before = np.where(first + np.arange(steps)[:, None] > 0, ids[np.clip(at - 1, 0, len(ids) - 1)], 0)  # a text begins after an end
        yield order[:active], np.where(valid, before, 0).astype(np.int64), targets, valid


def forward(p, state, inputs, keep=True):
    """States after each step, and (``keep``) what the backward pass needs."""
    given, kept, states = p["input"][inputs], [], np.empty((*inputs.shape, HIDDEN), np.float32)
    for t in range(len(inputs)):
        from_state = state @ p["state"]
        gates = sigmoid(given[t, :, :2 * HIDDEN] + from_state[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(given[t, :, 2 * HIDDEN:] + r * from_state[:, 2 * HIDDEN:])
        if keep:
            kept.append((state, z, r, n, from_state[:, 2 * HIDDEN:]))
        state = n + z * (state - n)
        states[t] = state
    return states, kept


def outputs(p, hidden, targets, gradient=None):
    """Natural log probability of each target after each row of ``hidden``; with ``gradient`` (a
    dictionary to fill) also the loss's slope at the rows."""
    cls, word = targets // SIZE, targets % SIZE
    rows = np.arange(len(targets))
    of_class = log_softmax(hidden @ p["class"] + p["class_bias"])
    total = of_class[rows, cls].copy()
    if gradient is not None:
        slope = np.exp(of_class)
        slope[rows, cls] -= 1
        gradient["class"], gradient["class_bias"] = hidden.T @ slope, slope.sum(axis=0)
        back = slope @ p["class"].T
        gradient["word"], gradient["word_bias"] = np.zeros_like(p["word"]), np.zeros_like(p["word_bias"])
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(p["class"].shape[1] + 1))
    for c in range(len(cuts) - 1):
        own = order[cuts[c]:cuts[c + 1]]
        if len(own):
            h = hidden[own]
            inner = log_softmax(h @ p["word"][c] + p["word_bias"][c])
            total[own] += inner[np.arange(len(own)), word[own]]
            if gradient is not None:
                slope = np.exp(inner)
                slope[np.arange(len(own)), word[own]] -= 1
                gradient["word"][c], gradient["word_bias"][c] = h.T @ slope, slope.sum(axis=0)
                back[own] += slope @ p["word"][c].T
    return (total, None) if gradient is None else (total, back)


def score(p, ids, bounds, together=4_096):
    """log10 probability of each document, the state carried through all of it.

    At most ``together`` documents of similar length run side by side.
    """
    size = np.diff(bounds)
    out, order = np.zeros(len(size)), np.argsort(-size, kind="stable")
    for lo in range(0, len(order), together):
        group = order[lo:lo + together]
        ends = np.cumsum(size[group])
        own = ids[np.repeat(bounds[group] - (ends - size[group]), size[group]) + np.arange(ends[-1])]
        found, state = np.zeros(len(group)), np.zeros((len(group), HIDDEN), np.float32)
        for docs, inputs, targets, valid in windows(own, np.concatenate([[0], ends])):
            states, _ = forward(p, state[:len(docs)], inputs, keep=False)
            state = states[-1]
            logs, _ = outputs(p, states[valid], targets[valid])
            found += np.bincount(np.broadcast_to(docs, valid.shape)[valid], logs, minlength=len(found))
        out[group] = found
    return out / LOG10


class Trainer:
    """Adam steps over windows, truncated backpropagation."""

    def __init__(self, params, rate=0.01):
        self.p, self.rate, self.t = {k: v.copy() for k, v in params.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
        self.tokens = 0

    def train(self, ids, bounds):
        state = np.zeros((len(bounds) - 1, HIDDEN), np.float32)
        for docs, inputs, targets, valid in windows(ids, bounds):
            states, kept = forward(self.p, state[:len(docs)], inputs)
            state, g = states[-1], {}
            _, back = outputs(self.p, states[valid], targets[valid], g)
            slope = np.zeros_like(states)
            slope[valid] = back
            self.backward(slope, inputs, kept, g)
            self.step(g, int(valid.sum()))

    def backward(self, slope, inputs, kept, g):
        steps, docs = inputs.shape
        to_input, to_state = (np.empty((steps, docs, 3 * HIDDEN), np.float32) for _ in range(2))
        carried = np.zeros((docs, HIDDEN), np.float32)
        back = np.ascontiguousarray(self.p["state"].T)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, from_state = kept[t]
            total = slope[t] + carried
            inner = total * (1 - z) * (1 - n * n)
            a, b = to_input[t], to_state[t]
            a[:, :HIDDEN] = total * (before - n) * z * (1 - z)
            a[:, HIDDEN:2 * HIDDEN] = inner * from_state * r * (1 - r)
            a[:, 2 * HIDDEN:] = inner
            b[:, :2 * HIDDEN] = a[:, :2 * HIDDEN]
            b[:, 2 * HIDDEN:] = inner * r
            carried = total * z + b @ back
        before = np.concatenate([k[0] for k in kept])
        g["state"] = before.T @ to_state.reshape(-1, 3 * HIDDEN)
        where = inputs.ravel()
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], where[order][1:] != where[order][:-1]]))
        g["input"] = np.zeros_like(self.p["input"])
        g["input"][where[order][cuts]] = np.add.reduceat(to_input.reshape(-1, 3 * HIDDEN)[order], cuts, axis=0)

    def step(self, g, tokens):
        self.t, self.tokens = self.t + 1, self.tokens + tokens
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / tokens
        scale = min(1.0, 1.0 / max(size, 1e-9)) / tokens
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-6)
