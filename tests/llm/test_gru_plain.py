"""Training and scoring of the recurrent model against a plain rerun, a token and a document at a time."""

import random
import time
import zlib

import numpy as np
import pytest

from weftline.llm import gru_lm

H = gru_lm.HIDDEN


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def log_softmax(x):
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def targets(vocab, word, cls):
    """(weights, row, bias, target) of each softmax that a token passes."""
    if cls >= vocab.classes:
        return [("co", None, "cb", vocab.groups + cls - vocab.classes)]
    out = [("co", None, "cb", cls // vocab.group), ("wo", cls, "wb", word % gru_lm.CLASS_WORDS)]
    return out + [("go", cls // vocab.group, "gb", cls % vocab.group)] * (vocab.group > 1)


def logp(w, vocab, state, word, cls, grad=None):
    total, back = 0.0, np.zeros(H)
    for name, row, bias, target in targets(vocab, word, cls):
        weights, b = (w[name], w[bias]) if row is None else (w[name][row], w[bias][row])
        logs = log_softmax(state @ weights + b)
        total += logs[target]
        if grad is not None:
            d = -np.exp(logs)
            d[target] += 1
            at = slice(None) if row is None else row
            grad[name][at] += np.outer(state, d)
            grad[bias][at] += d
            back += weights @ d
    return total, back


def step(w, fed, h):
    g, hu = w["x"][fed] + w["b"], h @ w["u"]
    z, r = sigmoid(g[:H] + hu[:H]), sigmoid(g[H : 2 * H] + hu[H : 2 * H])
    n = np.tanh(g[2 * H :] + r * hu[2 * H :])
    return n + z * (h - n), (fed, h, z, r, n, hu)


def train(w, vocab, docs):
    """``docs``: lists of (word, class). One pass of windows over all of them, the longest first."""
    docs = sorted(docs, key=lambda d: -len(d))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    states, steps = [np.zeros(H) for _ in docs], 0
    for t0 in range(0, len(docs[0]), gru_lm.WINDOW):
        grad, n, norm = {k: np.zeros_like(x) for k, x in w.items()}, 0, 0.0
        rows = {"x": set(), "wo": set(), "wb": set()} | ({"go": set(), "gb": set()} if vocab.group > 1 else {})
        t1 = min(t0 + gru_lm.WINDOW, len(docs[0]))
        for k, doc in enumerate(docs):
            if len(doc) <= t0:
                continue
            tape, h = [], states[k]
            for t in range(t0, t1):
                fed = doc[t - 1][0] if 0 < t < len(doc) else vocab.start
                rows["x"].add(fed)
                h, kept = step(w, fed, h)
                back = np.zeros(H)
                if t < len(doc):
                    word, cls = doc[t]
                    n += 1
                    back = logp(w, vocab, h, word, cls, grad)[1]
                    if cls < vocab.classes:
                        for name, row in (("wo", cls), ("wb", cls), ("go", cls // vocab.group), ("gb", cls // vocab.group)):
                            if name in rows:
                                rows[name].add(row)
                tape.append((kept, back))
            states[k] = h
            dh = np.zeros(H)
            for (fed, before, z, r, cand, hu), back in reversed(tape):
                dh = dh + back
                dcand = dh * (1 - z) * (1 - cand * cand)
                dz, dr = dh * (before - cand) * z * (1 - z), dcand * hu[2 * H :] * r * (1 - r)
                du = np.concatenate([dz, dr, dcand * r])
                dg = np.concatenate([dz, dr, dcand])
                grad["u"] += np.outer(before, du)
                grad["b"] += dg
                grad["x"][fed] += dg
                dh = dh * z + w["u"] @ du
        some = {k: (sorted(rows[k]) if k in rows else slice(None)) for k in w}
        for k in w:
            grad[k] /= n
            norm += float((grad[k][some[k]] ** 2).sum())
        steps += 1
        for k in w:
            g = grad[k][some[k]] / max(1.0, np.sqrt(norm) / 5)
            m[k][some[k]] = 0.9 * m[k][some[k]] + 0.1 * g
            v[k][some[k]] = 0.99 * v[k][some[k]] + 0.01 * g * g
            scale = gru_lm.RATE * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
            w[k][some[k]] += scale * m[k][some[k]] / (np.sqrt(v[k][some[k]]) + 1e-8)


@pytest.mark.parametrize("flat", [32, 4])
def test_score_equals_a_plain_rerun(spark, monkeypatch, flat):
    """With and without groups of classes; texts longer than a window and empty ones."""
    monkeypatch.setattr(gru_lm, "FLAT", flat)
    monkeypatch.setattr(gru_lm, "GROUP", 3)
    rng = random.Random(20)
    vocab_words = [f"w{int(rng.paretovariate(0.6)) % 700}" for _ in range(4000)]
    data = [(i, " ".join(rng.choice(vocab_words) for _ in range(rng.randrange(0, 90)))) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in gru_lm.score(docs).collect()}
    learnt = docs.filter(~gru_lm.held_out(docs["doc_id"]))
    counts = {r["hash"]: r["c"] for r in gru_lm.count_types(learnt).collect()}
    vocab = gru_lm.vocabulary(gru_lm.count_types(learnt))
    assert vocab.group == (1 if flat == 32 else 3)

    def encoded(text):
        h = gru_lm.hashes([text])[0]
        c = np.array([counts.get(int(x), 0) for x in h.view(np.int64)], np.int64)
        fed, cls, share = vocab.encode(h, c)
        return list(zip(fed.tolist(), cls.tolist(), strict=True)), float(share.sum())

    w = {k: x.astype(np.float64) for k, x in gru_lm.initial_weights(vocab).items()}
    train(w, vocab, [encoded(t)[0] for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2])
    for i, t in data:
        doc, total = encoded(t)
        h, before = np.zeros(H), vocab.start
        for word, cls in doc:
            h, _ = step(w, before, h)
            total += logp(w, vocab, h, word, cls)[0]
            before = word
        assert got[i] == pytest.approx(total / np.log(10), rel=2e-4), i


def test_probabilities_with_groups_sum_to_one(monkeypatch):
    monkeypatch.setattr(gru_lm, "FLAT", 4)
    monkeypatch.setattr(gru_lm, "GROUP", 3)
    h = np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = np.sort(np.random.default_rng(1).integers(2, 900, 512))[::-1].astype(np.int64)
    vocab = gru_lm.Vocabulary(h, c, np.zeros((2, gru_lm.BINS)), int(c.sum()) + 1, 513)
    w = gru_lm.initial_weights(vocab)
    fed, cls, share = vocab.encode(np.append(h, np.uint64(5)), np.append(c, 0))
    logs = gru_lm.log_likelihood(w, np.ones((513, H), np.float32) * 0.3, fed, cls)[0] + share
    assert len(w["go"]) == 3 and np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_cost_of_a_token_hardly_grows_with_the_types():
    """From 512 learned types to 10,000; the loose bound allows for a busy machine."""
    took = {}
    for learned in (512, 10_000):
        z = 1 / np.arange(1, 100_001)
        c, h = np.maximum(1, z * 3e8).astype(np.int64), np.arange(1, 100_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.zeros((2, gru_lm.BINS))
        bins = np.frexp(c[learned:].astype(float))[1] - 1
        np.add.at(sums[0], bins, c[learned:])
        np.add.at(sums[1], bins, 1)
        vocab = gru_lm.Vocabulary(h[:learned], c[:learned], sums, int(c.sum()), len(c))
        ids = np.random.default_rng(3).choice(len(c), 200_000, p=z / z.sum())
        fed, cls, _ = vocab.encode(h[ids], c[ids])
        w = gru_lm.initial_weights(vocab)
        began = time.process_time()
        gru_lm.train_pool(w, vocab, gru_lm.Adam(w, gru_lm.RATE), fed, cls, np.full(500, 400))
        took[learned] = time.process_time() - began
    assert took[10_000] < 2.6 * took[512], took
