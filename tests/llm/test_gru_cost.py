"""What a token costs the recurrent model: types are looked up once a pool, and rows are worked on in pieces that stay in a core's cache."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import gru_lm


def vocabulary(learned=1000, types=20_000):
    h = np.arange(1, types + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = np.maximum(1, 3e6 / np.arange(1, types + 1)).astype(np.int64)
    sums = np.zeros((2, gru_lm.BINS))
    bins = np.frexp(c[learned:].astype(float))[1] - 1
    np.add.at(sums[0], bins, c[learned:])
    np.add.at(sums[1], bins, 1)
    return gru_lm.Vocabulary(h[:learned], c[:learned], sums, int(c.sum()), types), h, c


def test_a_type_is_looked_up_once_a_pool(monkeypatch):
    vocab, h, c = vocabulary()
    order, ids = np.argsort(h), np.random.default_rng(1).zipf(1.3, 50_000) % len(h)
    shared, asked, encode = gru_lm.Shared(h[order][::2], c[order][::2], vocab, gru_lm.initial_weights(vocab)), [], gru_lm.Vocabulary.encode

    def counted(self, h, c):
        asked.append(len(h))
        return encode(self, h, c)

    monkeypatch.setattr(gru_lm.Vocabulary, "encode", counted)
    held = set(shared.hash.tolist())
    rare = [{"hash": int(h[k].view(np.int64)), "c": int(c[k])} for k in range(0, len(h), 3) if int(h[k]) not in held]
    rest = pa.table({"rare": pa.array([rare, None], pa.list_(pa.struct([("hash", pa.int64()), ("c", pa.int64())])))})
    got = gru_lm._encoded(shared, h[ids], rest)
    assert asked == [len(np.unique(ids))]
    known = {int(h[k]): int(c[k]) for k in range(len(h)) if int(h[k]) in held or k % 3 == 0}
    counts = np.array([known.get(int(x), 0) for x in h[ids]], np.int64)
    for a, b in zip(got, (counts, *encode(vocab, h[ids], counts)), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("flat", [32, 4])
def test_a_window_is_worked_on_in_pieces(monkeypatch, flat):
    """Beside what it returns, a window of twice the rows takes little more memory, and pieces don't change what it returns."""
    monkeypatch.setattr(gru_lm, "FLAT", flat)
    vocab, h, c = vocabulary()
    w, rng = gru_lm.initial_weights(vocab), np.random.default_rng(2)
    ids = rng.zipf(1.3, 24_000) % len(h)
    fed, cls, _ = vocab.encode(h[ids], c[ids])
    states = rng.normal(size=(len(ids), gru_lm.HIDDEN)).astype(np.float32)
    peak, found = {}, {}
    for n in (12_000, 24_000):
        grad = {k: np.zeros_like(x) for k, x in w.items()}
        tracemalloc.start()
        found[n] = *gru_lm.log_likelihood(w, states[:n], fed[:n], cls[:n], grad), grad
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    # 12,000 rows more; their logits of classes and of words in a class alone are 300 bytes a row, and were held at once with copies
    assert (peak[24_000] - peak[12_000]) / 12_000 < 640, peak
    grad = {k: np.zeros_like(x) for k, x in w.items()}
    halves = [gru_lm.log_likelihood(w, states[a:b], fed[a:b], cls[a:b], grad) for a, b in ((0, 777), (777, 24_000))]
    assert np.allclose(np.concatenate([x[0] for x in halves]), found[24_000][0], rtol=1e-4, atol=1e-5)
    assert np.allclose(np.concatenate([x[1] for x in halves]), found[24_000][1], rtol=1e-3, atol=1e-5)
    for k, x in grad.items():
        assert np.allclose(x, found[24_000][2][k], rtol=1e-3, atol=1e-2), k


@pytest.mark.parametrize("n", [0, 1, 31, 5000])
def test_sums_by_id(n):
    rng = np.random.default_rng(n)
    ids, parts = rng.zipf(1.4, n) % 900, rng.normal(size=(3, n, 16))
    own, sums = gru_lm._sums(parts, ids)
    want = np.zeros((900, 3, 16))
    np.add.at(want, ids, parts.transpose(1, 0, 2))
    assert sorted(own) == sorted(set(ids.tolist())) and np.allclose(sums.transpose(1, 0, 2), want[own])
