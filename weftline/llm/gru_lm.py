"""LM scoring with a gated recurrent network in numpy.

Counts of all training tokens are gathered from the whole corpus and give the
base score (add-one unigrams) and the classes of the output softmax: all types counted
at least sqrt(training tokens) / ``BAR`` times, which are the more the larger the corpus is (and the
``CLASSES`` * ``CLASS_WORDS`` most frequent at least), in classes of ``CLASS_WORDS`` with learned softmaxes inside, all
others in one class for each power of two of their count, with their share of
the class's count inside; words counted once and unknown words share the last
kind, each with equal share. More than ``FLAT`` classes are chosen in two steps, a group of ``GROUP`` first, so what a token costs hardly grows with the types. So the model spreads its probability over the same V + 1 types
as the base score.

The recurrent weights are trained by truncated backpropagation: every task trains
on its documents in windows of ``WINDOW`` tokens, the state carried from window to
window, and the weights are averaged over tasks, by tokens, after each of ``ROUNDS``
rounds. A window updates the rows of the words and classes that it holds, no others, and tasks give their weights as blocks that are added up in two steps. Every round passes over the whole texts of all training documents, whatever the
size of the corpus. Documents are dealt into tasks by their ids, so the weights, and so ``score``, do not depend on how the input is cut into files. Scoring carries the state through the whole document, whatever its length.

Words are counted under 64-bit hashes. The counts of the commonest
``SHARED_TYPES`` types are broadcast; rarer types, which by definition are in few
documents each, are joined by hash, so nothing broadcast grows with the corpus. Training and scoring
see the same counts either way.

Cases: null and empty texts are the end token alone; null ids are held out of
training; rows that repeat are counted and scored each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, sized_broadcast, slices, table

HIDDEN = 16
#: Words of a class, and the least number of classes.
CLASS_WORDS, CLASSES = 64, 8
#: Classes of a group, and the number of classes up to which there are no groups.
GROUP, FLAT = 16, 32
#: Rows of one class in a block, blocks that are multiplied at once, and rows for which the class is chosen at once: what they take stays in a core's cache.
BLOCK_ROWS, AT_ONCE, TOP_ROWS = 32, 64, 2048
#: A number fed in that has more rows in a window has them added up by itself.
MANY_ROWS = 32
#: Weights of a block, and sums of blocks in the first of two steps.
BLOCK_WEIGHTS, PARTS = 65536, 64
BAR = 2
#: Powers of two of counts; a model has as many bins as its rare types need.
BINS = 48
WINDOW, LANES, TRAIN_LANES = 24, 1024, 512
#: Passes over all training documents.
ROUNDS = 1
RATE = 0.02
SHARED_TYPES = 4_000_000
#: Tokens that a task holds at once.
POOL_TOKENS = 3_000_000
#: Tokens that a task learns from, about.
TASK_TOKENS = 3_000_000
END = b"\n</end>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and how many each text has."""
    import xxhash

    lists = [tokens(x) for x in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, int(n.sum()))
    return flat, n


def count_types(docs: DataFrame) -> DataFrame:
    """(hash, c) over all tokens of ``docs`` (text)."""

    def run(batches):
        held, size = [], 0

        def merged():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[first], np.add.reduceat(c, first)

        for whole in batches:
            for part in slices(whole, 0, 1024):
                h, c = np.unique(hashes(part.column("text").to_pylist())[0], return_counts=True)
                held.append((h, c))
                size += len(h)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["hash", "c"])
                        held, size = [], 0
        if held:
            h, c = merged()
            for at in range(0, len(h), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 65536].view(np.int64)), pa.array(c[at : at + 65536])], names=["hash", "c"])

    return docs.select("text").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Classes of types. ``frequent``: hashes of the words with learned weights, in class order; ``sums``: of each bin, its count and number of types."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, sums: np.ndarray, total: int, types: int):
        least = int(counts.min()) if len(counts) else 2
        self.classes = max(CLASSES, -(-len(counts) // CLASS_WORDS))
        words = np.zeros(self.classes * CLASS_WORDS)
        words[: len(counts)] = counts
        words = words.reshape(self.classes, CLASS_WORDS)
        # where the network starts: the logs of the shares of groups, of classes inside them, and of words inside these
        self.bins = max(1, int(np.flatnonzero(sums[1] > 0).max(initial=0)) + 1)
        held = words.sum(axis=1)
        self.group = GROUP if self.classes > FLAT else 1
        self.groups = -(-self.classes // self.group)
        classes = np.zeros(self.groups * self.group)
        classes[: self.classes] = held
        classes = classes.reshape(self.groups, self.group)
        self.within = np.log(classes + 0.5 * (np.arange(classes.size).reshape(classes.shape) < self.classes) + 1e-9)
        self.prior = np.log(np.concatenate([classes.sum(axis=1), sums[0][: self.bins]]) + 0.5)
        self.inside = np.log(words + 0.01)
        self.frequent, self.least, self.total, self.types = frequent, least, total, types
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]
        count, n = sums
        # inside a bin a type has its count's share; once-counted and unknown types have equal shares
        self.bin_log = -np.log(np.maximum(count, 1.0))
        self.bin_log[0] = -np.log(n[0] + 1.0)
        self.start = self.classes * CLASS_WORDS + self.bins

    def encode(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the number under which it is fed in, its class, and the log share inside a bin (0 for frequent words)."""
        bins = np.minimum(np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1, self.bins - 1)
        cls, fed = self.classes + bins, self.classes * CLASS_WORDS + bins
        share = self.bin_log[bins] + np.where(bins > 0, np.log(np.maximum(c, 1)), 0.0)
        if len(self.sorted):
            some = np.flatnonzero(c >= self.least)
            at = np.minimum(np.searchsorted(self.sorted, h[some]), len(self.sorted) - 1)
            hit = self.sorted[at] == h[some]
            some, word = some[hit], self.order[at[hit]]
            fed[some], cls[some], share[some] = word, word // CLASS_WORDS, 0.0
        return fed.astype(np.int32), cls.astype(np.int32), share


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (hash, c). Brings the frequent words and one row for each bin to the driver."""
    sums = np.zeros((2, BINS))
    for r in counts.groupBy(F.floor(F.log2("c") + 1e-12).cast("int").alias("bin")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toLocalIterator():
        sums[:, r["bin"]] += r["c"], r["n"]
    total, types = int(sums[0].sum()), int(sums[1].sum())
    learned = counts.filter(F.col("c") >= float(np.sqrt(total) / BAR)).count()
    top = counts.orderBy(F.desc("c"), "hash").limit(max(learned, CLASSES * CLASS_WORDS)).toPandas()
    top = top[top["c"] > 1]
    c = top["c"].to_numpy(np.int64)
    np.subtract.at(sums[0], np.frexp(c.astype(np.float64))[1] - 1, c)
    np.subtract.at(sums[1], np.frexp(c.astype(np.float64))[1] - 1, 1)
    return Vocabulary(top["hash"].to_numpy(np.int64).view(np.uint64), c, sums, total, types)


def initial_weights(vocab: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
    level = lambda x, axis: x - x.max(axis=axis, keepdims=True)
    w = {"x": rng.normal(0, 0.3, (vocab.start + 1, 3 * HIDDEN)), "u": u, "b": np.zeros(3 * HIDDEN), "co": rng.normal(0, 0.1, (HIDDEN, vocab.groups + vocab.bins)), "cb": level(vocab.prior, 0), "wo": rng.normal(0, 0.1, (vocab.classes, HIDDEN, CLASS_WORDS)), "wb": level(vocab.inside, 1)}
    if vocab.group > 1:
        w |= {"go": rng.normal(0, 0.1, (vocab.groups, HIDDEN, vocab.group)), "gb": level(vocab.within, 1)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def recur(w: dict, fed: np.ndarray, h: np.ndarray, keep: bool):
    """States of a window: fed is (steps, lanes). With ``keep``, also what backpropagation needs.

    The parts z, r and n of what a step works out lie each in one piece, so that it runs along rows that lie side by side.
    """
    (steps, lanes), H = fed.shape, HIDDEN
    kind = np.result_type(h, w["u"])
    g, flat, table = np.empty((3, steps, lanes, H), w["x"].dtype), fed.ravel() * 3, w["x"].reshape(-1, H)
    for k in range(3):
        np.take(table, flat + k, axis=0, out=g[k].reshape(-1, H), mode="clip")
        part = g[k].reshape(steps, -1)
        part += np.tile(w["b"][k * H : (k + 1) * H], lanes)
    # gates are 1 / (1 + exp(-x)): their minus is in the weights
    u = w["u"].reshape(H, 3, H).transpose(1, 0, 2) * np.array([-1, -1, 1], w["u"].dtype)[:, None, None]
    out, cand = np.empty((2, steps, lanes, H), kind)
    hu = np.empty((3, steps if keep else 1, lanes, H), kind)
    first = h
    for t in range(steps):
        held = hu[:, t if keep else 0]
        np.matmul(h, u, out=held)
        zr, n, new = held[:2], cand[t], out[t]
        zr -= g[:2, t]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], held[2], out=n)
        n += g[2, t]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= zr[0]
        new += n
        h = new
    return out, (first, out, cand, hu) if keep else None


def _log_softmax(x):
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of small numbers; of 16 bits they are sorted by counting."""
    return np.argsort(x.astype(np.uint16) if x.size and x.max() < 65536 else x, kind="stable")


def _inner(w: dict, kind: str, states: np.ndarray, which: np.ndarray, owner: np.ndarray, target: np.ndarray, out: np.ndarray, grad: dict | None, back: np.ndarray | None) -> None:
    """Adds to ``out`` the log probability of ``target`` under the softmax of its ``owner`` (a class, or a group of classes: ``kind`` w or g) for the rows ``which`` of ``states``, whose last column is 1, and with ``grad`` to ``back`` the gradients of the states.

    Rows are sorted by owner and multiplied in blocks of ``BLOCK_ROWS`` rows of one owner, ``AT_ONCE`` blocks at once.
    """
    H, width = states.shape[1] - 1, w[f"{kind}o"].shape[2]
    order, counts = _order(owner), np.bincount(owner)
    own = np.flatnonzero(counts)
    counts = counts[own]
    blocks = -(-counts // BLOCK_ROWS)
    first = np.cumsum(blocks) - blocks
    # where each row stands in the blocks
    place = np.repeat(first * BLOCK_ROWS - (np.cumsum(counts) - counts), counts) + np.arange(len(order))
    of, held = np.repeat(np.arange(len(own)), blocks), int(blocks.sum())
    # biases are the weights of the last column
    weights = np.concatenate([w[f"{kind}o"][own], w[f"{kind}b"][own][:, None, :]], axis=1)
    x = np.zeros((held * BLOCK_ROWS, H + 1), states.dtype)
    rows = which[order]
    x[place] = states.take(rows, axis=0)
    x = x.reshape(held, BLOCK_ROWS, H + 1)
    block, row = np.divmod(place, BLOCK_ROWS)
    # where the targets stand in (block, word, row)
    hit, logs = (block * width + target[order]) * BLOCK_ROWS + row, np.empty(len(order), np.float64)
    if grad is not None:
        pushed, returned = np.empty((held, width, H + 1), states.dtype), np.empty((held, BLOCK_ROWS, H), states.dtype)
    ones = np.ones((1, width), states.dtype)
    cuts = np.searchsorted(block, np.arange(0, held, AT_ONCE))
    for a, i, j in zip(range(0, held, AT_ONCE), cuts, np.append(cuts[1:], len(order)), strict=True):
        b, mine, at = min(held, a + AT_ONCE), place[i:j] - a * BLOCK_ROWS, hit[i:j] - a * width * BLOCK_ROWS
        some = weights[of[a:b]]
        # (block, word, row): sums over words then run along rows that lie side by side
        d = some.transpose(0, 2, 1) @ x[a:b].transpose(0, 2, 1)
        np.minimum(d, 60, out=d)
        logs[i:j] = d.ravel()[at]
        np.exp(d, out=d)
        total = (ones @ d)[:, 0]
        sums = total.ravel()[mine]
        logs[i:j] -= np.log(sums)
        if grad is None:
            continue
        scale = np.zeros_like(total)
        scale.ravel()[mine] = -1 / sums  # rows that only fill a block have no gradient
        d *= scale[:, None, :]
        d.ravel()[at] += 1
        np.matmul(d, x[a:b], out=pushed[a:b])
        np.matmul(d.transpose(0, 2, 1), some[:, :H].transpose(0, 2, 1), out=returned[a:b])
    out[rows] += logs
    if grad is None:
        return
    for k, a, n in zip(own.tolist(), first.tolist(), blocks.tolist(), strict=True):
        one = pushed[a : a + n].sum(axis=0) if n > 1 else pushed[a]
        grad[f"{kind}o"][k] += one[:, :H].T
        grad[f"{kind}b"][k] += one[:, H]
    back[rows] += returned.reshape(-1, H).take(place, axis=0)


def log_likelihood(w: dict, states: np.ndarray, word: np.ndarray, cls: np.ndarray, grad: dict | None = None):
    """Log probability of each token's class and, for frequent words, of the word inside it. With ``grad``, adds gradients there and returns those of the states, too."""
    classes, group = len(w["wo"]), w["go"].shape[2] if "go" in w else 1
    frequent = np.flatnonzero(cls < classes)
    # the groups come first, then the bins
    top = np.where(cls < classes, cls // group, cls - classes + -(-classes // group))
    weights = np.concatenate([w["co"].T, w["cb"][:, None]], axis=1)
    ones = np.ones((len(states), states.shape[1] + 1), states.dtype)
    ones[:, :-1] = states
    out, back = np.empty(len(top), np.float64), None if grad is None else np.empty_like(states)
    for a in range(0, len(top), TOP_ROWS):
        some = top[a : a + TOP_ROWS]
        x = ones[a : a + TOP_ROWS]
        at = some * len(some) + np.arange(len(some))
        # logits (classes, rows), from which come, in place, the gradients
        d = weights @ x.T
        d -= d.max(axis=0)
        logs = d.ravel()[at]
        np.exp(d, out=d)
        total = d.sum(axis=0)
        out[a : a + TOP_ROWS] = logs - np.log(total)
        if grad is not None:
            d *= -1 / total
            d.ravel()[at] += 1
            pushed = d @ x
            grad["co"] += pushed[:, :-1].T
            grad["cb"] += pushed[:, -1]
            np.matmul(d.T, w["co"].T, out=back[a : a + TOP_ROWS])
    if len(frequent):
        own = cls[frequent]
        _inner(w, "w", ones, frequent, own, word[frequent] % CLASS_WORDS, out, grad, back)
        if group > 1:
            _inner(w, "g", ones, frequent, own // group, own % group, out, grad, back)
    return out, back


def _sums(parts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and of each the sum of its rows in (parts, rows, width)."""
    order, counts = _order(ids), np.bincount(ids)
    own = np.flatnonzero(counts)
    counts = counts[own]
    by = np.argsort(-counts, kind="stable")
    own, counts, first = own[by], counts[by], (np.cumsum(counts) - counts)[by]
    many = int(np.searchsorted(-counts, -MANY_ROWS))
    sums = np.empty((len(parts), len(own), parts.shape[2]), parts.dtype)
    for k in range(many):
        rows = parts.take(order[first[k] : first[k] + counts[k]], axis=1)
        sums[:, k] = np.ones(rows.shape[1], rows.dtype) @ rows
    # of the others the first rows, then the second rows of those that have any
    for k in range(int(counts[many]) if many < len(own) else 0):
        end = int(np.searchsorted(-counts, -k))
        rows = parts.take(order[first[many:end] + k], axis=1)
        if k:
            sums[:, many:end] += rows
        else:
            sums[:, many:end] = rows
    return own, sums


def backward(w: dict, grad: dict, fed: np.ndarray, tape: tuple, d_out: np.ndarray) -> None:
    (steps, lanes), H = fed.shape, HIDDEN
    first, out, cand, hu = tape
    # of n, z and r in this order, then of n before the reset gate: the first three are what h @ u gets, the last three what is fed in
    d = np.empty((4, steps, lanes, H), d_out.dtype)
    u = np.ascontiguousarray(w["u"].reshape(H, 3, H).transpose(1, 2, 0)[[2, 0, 1]])
    dh, a, b, through = np.zeros_like(d_out[0]), np.empty_like(d_out[0]), np.empty_like(d_out[0]), np.empty((3, lanes, H), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, n, (z, r, hun), (dnr, dz, dr, dn) = out[t - 1] if t else first, cand[t], hu[:, t], d[:, t]
        dh += d_out[t]
        # dn = dh (1 - z) before the tanh, dz = dn (h - n) z
        dh_z = np.multiply(dh, z, out=a)
        np.subtract(dh, dh_z, out=dn)
        np.subtract(h, n, out=dz)
        dz *= z
        dz *= dn
        np.multiply(n, n, out=b)
        b *= dn
        dn -= b
        np.multiply(dn, r, out=dnr)
        np.multiply(dnr, hun, out=dr)
        np.multiply(dr, r, out=b)
        dr -= b
        np.matmul(d[:3, t], u, out=through)
        np.add(dh_z, through[0], out=dh)
        dh += through[1]
        dh += through[2]
    before = np.concatenate([first[None], out[:-1]]).reshape(-1, H).T
    for k, part in enumerate((1, 2, 0)):
        grad["u"][:, k * H : (k + 1) * H] += before @ d[part].reshape(-1, H)
    own, sums = _sums(d[1:].reshape(3, -1, H), fed.ravel())
    sums = sums.transpose(1, 0, 2).reshape(-1, 3 * H)
    grad["b"] += sums.sum(axis=0)
    grad["x"][own] += sums


def windows(lengths: np.ndarray, lanes: int = LANES):
    """(documents, first step, steps): windows of groups of documents of like length, longest first; a window holds the documents that are not over."""
    order = np.argsort(-lengths, kind="stable")
    for a in range(0, len(order), lanes):
        group = order[a : a + lanes]
        for t in range(0, int(lengths[group[0]]), WINDOW):
            alive = group[: int(np.searchsorted(-lengths[group], -t, side="left"))]
            yield alive, t, min(WINDOW, int(lengths[group[0]]) - t)


def _batched(fed, cls, starts, lengths, start_id, lanes=LANES):
    """Of each window: documents, whether it is their first, (steps, lanes) arrays of what is fed in, targets and classes, and the mask."""
    for docs, t, steps in windows(lengths, lanes):
        at = t + np.arange(steps)[:, None]
        real = at < lengths[docs][None, :]
        index = np.where(real, starts[docs][None, :] + at, 0)
        before = np.where(at > 0, fed[np.maximum(index - 1, 0)], start_id)
        yield docs, t == 0, np.where(real, before, start_id), fed[index], cls[index], real, index


def score_pool(w: dict, vocab: Vocabulary, fed: np.ndarray, cls: np.ndarray, share: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each document."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.add.reduceat(share, starts) if len(lengths) else np.zeros(0)
    h = None
    for docs, fresh, before, word, c, real, _ in _batched(fed, cls, starts, lengths, vocab.start):
        h = np.zeros((len(docs), HIDDEN), np.float32) if fresh else h[: len(docs)]
        states, _ = recur(w, before, h, False)
        h = states[-1]
        got, at = np.zeros(real.shape), np.flatnonzero(real)
        got.ravel()[at] = log_likelihood(w, states.reshape(-1, HIDDEN)[at], word.ravel()[at], c.ravel()[at])[0]
        out[docs] += got.sum(axis=0)
    return out


class Adam:
    """Steps of Adam on the rows that a window touched; other rows keep their weights and their averages."""

    def __init__(self, w: dict, rate: float):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0, rate

    def step(self, w: dict, grad: dict, rows: dict) -> None:
        """``grad``: of each kind of weight the gradients of its ``rows``, or of all."""
        self.t += 1
        for k, g in grad.items():
            at = rows.get(k, slice(None))
            m, v = self.m[k][at], self.v[k][at]
            step = g * np.float32(0.1)
            m *= np.float32(0.9)
            m += step
            step *= g
            step *= np.float32(0.1)  # 0.01 g * g
            v *= np.float32(0.99)
            v += step
            self.m[k][at], self.v[k][at] = m, v
            np.sqrt(v, out=step)
            step += np.float32(1e-8)
            np.divide(m, step, out=step)
            step *= np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
            w[k][at] += step


def train_pool(w: dict, vocab: Vocabulary, adam: Adam, fed: np.ndarray, cls: np.ndarray, lengths: np.ndarray) -> None:
    """One pass of truncated backpropagation; raises the mean log probability. What a window costs depends on its tokens, not on the number of types."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    h, grad = None, {k: np.zeros_like(x) for k, x in w.items()}
    for docs, fresh, before, word, c, real, _ in _batched(fed, cls, starts, lengths, vocab.start, TRAIN_LANES):
        h = np.zeros((len(docs), HIDDEN), np.float32) if fresh else h[: len(docs)]
        states, tape = recur(w, before, h, True)
        h = states[-1]
        at = np.flatnonzero(real)
        some = c.ravel()[at]
        d_out = np.zeros_like(states)
        d_out.reshape(-1, HIDDEN)[at] = log_likelihood(w, states.reshape(-1, HIDDEN)[at], word.ravel()[at], some, grad)[1]
        backward(w, grad, before, tape, d_out)
        held = np.flatnonzero(np.bincount(some, minlength=vocab.classes)[: vocab.classes])
        rows = {"x": np.flatnonzero(np.bincount(before.ravel())), "wo": held, "wb": held}
        if vocab.group > 1:
            rows |= dict.fromkeys(("go", "gb"), np.unique(held // vocab.group))
        n = max(1, len(at))
        some = {k: g[rows[k]] if k in rows else g.copy() for k, g in grad.items()}
        size = float(np.sqrt(sum(float(g.ravel() @ g.ravel()) for g in some.values()))) / n
        for g in some.values():
            g /= n * max(1.0, size / 5.0)
        adam.step(w, some, rows)
        for k, g in grad.items():
            g[rows.get(k, slice(None))] = 0


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes as they first come, and where each one stands there."""
    found = pa.array(h).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


class Shared:
    """What every task needs: sorted hashes and counts of the shared types, the vocabulary, the weights."""

    def __init__(self, hash_: np.ndarray, count: np.ndarray, vocab: Vocabulary, weights: dict):
        self.hash, self.count, self.vocab, self.weights = hash_, count, vocab, weights

    def counts(self, h: np.ndarray) -> np.ndarray:
        distinct, back = _distinct(h)
        return self.counts_of(distinct)[back]

    def counts_of(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(distinct), np.int64)
        order = np.argsort(distinct)  # in order, so that a search goes on near the last one
        at = np.empty(len(distinct), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hash, distinct[order]), len(self.hash) - 1)
        return np.where(self.hash[at] == distinct, self.count[at], 0)


def _pools(batches, columns: list[str]):
    """Rows with about ``POOL_TOKENS`` tokens, as lists of the columns; texts as hashes and lengths. A pool ends with the row that passes the bound, however the rows come in batches."""
    held, n = [], 0
    joined = lambda: (np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.Table.from_batches([x[2] for x in held]))
    for whole in batches:
        for part in slices(whole, whole.schema.get_field_index("text"), 512):
            h, lengths = hashes(part.column("text").to_pylist())
            rest = part.select(columns)
            while n + len(h) > POOL_TOKENS:
                ends = np.cumsum(lengths)
                k = int(np.searchsorted(ends, POOL_TOKENS - n, "right")) + 1
                held.append((h[: ends[k - 1]], lengths[:k], rest.slice(0, k)))
                yield joined()
                h, lengths, rest = h[ends[k - 1] :], lengths[k:], rest.slice(k)
                held, n = [], 0
            if len(lengths):
                held.append((h, lengths, rest))
                n += len(h)
    if held:
        yield joined()


def _encoded(shared: Shared, h: np.ndarray, rest: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a pool: the count of its type, and what ``Vocabulary.encode`` gives, worked out once a type. Counts are those of shared types and those that rows bring along as ``rare``."""
    distinct, back = _distinct(h)
    c = shared.counts_of(distinct)
    lists = rest.column("rare").combine_chunks() if "rare" in rest.column_names else []
    if len(lists) and lists.null_count < len(lists):
        found = lists.flatten()
        h2, first = np.unique(found.field("hash").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
        at = np.minimum(np.searchsorted(h2, distinct), len(h2) - 1)
        c = np.where((c == 0) & (h2[at] == distinct), found.field("c").to_numpy(zero_copy_only=False)[first][at], c)
    return c[back], *(x[back] for x in shared.vocab.encode(distinct, c))


BLOCK = "i int, part int, sum binary, n double"


def _block(i: int, part: int, sums: np.ndarray, n: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([float(n)])], names=["i", "part", "sum", "n"])


def _added(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
    """One block that is the sum of a group's."""
    total, n = None, 0.0
    # in a fixed order, so that sums don't depend on which task ended first
    rows = sorted(batches.to_pylist(), key=lambda r: (r["part"], r["n"], r["sum"]))
    for r in rows:
        one = np.frombuffer(r["sum"], np.float64)
        total = one.copy() if total is None else total + one
        n += r["n"]
    return pa.Table.from_batches([_block(rows[0]["i"], rows[0]["part"], total, n)])


def train(docs: DataFrame, shared: Shared, rounds: int = ROUNDS) -> dict:
    """Weights averaged over the tasks' own passes over ``docs`` (text and, if some types are not shared, rare), round by round."""
    spark, columns = docs.sparkSession, [c for c in ("text", "rare") if c in docs.columns]
    for k in range(rounds):
        sent, rate = spark.sparkContext.broadcast(shared), RATE / (1 + k)

        def run(batches, sent=sent, rate=rate):
            s = sent.value
            w, total = {k: x.copy() for k, x in s.weights.items()}, 0
            adam = Adam(w, rate)
            for h, lengths, rest in _pools(batches, columns[1:]):
                _c, fed, cls, _share = _encoded(s, h, rest)
                train_pool(w, s.vocab, adam, fed, cls, lengths)
                total += len(h)
            if total:
                flat = np.concatenate([w[k].ravel() for k in sorted(w)])
                part = TaskContext.get().partitionId() % PARTS
                for i, at in enumerate(range(0, len(flat), BLOCK_WEIGHTS)):
                    yield _block(i, part, flat[at : at + BLOCK_WEIGHTS].astype(np.float64) * total, total)

        blocks = docs.select(*columns).mapInArrow(run, BLOCK)
        # sums of a part of the tasks first, then of the parts
        for keys in (["i", "part"], ["i"]):
            blocks = blocks.groupBy(*keys).applyInArrow(_added, BLOCK)
        found = sorted(blocks.collect(), key=lambda r: r["i"])  # the weights themselves
        mean = np.concatenate([np.frombuffer(r["sum"], np.float64) / r["n"] for r in found]) if found else np.zeros(0)
        if len(mean):
            at, w = 0, {}
            for name in sorted(shared.weights):
                x = shared.weights[name]
                w[name] = mean[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
            shared = Shared(shared.hash, shared.count, shared.vocab, w)
        sent.unpersist()
    return shared.weights


def rare_counts(docs: DataFrame, counts: DataFrame, sent, least: int) -> DataFrame:
    """(doc_id, rare): for each document the hashes and counts of its types that are counted less than ``least`` times."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = sent.value
        for whole in batches:
            for part in slices(whole, whole.schema.get_field_index("text"), 512):
                h, lengths = hashes(part.column("text").to_pylist())
                row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                some = s.counts(h) == 0
                pairs = np.unique(np.rec.fromarrays([row[some], h[some]], names="r,h"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.ascontiguousarray(pairs["r"]))), pa.array(np.ascontiguousarray(pairs["h"]).view(np.int64))], names=["doc_id", "hash"])

    seen = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, hash long")
    return seen.join(counts.filter(F.col("c") < least), "hash").groupBy("doc_id").agg(F.collect_list(F.struct("hash", "c")).alias("rare"))


def score(docs: DataFrame, rounds: int = ROUNDS, shared_types: int = SHARED_TYPES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text); scores are log10 probabilities."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learnt = docs.filter(~held_out(F.col("doc_id")))
    counts = materialize(count_types(learnt), "lm-counts")
    vocab = vocabulary(counts)
    # the lowest count that at most `shared_types` types reach; counts of counts are few
    least, n = 1, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        n += r["n"]
        if n > shared_types:
            least = r["c"] + 1
            break
    known = counts.filter(F.col("c") >= least).toArrow()
    h, c = known.column("hash").to_numpy().view(np.uint64), known.column("c").to_numpy()
    order = np.argsort(h)
    shared = Shared(h[order], c[order], vocab, initial_weights(vocab))
    del known, h, c
    rows = docs.withColumn("rare", F.lit(None).cast("array<struct<hash:long,c:long>>"))
    if least > 1:
        sent = spark.sparkContext.broadcast(shared)
        rare = materialize(rare_counts(docs, counts, sent, least), "lm-rare").withColumnRenamed("doc_id", "rare_id")
        sent.unpersist()
        rows = docs.join(sized_broadcast(rare, weight=F.size("rare") * 16), F.col("doc_id").eqNullSafe(F.col("rare_id")), "left").drop("rare_id")
    # dealt by ids and in their order, so that the weights depend on the documents alone, not on their files or on how `rare` was joined to them
    dealt = rows.filter(~held_out(F.col("doc_id"))).repartition(max(1, -(-vocab.total // TASK_TOKENS)), "doc_id").sortWithinPartitions("doc_id", "text")
    shared = Shared(shared.hash, shared.count, vocab, train(dealt, shared, rounds))
    sent = spark.sparkContext.broadcast(shared)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = sent.value
        base = float(s.vocab.total + s.vocab.types + 1)
        for h, lengths, rest in _pools(batches, ["doc_id", "rare"]):
            c, fed, cls, share = _encoded(s, h, rest)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            logs = score_pool(s.weights, s.vocab, fed, cls, share, lengths) / np.log(10)
            columns = [rest.column("doc_id").combine_chunks(), pa.array(lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), s.vocab.total, np.int64)), pa.array(np.add.reduceat(np.log10((c + 1) / base), starts)), pa.array(logs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    done = rows.select("doc_id", "text", "rare").mapInArrow(run, f"doc_id {key}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
