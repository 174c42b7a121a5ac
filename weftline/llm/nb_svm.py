"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of orders 1 to 4 over two streams of a text: its bytes (hashed), and
its words read as marks, 1 for a word equal to the one before and 0 for others. Each is scaled by its log-count ratio, the log of its
smoothed share among documents of label 1 over that among label 0, counted over
all labelled training documents; the rows are then normalised and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve over
the training margins turns margins into scores.

The log-count ratios and the scores cover all documents. The hinge-loss fit takes at most
``SAMPLE`` labelled documents of each class, those with the smallest hash of
doc_id, so that it fits the driver at any corpus size.

Labels above 0 count as 1.

Cases: null and empty texts have no n-gram and get the score of the constant
feature alone; a document with several labels takes the largest; null labels
and null ids are not learnt from; with labels of one class only the score is
that class's smoothed share; repeated rows are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, sized_broadcast, table

BUCKETS = 1 << 16
ORDERS = 4
#: The last buckets: one for each n-gram of marks.
MARKS = (1 << (ORDERS + 1)) - 2
#: Labelled documents of each class for the hinge-loss fit.
SAMPLE = 3000
COST = 1.0
EPOCHS = 20
SMOOTHING = 1.0


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted numbers of the features that a whole text has."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen = np.zeros(buckets, bool)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(b), np.uint32)
    for order in range(1, ORDERS + 1):
        if len(b) < order:
            break
        h = h[: len(b) - order + 1] * np.uint32(0x01000193) + b[order - 1 :]
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order)
        seen[(x ^ (x >> np.uint32(13))) % np.uint32(buckets - MARKS)] = True
    words = raw.split()
    marks = np.fromiter(map(bytes.__eq__, words, words[1:]), np.int64, max(len(words) - 1, 0))
    number = np.zeros(len(marks), np.int64)
    for order in range(1, min(ORDERS, len(marks)) + 1):
        number = number[: len(marks) - order + 1] * 2 + marks[order - 1 :]
        seen[buckets - MARKS + (1 << order) - 2 + np.unique(number)] = True
    return np.flatnonzero(seen)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    return docs.join(sized_broadcast(materialize(known, "nbsvm-labels")), "doc_id").select("doc_id", "text", "quality")


def class_counts(labelled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """2 x (buckets + 1): documents of label 0 and 1 with each feature; last, all documents."""

    def run(batches):
        counts = np.zeros((2, buckets + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                row = counts[int(label > 0)]
                row[features(text, buckets)] += 1
                row[buckets] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "c0", "c1"])

    out = np.zeros((2, buckets + 1), np.int64)
    sums = labelled.select("text", "quality").mapInArrow(run, "bucket long, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    out[0, sums["bucket"]], out[1, sums["bucket"]] = sums["c0"], sums["c1"]
    return out


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    share = counts[:, :-1] + smoothing
    share = share / share.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def vector(at: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a document's row; the last position is the constant feature."""
    x = ratios[at]
    norm = float(np.sqrt(x @ x)) or 1.0
    return np.append(at, len(ratios)), np.append(x / norm, 1.0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i)."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    square = [float(v @ v) for _, v in rows]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) fitted by Newton's method to targets that are kept off 0 and 1."""
    up, down = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (p - t) + 1e-6 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = COST) -> dict:
    """Model: ratios, weights, and the curve's a and b."""
    labelled = _labelled(docs, labels)
    counts = class_counts(labelled)
    ratios = log_count_ratios(counts)
    zero, one = (int(x) for x in counts[:, -1])
    if not zero or not one:
        share = (one + 1) / (zero + one + 2)
        return {"ratios": ratios, "weights": np.zeros(len(ratios) + 1), "a": 0.0, "b": float(np.log(share / (1 - share)))}
    ids = labelled.select("doc_id", "quality").distinct()
    chosen = [ids.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id")) for q in (0, 1)]

    def run(batches):
        for batch in batches:
            lists = [features(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "quality", "at"])

    kind = {c: labelled.schema[c].dataType.simpleString() for c in ("doc_id", "quality")}
    # two samples of at most `sample` ids each
    picked = labelled.join(F.broadcast(materialize(chosen[0].union(chosen[1]), "nbsvm-sample")), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text")
    found = picked.mapInArrow(run, f"doc_id {kind['doc_id']}, quality {kind['quality']}, at array<int>").toArrow()
    lists = found.column("at").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    ids, quality = found.column("doc_id").to_pylist(), found.column("quality").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], ends[i + 1] - ends[i], values[ends[i] : ends[i + 1]].tobytes()))
    rows = [vector(values[ends[i] : ends[i + 1]], ratios) for i in order]
    y = np.array([1.0 if quality[i] > 0 else -1.0 for i in order])
    # classes weigh as they do among all labelled documents
    part = {1.0: one / max(1, (y > 0).sum()), -1.0: zero / max(1, (y < 0).sum())}
    weigh = np.array([part[v] for v in y])
    weights = dual_coordinate_descent(rows, y, len(ratios) + 1, cost * weigh / weigh.mean())
    margins = np.array([float(weights[at] @ v) for at, v in rows])
    a, b = logistic_curve(margins, y)
    return {"ratios": ratios, "weights": weights, "a": a, "b": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS numbers
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        scaled = m["ratios"] * m["weights"][:-1]
        square = m["ratios"] ** 2
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = features(text)
                norm = float(np.sqrt(square[at].sum())) or 1.0
                out[i] = m["a"] * (float(scaled[at].sum()) / norm + m["weights"][-1]) + m["b"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
