"""Scores do not depend on where counts come from, nor on how the input is cut."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import gru_lm


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(24000)]
    rows = [(i, " ".join(words[i * 60 : i * 60 + rng.randrange(20, 60)])) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(docs, **how):
    return {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in gru_lm.score(docs, **how).collect()}


def test_counts_may_be_shared_or_joined(texts):
    plain, joined = scores(texts), scores(texts, shared_types=40)
    assert len(plain) == 400
    for k, (known, base, score) in plain.items():
        assert joined[k][0] == known and joined[k][1] == pytest.approx(base, rel=1e-12) and joined[k][2] == pytest.approx(score, rel=1e-5)


def test_files_of_the_input_do_not_matter(texts):
    one, many = scores(texts.coalesce(1)), scores(texts.repartition(7, F.col("doc_id") % 5))
    assert all(many[k][2] == pytest.approx(x[2], rel=1e-5) for k, x in one.items())


def test_pools_end_with_the_row_that_passes_the_bound(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(gru_lm, "POOL_TOKENS", 10)
    texts = ["a b c", "d", "a b c d e f g h i j k l", "", "x y", "a b c d e f"]
    whole = pa.RecordBatch.from_pydict({"text": texts, "k": list(range(6))})
    pools = lambda batches: [(h.tolist(), n.tolist(), rest.column("k").to_pylist()) for h, n, rest in gru_lm._pools(batches, ["k"])]
    found = pools([whole])
    assert found == pools([whole.slice(i, 1) for i in range(6)]) and [x[2] for x in found] == [[0, 1, 2], [3, 4, 5]]
