"""Counts of n-grams, added up from compressed blocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline import queries
from weftline.operators import stats

ODD = [["a", "b", "a", "b", "a"], [], None, ["é", "日本", "é"], ["a b", "c", "d"], ["a", "b c", "d"], ["x", None, "y", "z"], ["", "", "", ""], ["one"], [None, None, None], ["a", "b", "a"], ["a" * 300, "b", "a"]]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
@pytest.mark.parametrize("most", [4, 1 << 21])
def test_counts(spark, monkeypatch, n, most):
    monkeypatch.setattr(stats, "COUNTED_WORDS", most)
    df = spark.createDataFrame([(x,) for x in ODD * 3], "w array<string>").coalesce(2)
    want = Counter(" ".join(y for y in x[i : i + n] if y is not None) for x in ODD * 3 if x for i in range(len(x) - n + 1))
    got = stats.ngram_counts(df, "w", n).collect()
    assert len(got) == len(want) and {r["gram"]: r["n"] for r in got} == dict(want)


def test_nothing(spark):
    assert stats.ngram_counts(spark.createDataFrame([], "w array<string>"), "w").collect() == []


def test_many_words(spark):
    """Codes of five words of many thousand would not fit 64 bits."""
    rng = random.Random(1)
    x = [f"w{rng.randrange(20000)}" for _ in range(30000)]
    got = stats.ngram_counts(spark.createDataFrame([(x,)], "w array<string>"), "w", 5)
    assert {r["gram"]: r["n"] for r in got.collect()} == dict(Counter(" ".join(x[i : i + 5]) for i in range(len(x) - 4)))


def test_shuffled_bytes(spark, tmp_path):
    """Most n-grams occur once: what is shuffled is a fraction of their text."""
    rng = random.Random(2)
    texts = [(" ".join(f"word{rng.randrange(3000)}" for _ in range(1000)),) for _ in range(100)]
    spark.createDataFrame(texts, "text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.sparkContext.setJobGroup("grams", "grams")
    n = queries.trigram_counts(spark, str(tmp_path)).select(F.count("*")).first()[0]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("grams") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s) is not None}
    assert n > 99000 and sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages) < 13 * n
