"""Exact dedup where the table of repeated texts cannot be broadcast whole, and long texts through the tokenizer's own chunks."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, common, exact_dedup


def test_owners_join_without_a_hot_key(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " \n", "hot text", "hot  text "] + [f"text {k}" for k in range(30)] + [f"text\t{k} " for k in range(30)]
    data = [(rng.choice([k, k, 3, None]), rng.choice(texts[:5]) if k % 3 == 0 else rng.choice(texts)) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("count", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    columns = ["doc_id", "text", "count", "n", *(f"{exact_dedup.OWN}{x}" for x in ("_keep_id", "_group_size", "_kept", "_sha"))]
    want = sorted(map(str, exact_dedup.annotate(docs).select(*columns).collect()))
    plain = common.counted_join
    monkeypatch.setattr(exact_dedup, "counted_join", lambda df, found, on, n: plain(df, found, on, n, limit=2))
    assert sorted(map(str, exact_dedup.annotate(docs).select(*columns).collect())) == want
    assert exact_dedup.dedup(docs).count() == sum("_kept=True" in r for r in want)


def test_bpe_of_very_long_texts(spark):
    """Texts beyond the chunk size that is the default, as the library encodes them whole."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghé漢 ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(20_000)), "x" * 70_000, " \n" * 40_000, "ab 12 it's " * 9000, "é" * 40_000 + " end"]
    assert min(map(len, texts)) > 32_768
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    encoder = bpe.Codec.of(*bpe.default_vocabulary()).encoder
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs, *bpe.default_vocabulary()).collect()}
    assert got == {i: len(encoder.encode_ordinary(t)) for i, t in enumerate(texts)}
