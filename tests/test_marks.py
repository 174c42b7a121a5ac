"""N-grams are sifted before they are shuffled, and blocks are scored by many tasks."""

from pyspark.sql import functions as F

from weftline.operators import matching, postings


def test_marks_keep_what_is_wanted_and_little_else(spark, monkeypatch):
    docs = spark.range(300).select("id", F.transform(F.sequence(F.col("id"), F.col("id") + 30), lambda x: x.cast("string")).alias("w"))
    asked = spark.range(50, 60).select(F.concat_ws(" ", "id", F.col("id") + 1, F.col("id") + 2).alias("gram"))
    grams = docs.select(F.explode(F.array_distinct(matching.ngrams(F.col("w"), 3))).alias("gram"), F.col("id").alias("doc"))
    kept = matching._marked(grams, asked)
    assert kept.join(asked, "gram").count() == grams.join(asked, "gram").count() == 290
    assert kept.count() < 300 < grams.count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = rows(matching.ngram_index(docs, "id", "w", asked=asked))
    monkeypatch.setattr(matching, "ASKED_GRAMS", 0)
    assert rows(matching.ngram_index(docs, "id", "w", asked=asked)) == few and len(few) == 290


def test_blocks_are_scored_by_as_many_tasks_as_a_shuffle_has(spark):
    blocks = spark.range(64).select((F.col("id") % 16).alias("block"), F.col("id").alias("doc"), F.array(F.col("id")).alias("grams"))
    pairs = spark.range(64).select(F.col("id").alias("kid"), (F.col("id") % 16).alias("block"))
    asked = spark.range(64).select(F.col("id").alias("kid"), F.col("id").alias("gid"), F.lit(2).cast("long").alias("times"))
    rare = spark.createDataFrame([], "kid long, block long, doc long, rare long")
    found = postings.scored(pairs, asked, blocks, rare, 1)
    assert sorted(map(tuple, found.collect())) == [(k, k, 2) for k in range(64)]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
