"""What alignments of many recordings leave on disk: frames are not moved, and shuffle files go with the step that wrote them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.plans import pipeline
from weftline.sources import lookup
from weftline.sources.scratch import CLEANED, settled

from test_votes import shuffled_rows


def test_many_vectors_are_looked_up(spark, monkeypatch):
    """More vectors than are broadcast: the same words, and no frame is shuffled."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=32)] if i != 11 else None) for i in range(9000) if i != 7], "v long, scores array<float>")
    words = ["abc", "de", "fgh", "ij"]
    rows = [(r, k, 10 * r, " ".join(words), [(i * 1.5, i * 1.5 + 1.2) for i in range(20)]) for r in range(120) for k in (0, 1)]
    matches = spark.createDataFrame(rows, "rec long, reco_beg long, norm_beg long, ref_text string, audio_offsets array<struct<start:double,end:double>>")
    lengths = spark.createDataFrame([(r, 400) for r in range(120)], "rec long, frames int")
    numbered = pipeline.NumberedFrames(lengths, lambda rec, t: F.when(t != 5, (t * 1300 + rec) % 9000), vectors)
    vocabulary = {c: k + 5 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    found = lambda: sorted(map(tuple, pipeline.aligned_words(matches, numbered, vocabulary, frames_s=8.0).collect()))
    expected = found()
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lookup, "BUCKET_CELLS", 32 * 4096)
    before = shuffled_rows(spark)
    assert found() == expected and len(expected) > 240
    # 240 segments of 236 frames or more
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 240 * 100


def test_numbered_arrays(spark, monkeypatch):
    """Any numbers, in few or many files, of which a worker holds two."""
    held = {n: [n + 0.5, -1.0 * n] for n in [*range(0, 30_000, 7), 1 << 40, -3, -5000]}
    table = spark.createDataFrame([*held.items(), (None, [1.0, 1.0]), (1, None)], "n long, x array<double>")
    asked = np.array([3, 7, 7, 29_995, 29_996, 1 << 40, 1 << 41, -3, -2, -5000, 0, 1])
    for cells in (1 << 21, 1000):
        monkeypatch.setattr(lookup, "BUCKET_CELLS", cells)
        arrays = lookup.NumberedArrays.of(table, "n", "x")
        arrays.held = 2
        has, rows = arrays.get(asked)
        assert has.tolist() == [int(n) in held for n in asked] and rows[has].tolist() == [held[int(n)] for n in asked[has]]
        assert arrays.buckets == (1 if cells > 1000 else 9) and len(arrays.cache) <= 2
        assert not arrays.get(np.array([2]))[0].any()
        arrays.discard(spark)
    mixed = lookup.NumberedArrays.of(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "n long, x array<double>"), "n", "x")
    with pytest.raises(ValueError, match="different sizes"):
        mixed.get(np.array([1, 2]))
    empty = lookup.NumberedArrays.of(table.limit(0), "n", "x")
    assert not empty.get(asked)[0].any()


def test_shuffle_files_go_with_their_step(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before = files()
    out = settled(spark.range(20_000).groupBy((F.col("id") % 1000).alias("g")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and out.count() == 1000 and out.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(CLEANED, None) is None
