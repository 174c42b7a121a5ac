"""Words with their places as rows, and documents that are joined before they are taken apart."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import queries
from weftline.functions import text as tx

DATA = os.environ.get("WEFTLINE_TEST_DATA", "/root/testdata/sf0.001")


def test_words_are_placed_a_slice_at_a_time(spark, monkeypatch):
    rows = [(1, "Ab [x] c"), (2, None), (3, ""), (4, "é日 /a b/ z" * 30), (5, "... "), (6, "last")]
    df = spark.createDataFrame(rows, "id long, text string")
    expected = sorted(map(tuple, df.select("id", F.explode(tx.word_offsets(F.col("text"))).alias("o")).select("id", "o.word", "o.beg", "o.end").collect()))
    for most in (1, 40, 1 << 20):
        monkeypatch.setattr(tx, "PLACED_BYTES", most)
        assert sorted(map(tuple, tx.placed_words(df, ["id"], F.col("text")).collect())) == expected
    assert list(tx._slices(pa.array(["aa", None, "bbb", "c", "dddddd"]), 4)) == [(0, 2), (2, 2), (4, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_only_best_documents_are_taken_apart_for_pairs(spark, monkeypatch):
    seen, plain = [], queries._tokens
    monkeypatch.setattr(queries, "_tokens", lambda df, *c: (seen.append((df, c)), plain(df, *c))[1])
    _, _, texts = queries._pairs(spark, DATA)
    assert seen[-1][0].count() == texts.count() and "item_id" in seen[-1][0].columns
