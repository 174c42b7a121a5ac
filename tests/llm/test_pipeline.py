"""The pipeline's stages against plain versions, and the contract of its list."""

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen = [docs]
    from weftline.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(materialize(stage(spark, seen[-1], DATA), name))
        assert seen[-1].columns == columns, name
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    start, quality, exact, near, mixed = ({r["doc_id"]: r["text"] for r in df.collect()} for df in seen)
    assert quality.items() <= start.items() and len(quality) > 0.7 * len(start)
    assert {norm(t) for t in exact.values()} == {norm(t) for t in quality.values()} and len({norm(t) for t in exact.values()}) == len(exact)

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(t) for i, t in exact.items()}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ids = sorted(near)
    assert not any(alike(i, j) for k, i in enumerate(ids) for j in ids[:k])
    assert all(any(alike(i, j) for j in exact if j != i) for i in set(exact) - set(near))
    assert set(mixed) <= set(near)
    out = corpus_pipeline.run(spark, DATA).collect()
    assert len(out) == seen[-1].count() and {r["doc_id"] for r in out} == set(mixed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash, and no rows at all, through every stage."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(400_000))
    good = [" ".join(f"{w}{k}" for w in "the quick brown fox jumps over a lazy dog and runs away again".split()) for k in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)] + [(100, long, None, None, None), (101, long + " end", "en", "s1", 1), (None, good[0], None, "s0", 3), (3, good[3], "en", "s0", len(good[3])), (3, good[3], "en", "s0", len(good[3])), (200, None, "en", "s0", None), (201, "", None, None, 0), (202, "  \n", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("gone", "size", "row", "key", "keys", "kept", "sha", "copies", "mark")})
    spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 1, 0), (2, None, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        none = stage(spark, df.filter("false"), str(tmp_path))
        if name == "byte_bpe":
            assert out.count() == len(rows) and none.count() == 0
            continue
        assert out.columns == df.columns and none.count() == 0, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "quality_rules":
            assert not {200, 201, 202} & set(ids)
        if name == "exact_dedup":
            # white space alone is the empty text; of its three rows the one with most code points stays
            assert sorted(ids, key=lambda x: -1 if x is None else x) == [*range(12), 100, 101, 202]
        if name == "jaccard_join":
            assert 101 not in ids and 100 in ids and ids.count(3) == 3 and {200, 201, 202, None} <= set(ids)
        if name == "source_mix":
            assert not {200, 201, 202} & set(ids) and max(map(ids.count, set(ids) - {3})) <= 2 and ids.count(3) <= 6
