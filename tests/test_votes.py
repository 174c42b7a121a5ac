"""Votes of segments: the first documents are those of a plain count, and what meets is not moved."""

import random
from collections import Counter

import numpy as np

from weftline.operators import matching, postings


def shuffled_rows(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_meetings_are_not_shuffled(spark):
    """900 documents and 300 segments that share an n-gram: 270,000 meetings, of which no row is made."""
    docs = spark.range(900).selectExpr("id AS doc", "array('a', 'b', 'c', concat('d', id)) AS w")
    said = spark.range(300).selectExpr("id % 7 AS rec", "id AS seg", "array('a', 'b', 'c', concat('d', 3 * id)) AS w")
    index = matching.ngram_index(docs, "doc", "w")
    before = shuffled_rows(spark)
    got = matching.segment_votes(said, "rec", "seg", "w", index).collect()
    assert sorted((r["rec"], r["doc"], r["votes"]) for r in got) == [(k % 7, 3 * k, 1) for k in sorted(range(300), key=lambda k: (k % 7, 3 * k))]
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 30_000


def test_null_documents_and_keys(spark):
    """Of equal documents one without an id comes last, as in SQL; segments without ids are segments, and rows of one segment are added up."""
    docs = spark.createDataFrame([(None, "a b c d".split()), ("y", "a b c x".split()), ("x", "b c d a b c".split()), (None, "p q r".split())], "doc string, w array<string>")
    said = spark.createDataFrame([(None, 1, "a b c".split()), (None, None, "p q r".split()), (1, None, "b c d".split()), (1, None, "c d e a b c".split()), (1, 2, None), (2, 1, "a b".split())], "rec long, seg long, w array<string>")
    got = matching.segment_votes(said, "rec", "seg", "w", matching.ngram_index(docs, "doc", "w")).collect()
    # segment (1, null) has abc and bcd in x and in a document without an id
    assert {tuple(r) for r in got} == {(None, "x", 1, 0.5), (None, None, 1, 0.5), (1, "x", 1, 1.0)}


def test_first_documents_of_a_part(monkeypatch):
    """Whatever counts as common and however few meetings are sorted at once."""
    rng = random.Random(7)
    held = {d: rng.sample(range(60), rng.randrange(1, 12)) + [60 + k for k in range(6) if rng.random() < 0.4] for d in range(5, 305, 3)}
    asked = {q * 10: {**{g: rng.choice([1, 1, 1, 2, 5]) for g in rng.sample(range(70), rng.randrange(1, 20))}, **{60 + k: 1 for k in range(6) if rng.random() < 0.3}} for q in range(200)}
    asked[77] = {99: 3}
    posts = tuple(np.array(x) for x in zip(*sorted((g, d) for d, gs in held.items() for g in set(gs)), strict=True))
    wanted = tuple(np.array(x) for x in zip(*sorted((q, g, t) for q, gs in asked.items() for g, t in gs.items()), strict=True))
    want = {}
    for q, gs in asked.items():
        hits = Counter({d: sum(t for g, t in gs.items() if g in have) for d, have in held.items()})
        if any(hits.values()):
            want[q] = min(((-h, d) for d, h in hits.items()))
    for meetings, common in ((1 << 21, 1 / 64), (1 << 21, 2), (1 << 21, 1 / 4), (40, 1 / 4), (300, 2), (1, 0)):
        monkeypatch.setattr(postings, "MEETINGS", meetings)
        monkeypatch.setattr(postings, "COMMON", common)
        got = [x for found in postings._firsts(posts, wanted) for x in zip(*(v.tolist() for v in found), strict=True)]
        assert len(got) == len(want) and {q: (-h, d) for q, d, h in got} == want, (meetings, common)
    assert list(postings._firsts((np.empty(0, np.int64),) * 2, wanted)) == []
