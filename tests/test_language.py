"""Language models and decoding against plain versions and exhaustive search."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import decode, joins, language_model
from weftline.sources import readers, sinks
from weftline.sources.lookup import Lookup
from weftline.sources.scratch import settled

DATA = os.environ.get("WEFTLINE_TEST_DATA", "/root/testdata/sf0.001")


def made(seed=1, n=70):
    rng = random.Random(seed)
    return [[rng.choice("abcdefgh"[: rng.choice([2, 5, 8])]) for _ in range(rng.randrange(0, 12))] for _ in range(n)] + [[], ["a"] * 15]


def plain_logp(model, word, before):
    """log10 of p(word | before) by the rule of back-off, and the longest gram found."""
    gram = " ".join([*before, word])
    if gram in model:
        return model[gram][0]
    weight = model.get(" ".join(before), (0, None))[1] if before else None
    return (weight or 0.0) + plain_logp(model, word, before[1:])


@pytest.fixture(scope="module", params=[1, 2, 3, 4])
def estimated(request, spark):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w array<string>")
    model = language_model.estimate(df, "w", request.param)
    return request.param, texts, df, model, {r["gram"]: (r["logp"], r["backoff"]) for r in model.collect()}


def test_probabilities_of_each_context_add_up(estimated):
    order, texts, _, _, model = estimated
    words = [g for g in model if " " not in g and g != "<s>"]
    contexts = {tuple(g.split()[:-1]) for g in model} | {tuple(g.split()) for g in model if len(g.split()) < order} | {("never", "seen")}
    for c in contexts:
        if not c or c[-1] != "</s>":
            assert sum(10 ** plain_logp(model, w, list(c)) for w in words) == pytest.approx(1.0)
    assert model["<s>"][0] == -99 and all(len(g.split()) <= order for g in model)
    # what is said often after a context is likelier there
    if order > 1:
        assert plain_logp(model, "a", ["a"]) > plain_logp(model, "h", ["a"])


def test_sentence_scores(estimated):
    order, texts, df, model, table = estimated
    odd = df.withColumn("w", F.when(F.col("id") % 7 == 0, F.concat("w", F.array(F.lit("zz"), F.lit("a")))).otherwise(F.col("w")))
    odd = odd.unionByName(df.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("w", F.lit(None).cast("array<string>")))
    got = {r["id"]: r for r in language_model.sentence_scores(model, odd, ["id"], "w", order).collect()}
    assert got.keys() == {-1, *range(len(texts))}
    for i, w in [*enumerate(texts), (-1, [])]:
        w = [*w, "zz", "a"] if i % 7 == 0 else w
        s = ["<s>", *(x if x in table else "<unk>" for x in w), "</s>"]
        want = sum(plain_logp(table, s[k], s[max(0, k - order + 1) : k]) for k in range(1, len(s)))
        assert (got[i]["words"], got[i]["unknown"]) == (len(w), s.count("<unk>")) and got[i]["logp"] == pytest.approx(want)


def test_arpa_round_trip(estimated, spark, tmp_path):
    order, _, _, model, table = estimated
    sinks.write_arpa(model, str(tmp_path / "m.arpa"))
    got = {r["gram"]: (r["n"], r["logp"], r["backoff"]) for r in readers.arpa_model(spark, str(tmp_path / "m.arpa")).collect()}
    assert got == {g: (len(g.split()), *v) for g, v in table.items()}
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m.arpa"), wholetext=True).collect())
    assert text.startswith("\\data\\\nngram 1=") and text.rstrip().endswith("\\end\\") and f"\\{order}-grams:" in text


def test_model_of_nothing(spark):
    df = spark.createDataFrame([], "id long, w array<string>")
    got = {r["gram"]: r["logp"] for r in language_model.estimate(df, "w", 3).collect()}
    assert got == {"<s>": -99.0, "<unk>": 0.0}


def test_counted_join_with_hot_keys(spark):
    df = spark.createDataFrame([(k % 37 if k % 3 else 0, k) for k in range(900)] + [(None, -1)], "a long, b long").repartition(4)
    found = settled(df.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("m")).filter("a < 30 and n > 1"))
    want = sorted(map(str, joins.counted_join(df, found, "a").collect()))
    assert sorted(map(str, joins.counted_join(df, found, "a", limit=3).collect())) == want and len(want) == 901


def test_lookup(spark):
    rows = [(f"k{i} é", i, None if i % 5 else "x") for i in range(500)]
    found = Lookup.of(spark.createDataFrame(rows, "k string, a long, b string"), "k", ["a", "b"], rows=40)
    assert found.buckets == 13
    found.held = 3
    assert all(found.get(k) == (a, b) for k, a, b in rows) and found.get("none") is None and len(found.cache) <= 3
    assert Lookup.of(spark.createDataFrame([], "k string, a long"), "k", ["a"]).get("x") is None


def collapsed(path, pad):
    out, before = [], None
    for k in path:
        if k not in (before, pad):
            out.append(k)
        before = k
    return tuple(out)


def test_labels_equal_exhaustive_search():
    rng = np.random.default_rng(0)
    for _ in range(60):
        frames, labels = rng.integers(1, 6), rng.integers(2, 5)
        logs, total = decode.log_softmax(rng.normal(size=(frames, labels)) * 2), {}
        for path in itertools.product(range(labels), repeat=frames):
            c = collapsed(path, 0)
            total[c] = np.logaddexp(total.get(c, -np.inf), sum(logs[t, k] for t, k in enumerate(path)))
        got = decode.beam_search(logs, 0, 10**6)
        assert {x[0]: pytest.approx(x[1]) for x in got} == total
        assert [x[1] for x in got] == sorted((x[1] for x in got), reverse=True)
        assert decode.beam_search(logs, 0, 10**6)[0][0] == max(total, key=total.get)


ALPHABET = ["", "a", " ", "b"]
LEXICON = {"a": (True,), "ab": (True,), "b": (False,), "ba": (True,)}
MODEL = {"a": (-0.5, -0.3), "ab": (-1.0, -0.2), "ba": (-0.7, None), "<unk>": (-2.0, None), "</s>": (-0.6, None), "<s>": (-99, -0.4), "<s> a": (-0.3, -0.1), "a ab": (-0.2, None), "<s> a ab": (-0.05, None), "ab </s>": (-0.1, None), "<s> ba": (-1.5, -0.6)}


def plain_words(words, alpha, beta, unknown, lexicon, model, order=3):
    before, total = ["<s>"], 0.0
    for w in words:
        known = lexicon.get(w, (False,))[0]
        logp = plain_logp(model, w, before) if w in model or len(before) == 0 else plain_logp(model, "<unk>", []) + sum((model.get(" ".join(before[i:]), (0, None))[1] or 0.0) for i in range(len(before)))
        total += alpha * math.log(10) * (logp + (0 if known else unknown)) + beta
        before = [*before, w][-(order - 1) :]
    return total + alpha * math.log(10) * plain_logp(model, "</s>", before)


def test_words_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        logs, total = decode.log_softmax(rng.normal(size=(int(rng.integers(1, 8)), 4)) * 2), {}
        alpha, beta, unknown = rng.uniform(0, 1), rng.uniform(-1, 2), rng.uniform(-3, 0)
        for path in itertools.product(range(4), repeat=len(logs)):
            w = tuple("".join(ALPHABET[k] for k in collapsed(path, 0)).split())
            total[w] = np.logaddexp(total.get(w, -np.inf), sum(logs[t, k] for t, k in enumerate(path)))
        want = {w: v + plain_words(w, alpha, beta, unknown, LEXICON, MODEL) for w, v in total.items()}
        scorer = decode.WordScorer(ALPHABET, LEXICON.get, MODEL.get, 3, alpha, beta, unknown)
        got = decode.readings(logs, 0, 10**6, scorer)
        assert {tuple("".join(ALPHABET[k] for k in x[0]).split()): pytest.approx(x[1]) for x in got} == want
        # pruning far below the best doesn't change it
        assert decode.readings(logs, 0, 4000, scorer, -60, -60)[0][1] == pytest.approx(max(want.values()))


def plain_beam(logs, pad, width, scorer, prune, token):
    """The same search with a dictionary of prefixes, one step at a time: all growth is looked at, then the best are kept."""
    mark = scorer.delimiter
    beams, states, low = {(): (0.0, -np.inf)}, {(): scorer.start()}, -np.inf
    for frame in logs:
        grown = {}

        def add(prefix, label, value):
            cell = grown.setdefault(prefix, [low, low])
            cell[label] = np.logaddexp(cell[label], value)

        for prefix, (blank, last) in beams.items():
            add(prefix, 0, low)
            for k, x in enumerate(frame):
                if x < token and k != frame.argmax():
                    continue
                end = prefix[-1] if prefix else mark
                total = np.logaddexp(blank, last)
                if k == pad:
                    add(prefix, 0, total + x)
                elif k == mark == end:
                    add(prefix, 1, total + x)
                elif k == end:
                    add(prefix, 1, last + x)
                    add((*prefix, k), 1, blank + x)
                else:
                    add((*prefix, k), 1, total + x)
        for p in grown:
            if p not in states:
                states[p] = scorer.grow(states[p[:-1]], p[-1])
        rank = {p: np.logaddexp(*v) + states[p][2] + states[p][3] for p, v in grown.items()}
        best = max(rank.values())
        beams = {p: grown[p] for p in sorted((p for p in rank if rank[p] > low and rank[p] >= best + prune), key=lambda p: -rank[p])[:width]}
    out = {}
    for p, v in beams.items():
        key = p[:-1] if p and p[-1] == mark else p
        out[key] = np.logaddexp(out.get(key, low), np.logaddexp(*v))
        states.setdefault(key, states[p])
    return max(((v + scorer.finish(states[p]), p, v) for p, v in out.items()), key=lambda x: x[0])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_beam_words_query_equals_plain_search(spark):
    from weftline import chain_queries

    words = chain_queries._spelt(spark, DATA)
    lexicon = {}
    for r in words.collect():
        for w in r["w"]:
            for n in range(1, len(w) + 1):
                lexicon[w[:n]] = (lexicon.get(w[:n], (False,))[0] or n == len(w),)
    model = {r["gram"]: (r["logp"], r["backoff"]) for r in language_model.estimate(words, "w", 3).collect()}
    frames = {}
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        frames.setdefault(r["vec_id"] // 50, {})[r["vec_id"] % 50] = r["embedding"]
    got = {r["rec"]: r for r in chain_queries.beam_words(spark, DATA).collect()}
    assert got.keys() == frames.keys() and any(" " in r["text"] for r in got.values())
    for rec, rows in frames.items():
        logs = decode.log_softmax(np.array([rows[t] for t in sorted(rows)], np.float32).astype(np.float64)[:, : len(chain_queries.ALPHABET)] * 20)
        scorer = decode.WordScorer(chain_queries.ALPHABET, lexicon.get, model.get, 3)
        score, labels, acoustic = plain_beam(logs, 0, 32, scorer, -12.0, -6.0)
        assert got[rec]["text"] == " ".join("".join(chain_queries.ALPHABET[k] for k in labels).split())
        assert (got[rec]["acoustic_score"], got[rec]["lm_score"]) == (pytest.approx(acoustic, abs=1e-5), pytest.approx(score - acoustic, abs=1e-5))


def test_beam_cases(spark):
    rows = [("x", 0, [0.0, 9.0, 0.0, 0.0]), ("x", 1, None), ("x", 2, [9.0, 0.0, 0.0, 0.0]), ("x", 3, [0.0, 0.0, 9.0, 0.0]), (None, 0, [0.0, 0.0, 0.0, 9.0])]
    frames = spark.createDataFrame(rows, "rec string, t int, scores array<double>")
    words = spark.createDataFrame([("a",), ("a",), ("ab",), ("",), (None,)], "word string")
    model = language_model.estimate(spark.createDataFrame([(["a"],), (["ab", "a"],)], "w array<string>"), "w", 2)
    got = {r["rec"]: r for r in decode.decoded_words(frames, "rec", ALPHABET, words, model, 2).collect()}
    assert got["x"]["text"] == "a" and [tuple(w) for w in got["x"]["words"]] == [("a", 0, 1)] and got.keys() == {"x", None}
    assert decode.decoded_words(frames.limit(0), "rec", ALPHABET, words, model, 2).count() == 0
    assert decode.decoded_labels(frames, "rec").filter("rec = 'x'").first()["labels"] == [1, 2]


def test_scores_are_sums_of_gains(spark, monkeypatch):
    """Sums of what grams gain are the scores by kinds of grams: with a model that lacks shorter grams, with joins by shuffle and with marks."""
    texts = spark.createDataFrame([(i, [f"w{(i * j * j + j) % 13}" for j in range(i % 9)] + ["</s>"] * (i % 15 == 5) + ["<s>"] * (i % 21 == 7)) for i in range(60)], "id long, w array<string>")
    model = language_model.estimate(texts.filter("id % 3 = 0"), "w", 3)
    pruned = model.filter("n <> 2 or gram not like '%w1%'")
    found = lambda f, m: {r["id"]: (r["words"], r["unknown"], round(r["logp"], 8)) for r in f(m, texts, ["id"], "w", 3).collect()}
    for m in (model, pruned):
        expected = found(language_model._scores_by_kind, m)
        assert len(expected) == 60 and found(language_model.sentence_scores, m) == expected
    monkeypatch.setattr(language_model, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins.counted_join, "__defaults__", ("n", 2))
    assert found(language_model.sentence_scores, pruned) == expected
