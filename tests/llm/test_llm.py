"""The operators of the llm subpackage against plain versions, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat_format, common, exact_dedup, gru_lm, jaccard_join, mixing, nb_svm, quality_rules, token_store

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string"
WS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in WS.split(text or "") if w]


def made(n=60, seed=1):
    """Texts with copies, near copies, repeated lines and odd ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    base = out[0] + " " + out[1]
    out += [base, base.replace(" ", "\n", 3), base + " x", base + " y z", None, "", " \t\n", "one", "two words", "A a A a A a A a A a A a"]
    out += ["# $ % &\nsame line here\nsame line here\n\n" + out[2], out[3].upper(), "x" * 3000, "é" * 2000 + " " + "b " * 1500]
    return [(i, t, rng.choice(["s0", "s0", "s0", "s1", "s2", None])) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def data():
    return made()


@pytest.fixture(scope="module")
def docs(spark, data):
    # columns with names that clash with those of the operators
    return spark.createDataFrame(data, DOCS).withColumn("size", F.lit("a")).withColumn("key", F.lit(1)).withColumn("label", F.lit(2)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def plain_base(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, data, empty):
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = table(quality_rules.assess(docs, trusted, buckets=64).select("doc_id", "quality_rules.*"))
    assert len(got) == len(data)
    # the score from the counts, with buckets as the engine hashes them
    lists = {r["doc_id"]: r["b"] for r in docs.select("doc_id", quality_rules.ngram_buckets(F.col("text"), 64).alias("b")).collect()}
    raw, target = Counter(), Counter()
    for i, b in lists.items():
        raw.update(b)
        target.update(b if i < 20 else [])
    n, m = sum(raw.values()), sum(target.values())
    ratio = [math.log((target[k] + 1) / (m + 64)) - math.log((raw[k] + 1) / (n + 64)) for k in range(64)]
    for i, text, _ in data:
        r, base = got[i], plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base, i
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        score = sum(ratio[k] for k in lists[i]) / len(lists[i]) if lists[i] else 0.0
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score) and r["kept"] == (not failed and r["score"] >= quality_rules.THRESHOLD)
    tokens = len(re.findall(r"[^\W_]+|_|[^\w\s]+", (data[0][1] or "").lower()))
    assert len(lists[0]) == 2 * tokens - 1
    kept = quality_rules.keep(docs, trusted)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= set(got)
    assert quality_rules.assess(empty, trusted).count() == 0
    assert quality_rules.trusted_ids(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")).collect() == [(1,)]


def test_quality_rules_edges(spark):
    """A very long text, rows that repeat, columns that clash, and no trusted document."""
    long = "w " * 2_500_000
    rows = [(1, long), (1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, "x"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "score", "kept", "bucket")})
    out = quality_rules.assess(df, spark.createDataFrame([], "doc_id long")).collect()
    assert Counter((r["doc_id"], r["quality_rules"]["n_words"], r["quality_rules"]["base_failed"]) for r in out) == {(1, 2_500_000, True): 1, (1, 10, False): 2, (None, 1, True): 1, (2, 0, True): 1}
    assert quality_rules.keep(df, spark.createDataFrame([(1,)], "doc_id long")).columns == df.columns


def test_language_model_edges(spark):
    """Repeated rows count and are scored each; one very long text is scored whole."""
    long = " ".join(["alpha beta"] * 500_000)
    rows = [(1, "a b a"), (1, "a b a"), (3, long), (None, long), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "rare": F.lit(2)})
    got = [(r["doc_id"], r["n_tokens"], r["train_tokens"], r["score"]) for r in gru_lm.score(df).collect()]
    learnt = sum(len(words(t)) + 1 for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert Counter(g[:3] for g in got) == Counter((i, len(words(t)) + 1, learnt) for i, t in rows)
    assert len({g[3] for g in got if g[0] == 1}) == 1 and all(g[3] < 0 for g in got)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40])), rng.choice(["a", "a", "a", "a", "b", "é", "Z", None])) for i in range(600)] + [(900, None, "a"), (901, "", "void"), (None, "a b", "b"), (5, "x y", "a"), (5, "x y", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(9) for c in ("copies", "rank", "step", "whole", "extra")})
    for preference in (None, F.lit(1.0)):
        small = mixing.sized(df, preference)
        out = mixing.with_copies(small, *mixing.plan_copies(small, range_bits=4)).collect()
        assert len(out) == len(rows)
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len(words(t))
        want, taken = plain_targets(sizes), Counter()
        for r in out:
            assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["copies"] <= 2
            taken[r["source"]] += r["copies"] * r["size"]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 20, s
    mixed = mixing.mix(df, range_bits=4)
    assert mixed.columns == df.columns
    again = mixing.mix(df.repartition(5), range_bits=4)
    count = lambda x: Counter((r["doc_id"], r["text"]) for r in x.collect())
    assert count(mixed) == count(again)
    assert mixing.mix(empty).count() == 0


def test_mixing_equal_rows(spark):
    """Rows that cannot be told apart are taken as often as the target has room for, not all or none."""
    rows = [(None, "a b c d e f g h i j", "s")] * 400 + [(7, "a b c d e f g h i j", "t")] * 400 + [(8, "x y z", "u")] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    small = mixing.sized(df)
    plan = mixing.plan_copies(small, weights=(1, 1, 1), share=0.75)
    targets = {r["source"]: r["target"] for r in plan[0].collect()}
    assert targets == {"s": 2998.5, "t": 2998.5, "u": 12.0} or targets["u"] == 12.0
    out = Counter()
    for r in mixing.with_copies(small, *plan).collect():
        assert r["copies"] <= 2
        out[r["source"]] += r["copies"] * r["size"]
    assert all(abs(out[s] - targets[s]) <= 10 for s in targets), out
    long = [(1, "w " * 1_500_000, "a"), (2, "w " * 1_500_000, "a"), (3, "w", "b"), (4, None, None)]
    got = Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame(long, DOCS)).select("doc_id").collect())
    assert got[1] + got[2] == 3 and got[3] == 2 and 4 not in got


def test_pareto_inclusion(spark):
    """Over 200 samples a document is taken about as often as its inclusion probability says; each source here is one sample of the same 90 sizes."""
    key = spark.range(1).select(mixing._rank_key(F.lit(0.25), F.lit(0.5)).alias("k")).first()["k"]
    assert key == pytest.approx(3 / 4)
    many, sizes = 200, [16, 36, 64] * 30
    rows = [(1000 * k + i, f"s{k:03}", n, 0, round(4 * math.log2(math.sqrt(n)))) for k in range(many) for i, n in enumerate(sizes)]
    small = spark.createDataFrame(rows, "doc_id long, source string, size long, mark long, step int")
    plan = mixing.plan_copies(small, weights=(1,), share=0.4)
    rate = {r["step"]: r["rate"] for r in plan[1].filter("source = 's000'").collect()}
    # expected words are the target, and odds grow with the root of the size
    assert sum(n * rate[round(4 * math.log2(math.sqrt(n)))] for n in sizes) == pytest.approx(0.4 * sum(sizes))
    assert rate[12] == pytest.approx(2 * rate[8]) and max(rate.values()) < 1
    taken = Counter()
    for r in mixing.with_copies(small, *plan).select("size", "copies").collect():
        taken[r["size"]] += r["copies"]
    for n in set(sizes):
        p = rate[round(4 * math.log2(math.sqrt(n)))]
        assert taken[n] / (30 * many) == pytest.approx(p, abs=0.03), (n, p)


def test_certain_copies(spark):
    """Documents whose expected copies reach the most get just these, and the others more for it."""
    rows = [(i, "s", 100 if i < 10 else 4, 0, 13 if i < 10 else 4) for i in range(200)]
    small = spark.createDataFrame(rows, "doc_id long, source string, size long, mark long, step int")
    plan = mixing.plan_copies(small, weights=(1,), share=1.8)
    rate = {r["step"]: r["rate"] for r in plan[1].collect()}
    assert rate[13] == 2.0 and 10 * 100 * 2 + 190 * 4 * rate[4] == pytest.approx(1.8 * (1000 + 760))
    got = {r["doc_id"]: r["copies"] for r in mixing.with_copies(small, *plan).collect()}
    assert all(got[i] == 2 for i in range(10)) and abs(sum(got[i] * (100 if i < 10 else 4) for i in got) - 1.8 * 1760) <= 4


def test_mix_takes_preferred_documents_more_often(spark):
    rows = [(i, " ".join(["w"] * 10), "s", 1.6 if i % 2 else 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, f"{DOCS}, liked double")
    got = Counter(r["doc_id"] % 2 for r in mixing.mix(df, share=0.5, preference="liked").select("doc_id").collect())
    # 200 copies: 0.8 and 0.2 expected of each document
    assert sum(got.values()) == 200 and 140 <= got[1] <= 180


def tiktoken_encoder():
    return bpe.Codec.of(*bpe.default_vocabulary()).encoder


def test_bpe(spark, docs, data, empty):
    vocab = bpe.default_vocabulary()
    odd = ["it's 're 'll  we'll a\n\n  b    c" * 60, "x" * 500 + " \n" * 200 + "y", "'" * 300, " " * 400, "ab 12 " * 120 + "'r" + "e" * 40]
    more = [(500 + i, t) for i, t in enumerate(odd)] + [(None, odd[0]), (None, odd[1]), (1, odd[0])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = Counter()
    for i, t in [(i, t) for i, t, _ in data] + more:
        ids = tiktoken_encoder().encode_ordinary(t or "")
        want[i, tuple(ids)] += 1
    # chunks as small as they can be: overlaps with and without a common boundary
    for sizes in ({}, {"chunk_chars": 64, "overlap": 20}, {"chunk_chars": 200, "overlap": 40}):
        got = bpe.encode(df, "doc_id", "text", *vocab, **sizes)
        assert Counter((r["key"], tuple(r["ids"])) for r in got.collect()) == want, sizes
    back = bpe.decode(bpe.encode(docs, "doc_id", "text", *vocab), *vocab)
    texts = {i: (t or "").encode() for i, t, _ in data}
    assert {r["key"]: bytes(r["raw"]) for r in back.collect()} == texts
    d = table(bpe.digests(docs, *vocab))
    assert all(d[i]["decoded_sha256"] == hashlib.sha256(texts[i]).hexdigest() for i in texts)
    assert bpe.digests(empty, *vocab).count() == 0


def plain_components(data, size, num, den):
    sets = {}
    for i, t in data:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join(spark, empty, size, num):
    rng = random.Random(size)
    vocab = [f"v{i}" for i in range(400)]
    data = [(i, t) for i, t, _ in made(40)]
    for k in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 30, 60, 150]))]
        for j in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            data.append((1000 + 100 * k + j, " ".join(copy)))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    want = plain_components(data, size, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(df, size, num).collect()} == want
    stay = jaccard_join.dedup(df, size=size, num=num)
    assert stay.columns == df.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, (n, c) in want.items() if c == i or not n)


def test_jaccard_fragments(spark, monkeypatch):
    """Blocks cut into small fragments give the same components."""
    monkeypatch.setattr(jaccard_join, "FRAGMENT_LEAST", 4)
    monkeypatch.setattr(jaccard_join, "FRAGMENT_SHINGLES", 100)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    data = []
    for j in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = f"o{rng.randrange(5)}"
        data.append((j, " ".join(copy)))
    df = spark.createDataFrame(data + [(None, "a b c"), (7, data[7][1])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(df, 3, 90).collect()}
    assert got.pop(None) == (1, None)
    assert got == plain_components(data, 3, 90, 100)
    assert jaccard_join.similar(df.limit(0)).count() == 0


def test_signature_tree_prunes_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(90)]
    got = jaccard_join.tree_join(sets, np.arange(90), 60, 100)
    up = list(range(90))
    for i in range(90):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 60 * len(a | b):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert got.tolist() == up


def test_prefix_keys_meet():
    rng = np.random.default_rng(4)
    for num in (50, 80, 90):
        sets = []
        for n in (1, 3, 8, 20, 77, 300):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**44, n).astype(np.uint64))
                drop = rng.integers(0, max(1, n * (100 - num) // 150) + 1)
                sets += [a, np.unique(np.concatenate([a[drop:], rng.integers(0, 2**44, drop // 2).astype(np.uint64), rng.integers(0, 5, 1).astype(np.uint64)]))]
        sizes, holder, mark = np.array([len(s) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        _, back, times = np.unique(mark, return_inverse=True, return_counts=True)
        held = np.minimum(times[back], 255)
        some = held > 1
        owner, key = jaccard_join.prefix_keys(sizes, holder[some], mark[some], held[some], num, 100)
        keys = [set(key[owner == i].tolist()) for i in range(len(sets))]
        pairs = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * both >= num * either:
                    pairs += 1
                    assert keys[i] & keys[j]
        assert pairs > 10


def test_jaccard_edges(spark, empty):
    """A hot passage, a very long text, rows of one id, null ids, clashing names; small chunks and many of them."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(700_000))
    data = [(i, passage + " " + " ".join(f"d{i}x{k}" for k in range(i % 30))) for i in range(80)] + [(200, long), (201, long + " end"), (250, "a b c d e f"), (250, "u v w x y z"), (300, "u v w x y z"), (None, passage), (301, None), (302, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone", "keys", "rep", "block", "label", "__x")}).repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(df, 5, 80).collect())
    want = plain_components([(i, t) for i, t in data if i is not None and i != 250], 5, 80, 100)
    # what meets either text of document 250 meets document 250
    want |= {300: (2, 250)}
    assert want[201][1] == 200
    assert got == Counter([(i, n, c) for i, (n, c) in want.items()] + [(250, 2, 250), (250, 2, 250), (None, 36, None)])
    stay = jaccard_join.dedup(df)
    assert stay.columns == df.columns and jaccard_join.dedup(df.filter("false")).count() == 0
    assert sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] not in (None, 250)) == sorted(i for i, (n, c) in want.items() if c == i)


def test_nb_svm_features():
    """Indicators of byte n-grams, and of n-grams over the marks of words equal to the one before."""
    first = nb_svm.BUCKETS - nb_svm.MARKS
    marks = lambda t: [int(k) - first for k in nb_svm.features(t) if k >= first]
    # a a b b b: marks 1 0 1 1; n-grams 0 1 | 10 01 11 | 101 011 | 1011
    at = lambda gram: (1 << len(gram)) - 2 + int(gram, 2)
    assert marks("a a b b b") == sorted(map(at, ["0", "1", "10", "01", "11", "101", "011", "1011"]))
    assert marks("a") == [] and marks(None) == [] and len(nb_svm.features("")) == 0
    plain = nb_svm.features("abc")
    assert len(plain) == 3 + 2 + 1 and set(nb_svm.features("ab")) < set(plain)
    assert len(nb_svm.features("x y " * 1_500_000)) < 40


def test_nb_svm_counts_repeated_rows(spark):
    """Repeated rows are learnt from and scored each; a margin is the plain product of weights and a normalised row."""
    rows = [(1, "good text here"), (1, "good text here"), (2, "bad $$$ bad"), (3, "good words"), (5, None), (None, "bad $$$")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, q in ((1, 1), (2, 0), (3, 1), (4, 1), (6, 0), (7, 1)) if zlib.crc32(str(i).encode()) % 3 != 1] + [(8, 0), (9, 1)], "doc_id long, quality int")
    model = nb_svm.fit(df, labels)
    got = [(r["doc_id"], r["score"]) for r in nb_svm.score(df, model).collect()]
    assert len(got) == len(rows)
    counts = np.zeros((2, nb_svm.BUCKETS + 1))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for i, t in rows:
        if i in known:
            counts[known[i]][nb_svm.features(t)] += 1
            counts[known[i]][-1] += 1
    ratios = nb_svm.log_count_ratios(counts)
    assert np.allclose(ratios, model["ratios"])
    for (i, t), (_, s) in zip(sorted(rows, key=str), sorted(got, key=lambda x: (str(x[0])))):
        at, v = nb_svm.vector(nb_svm.features(dict(rows)[i]), ratios)
        margin = float(model["weights"][at] @ v)
        assert dict(got)[i] == pytest.approx(1 / (1 + math.exp(-(model["a"] * margin + model["b"]))))


def test_nb_svm(spark, empty):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
    bad = lambda: " ".join(rng.choice(["al***", "be$$$", "ga%%%"]) for _ in range(20))
    data = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(300)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = nb_svm.fit(df.select("doc_id", "text"), labels)
    got = table(nb_svm.score(df, model))
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 3 > 0) for i in test]) > 0.97
    held = {r["i"]: r["h"] for r in spark.range(300).select(F.col("id").alias("i"), nb_svm.held_out(F.col("id")).alias("h")).collect()}
    assert [i for i in range(300) if held[i]] == test
    assert nb_svm.score(empty, model).count() == 0
    one = nb_svm.fit(df.select("doc_id", "text"), labels.filter("quality = 1"))
    assert all(r["score"] > 0.5 for r in nb_svm.score(df, one).collect())
    none = nb_svm.fit(empty.select("doc_id", "text"), labels)
    assert none["b"] == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=60))
    rows = [(np.arange(5), v) for v in x]
    w = nb_svm.dual_coordinate_descent(rows, y, 5, np.full(60, 1.0), epochs=2000)
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(value(w) <= value(w + d) + 1e-3 for d in rng.normal(0, 0.05, (200, 5)))


def test_reply_trees(spark, empty):
    nodes = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"), (1, 4, 2, 9.0, "user", "c"), (1, 5, 3, 1.0, "user", "d"), (1, 6, 3, 1.0, None, None), (2, 1, 7, 0.0, "user", "lost parent"), (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle")] + [(4, i, i - 1 if i else None, None, "user", f"t{i}") for i in range(37)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double, role string, text string").withColumn("depth", F.lit(1))
    paths = chat_format.best_paths(tree, best=2)
    got = {}
    for r in paths.orderBy("depth").collect():
        got.setdefault((r["conv_id"], r["rank"]), []).append(r["node"])
    assert got == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (2, 1): [1], (4, 1): list(range(37))}
    done = {(r["conv_id"], r["rank"]): r for r in chat_format.format_paths(tree, paths).collect()}
    one = done[1, 1]
    assert one["formatted"] == "<|user|>q<|end|><|assistant|>a<|end|><|user|>c<|end|>"
    assert [one["formatted"][s["begin"] : s["end"]] for s in one["loss_spans"]] == ["a"]
    assert chat_format.best_paths(tree.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>", "\\1\\0<[", "|> <|user|>", "", None, "é\n x", "a" * 5000, "\\"]
    turns = [(1, i, ["user", "assistant", "sys|tem<|"][i % 3], t) for i, t in enumerate(hard)] + [(None, 0, None, "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    tree = common.materialize(chat_format.linear_tree(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), "t")
    done = chat_format.format_paths(tree, chat_format.best_paths(tree))
    got = {r["conv_id"]: r for r in done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["t"]] == [(r or "", t or "") for _, _, r, t in turns[:9]]
    assert got[1]["l"] == "".join(t or "" for _, _, r, t in turns[:9] if r == "assistant")
    assert got[2]["l"] == "samesame" and len(got[None]["t"]) == 1


def test_exact_dedup(spark, data, empty, monkeypatch):
    rows = [(i, t, s) for i, t, s in data] + [(7, "p q", "x"), (7, "pq", "y"), (8, "p  q", "z"), (None, "p   q", "n"), (None, "lone", None), (7, "p q", "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("first", F.lit(1)).withColumn("length", F.lit(2)).repartition(3)
    groups = {}
    for i, t, s in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((i, t or "", s))
    for window in (1 << 20, 1):
        monkeypatch.setattr(exact_dedup, "WINDOW_BYTES", window)
        out = exact_dedup.annotate(df).collect()
        assert len(out) == len(rows) and sum(r["__owner_kept"] for r in out) == len(groups)
        for r in out:
            g = groups[WS.sub("", r["text"] or "")]
            best = max(g, key=lambda x: (len(x[1]), x[0] is not None, -(x[0] or 0)))
            assert (r["__owner_keep_id"], r["__owner_group_size"]) == (best[0], len(g))
            assert r["__owner_sha"] == hashlib.sha256(WS.sub("", r["text"] or "").encode()).hexdigest()
        kept = exact_dedup.dedup(df)
        assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_edges(spark):
    """String ids, repeated ids and rows, a very long text, names that clash, and copies that only differ in white space."""
    long = "é b" * 1_700_000
    rows = [("b", "x y"), ("a", "xy "), (None, " xy"), ("c", "x  y"), ("c", "x  y"), ("c", " x y"), ("d", long), ("e", long + " "), ("f", None), ("f", ""), ("g", " ")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("sha", "doc", "count", "string", "part", "points", "length")}).repartition(4)
    out = exact_dedup.annotate(df)
    kept = sorted((r["doc_id"], r["text"]) for r in out.filter("__owner_kept").collect())
    assert kept == [("c", " x y"), ("e", long + " "), ("g", " ")]
    assert Counter((r["__owner_keep_id"], r["__owner_group_size"]) for r in out.select("__owner_keep_id", "__owner_group_size").collect()) == {("c", 6): 6, ("e", 2): 2, ("g", 3): 3}
    stay = exact_dedup.dedup(df)
    assert stay.columns == df.columns and stay.count() == 3


def test_patricia_trie():
    rng = random.Random(8)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    trie, nodes = exact_dedup.PatriciaTrie(), {}
    for k in keys:
        node = trie.put(k)
        assert nodes.setdefault(k, node) is node
        exact_dedup._merge(node, k.hex(), 0, None, 1, 1)
    assert len(set(map(id, nodes.values()))) == len(nodes)
    # one trie holds them all, with shared prefixes as inner nodes
    assert {k: v[4] for k, v in exact_dedup._terminals(trie.root)} == Counter(keys) and all(k.hex() == v[0] for k, v in exact_dedup._terminals(trie.root))
    assert len(trie.root.kids) <= 2


def test_subtrees_spill(monkeypatch):
    """A part whose trie is over its limit writes out complete subtrees, with the same owners."""
    import pyarrow as pa

    rng = random.Random(9)
    strings = sorted(bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([i // 700 for i in range(2000)], pa.int32()), pa.array(strings, pa.binary()), pa.array([s.hex() for s in strings]), pa.array([len(s) for s in strings], pa.int64()), pa.array([rng.randrange(50) for _ in strings], pa.int64()), pa.array([1] * 2000, pa.int64()), pa.array([1] * 2000, pa.int64())], names=["part", "string", "sha", "points", "doc", "ties", "count"])
    found, spills = [], []
    spilled = exact_dedup._spilled
    monkeypatch.setattr(exact_dedup, "_spilled", lambda trie, last: spills.append(list(spilled(trie, last))) or spills[-1])
    for limit in (64 << 20, 5000, 0):
        monkeypatch.setattr(exact_dedup, "SPILL_BYTES", limit)
        rows = [r for b in exact_dedup._owners(iter([batch])) for r in b.to_pylist()]
        found.append(sorted((r["sha"], r["doc"], r["ties"], r["count"]) for r in rows))
    assert found[0] == found[1] == found[2] and len(spills) > 2000 and max(map(len, spills)) > 5


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, data, empty, tmp_path, encoding):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    odd = ["", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's 're a's", "a. b.c ... d, e,, f", "\n\n a\n", "<|endoftext|>", "a <|endoftext|> b", "a\nb\nc d\n e", "\na b", "a\n\nb c", "'sa\rb\u00b2ab1 \u00a0 \u00a0", "a \u00a0b c", "a\x85 b", "a\u2003 b\nc\u2003\nd", "w " * 1_200_000]
    rng = random.Random(7)
    odd += ["".join(rng.choice(["a", "b", "1", " ", " ", "\n", "\r", "\t", "\u00a0", "\x85", "\x1c", "\u2003", "'s", ".", ",", "é", "\u00b2", "zz"]) for _ in range(rng.randrange(1, 16))) for _ in range(6000)]
    rows = [(i, t) for i, t, _ in data] + [(2000 + i, t) for i, t in enumerate(odd)] + [(None, "null id"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    out = str(tmp_path / "store")
    token_store.write_tokens(df, out, path, encoding=encoding, page_rows=4)
    store = token_store.read_tokens(spark, out)
    got = store.join(token_store.starts(store).drop("doc_id", "n_tokens"), ["shard", "pos"]).join(token_store.checksums(store), ["shard", "pos"]).orderBy("shard", "pos").collect()
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))]
    assert [(r["doc_id"], r["ids"]) for r in got] == want
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
    assert {r["doc_id"] for r in token_store.read_tokens(spark, out, 2000, 2003).collect()} == {2000, 2001, 2002, 2003}
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(max(glob.glob(out + "/*.parquet"))).metadata.row_group(0)
    assert meta.column(2).has_offset_index and meta.column(2).has_column_index
    token_store.write_tokens(empty, str(tmp_path / "none"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_language_model(spark, empty):
    rng = random.Random(10)
    kinds = (["the", "cat", "sat", "on", "mat"], ["le", "chat", "est", "sur", "lit"])
    data = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randrange(5, 60)))) for i in range(240)] + [(900, None), (901, ""), (902, "Zebra THE zebra"), (None, "the cat")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("c", F.lit(1)).repartition(2)
    tokens = {i: words((t or "").translate(LOWER)) + ["\n"] for i, t in data}
    counts = Counter(w for i, t in tokens.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    got = table(gru_lm.score(df))
    for i, t in tokens.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    few = table(gru_lm.score(df, shared_types=3))
    assert all(few[i]["base_score"] == pytest.approx(got[i]["base_score"]) and few[i]["n_known"] == got[i]["n_known"] for i in got)
    assert gru_lm.score(empty).count() == 0


def small_vocabulary():
    h = np.arange(1, 601, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = np.array([max(1, 3000 // (i + 1)) for i in range(600)], np.int64)
    top = CW = gru_lm.CLASSES * gru_lm.CLASS_WORDS
    bins = np.frexp(c[top:].astype(float))[1] - 1
    sums = np.zeros((2, gru_lm.BINS))
    np.add.at(sums[0], bins, c[top:])
    np.add.at(sums[1], bins, 1)
    return gru_lm.Vocabulary(h[:CW], c[:CW], sums, int(c.sum()), len(c)), h, c


def test_probabilities_sum_to_one():
    vocab, h, c = small_vocabulary()
    w = gru_lm.initial_weights(vocab)
    fed, cls, share = vocab.encode(np.append(h, np.uint64(12345)), np.append(c, 0))
    assert len(np.unique(fed[: gru_lm.CLASSES * gru_lm.CLASS_WORDS])) == gru_lm.CLASSES * gru_lm.CLASS_WORDS
    state = np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    logs = gru_lm.log_likelihood(w, np.repeat(state, len(fed), 0), fed, cls)[0] + share
    unused = np.exp(gru_lm._log_softmax(state @ w["co"] + w["cb"]))[0]
    assert np.exp(logs).sum() == pytest.approx(1 - unused[[k for k in range(len(unused)) if k not in set(cls)]].sum(), rel=1e-4)


def test_gradients_and_carried_state():
    vocab, h, c = small_vocabulary()
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in gru_lm.initial_weights(vocab).items()}
    ids = rng.integers(0, 600, (5, 3))
    fed, cls, share = vocab.encode(h[ids.ravel()], c[ids.ravel()])
    before, word, cls = np.roll(fed, 1).reshape(5, 3), fed, cls

    def value(w):
        states, _ = gru_lm.recur(w, before, np.zeros((3, gru_lm.HIDDEN)), False)
        return gru_lm.log_likelihood(w, states.reshape(15, -1).astype(np.float64), word, cls)[0].sum()

    grad = {k: np.zeros_like(v) for k, v in w.items()}
    states, tape = gru_lm.recur(w, before, np.zeros((3, gru_lm.HIDDEN)), True)
    back = gru_lm.log_likelihood(w, states.reshape(15, -1).astype(np.float64), word, cls, grad)[1]
    gru_lm.backward(w, grad, before, tape, back.reshape(5, 3, -1))
    for name in ("u", "co", "b", "x", "wo"):
        flat = np.abs(grad[name]).ravel()
        at = np.unravel_index(int(flat.argmax()), grad[name].shape)
        step = 1e-2
        up, down = ({**w, name: w[name].copy()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        assert (value(up) - value(down)) / (2 * step) == pytest.approx(grad[name][at], rel=0.02), name
    # a document scores the same in windows as by itself, among others, and in one piece
    lengths = np.array([70, 3, 31])
    ids = rng.integers(0, 600, int(lengths.sum()))
    fed, cls, share = vocab.encode(h[ids], c[ids])
    w32 = gru_lm.initial_weights(vocab)
    together = gru_lm.score_pool(w32, vocab, fed, cls, share, lengths)
    alone = gru_lm.score_pool(w32, vocab, fed[:70], cls[:70], share[:70], lengths[:1])
    states, _ = gru_lm.recur(w32, np.append(vocab.start, fed[:69])[:, None], np.zeros((1, gru_lm.HIDDEN), np.float32), False)
    once = gru_lm.log_likelihood(w32, states[:, 0], fed[:70], cls[:70])[0].sum() + share[:70].sum()
    assert together[0] == pytest.approx(alone[0]) and together[0] == pytest.approx(once, rel=1e-5)


def test_training_reads_every_document_at_any_size(spark):
    """The pass over the documents neither leaves any out nor repeats for the size of the corpus."""
    names = [f"w{i}" for i in range(8)]
    h = gru_lm.hashes(names)[0][::2]
    c = np.full(8, 100, np.int64)
    docs = spark.createDataFrame([(i, " ".join([w] * 40)) for i, w in enumerate(names)], "doc_id long, text string").coalesce(1)
    order, found = np.argsort(h), []
    for total in (800, 64_000_000):
        vocab = gru_lm.Vocabulary(h, c, np.zeros((2, gru_lm.BINS)), total, 8)
        w = gru_lm.initial_weights(vocab)
        found.append(gru_lm.train(docs, gru_lm.Shared(h[order], c[order], vocab, w)))
        assert (np.abs(found[-1]["x"][:8] - w["x"][:8]).max(axis=1) > 0).all(), total
    assert all(np.array_equal(found[0][k], found[1][k]) for k in found[0])


def test_learned_types_grow_with_the_corpus(spark):
    """All types counted often enough have weights of their own, not the first 512 only."""
    counts = spark.range(2000).select(F.xxhash64("id").alias("hash"), F.lit(2000).cast("long").alias("c"))
    vocab = gru_lm.vocabulary(counts)
    assert len(vocab.frequent) == 2000 and len(set(vocab.encode(vocab.frequent, np.full(2000, 2000))[0])) == 2000
    w = gru_lm.initial_weights(vocab)
    fed, cls, share = vocab.encode(vocab.frequent, np.full(2000, 2000))
    state = np.ones((2000, gru_lm.HIDDEN), np.float32)
    logs = gru_lm.log_likelihood(w, state, fed, cls)[0] + share
    assert np.exp(logs).sum() == pytest.approx(1, abs=0.02)


def test_nb_svm_labels_above_zero_are_one(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, " ".join(rng.choice(("good", "fine", "well") if i % 2 else ("bad", "spam", "junk")) for _ in range(12))) for i in range(40)], "doc_id long, text string")
    found = []
    for high in (1, 2):
        labels = spark.createDataFrame([(i, high if i % 2 else 0) for i in range(40)], "doc_id long, quality int")
        found.append({r["doc_id"]: r["score"] for r in nb_svm.score(df, nb_svm.fit(df, labels)).collect()})
    assert found[0] == found[1] and min(v for i, v in found[0].items() if i % 2) > 0.5 > max(v for i, v in found[0].items() if not i % 2)
