"""Operators on small rows worked out by hand or by plain versions of the rules."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import decode, edit, intervals, matching, resegment, sequence, stats, viterbi


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_normalised_text_keeps_places(spark):
    df = spark.createDataFrame([("Ala [śmiech] ma /x/ kota, 2!",), ("[a]",), ("",)], "text string")
    got = df.select(tx.spaced("text").alias("s"), tx.normalized(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == ["ala ma kota 2", "", ""]
    s = got[0]["s"]
    found = [(s.index(w), s.index(w) + len(w)) for w in ("ala", "ma", "kota", "2")]
    assert found == [(0, 3), (13, 15), (20, 24), (26, 27)]


def test_text_functions(spark):
    df = spark.createDataFrame([("ab cde f",)], "t string")
    at = [df.select(tx.word_at(F.col("t"), F.lit(i)).alias("x")).first()["x"] for i in range(10)]
    assert at == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    one = df.select(tx.ngrams(F.array(*map(F.lit, "abcd")), 3).alias("a"), tx.ngrams(F.array(*map(F.lit, "abcd")), 3, True).alias("b"), tx.ngrams(F.array(F.lit("a")), 3).alias("c"), tx.bare_words(F.lit("A-b ! c")).alias("d"), tx.video_id(F.lit("x-abcdefghijk-ABCDEFGHIJKL")).alias("v"), tx.segment_id(F.lit("r"), F.lit(7)).alias("i"), tx.percent(F.lit(0.125)).alias("p"), tx.labels_of(F.lit("a b"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), 4).alias("l")).first()
    assert one["a"] == ["a b c", "b c d"] and one["b"] == ["a b c"] and one["c"] == [] and one["d"] == ["ab", "", "c"]
    assert one["v"] == "jk-ABCDEFGH"[:11] or len(one["v"]) == 11
    assert one["i"] == "r_seg_0007" and one["p"] == "12.50%" and one["l"] == [4, 1, 4, 2, 4]
    db = df.select(tx.decibels(F.array(F.lit(0.0))).alias("z"), tx.decibels(F.array(F.lit(1.0), F.lit(-1.0))).alias("o")).first()
    assert db["z"] == float("-inf") and db["o"] == 0


def test_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 3.0, 4.0), (1, 6.5, 7.0)], "rec int, s double, e double")
    assert [r[3] for r in rows(sequence.gap_groups(df, "rec", "s", "e", 2.0), "s")] == [0, 0, 1]


def test_greedy_keep(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 4), (2, 1, 1)], "rec int, s int, e int")
    assert rows(sequence.greedy_keep(df, "rec", "s", "e"), "rec", "s") == [(1, 0, 2), (1, 2, 4), (2, 1, 1)]
    assert rows(sequence.greedy_keep(df, "rec", "s", "e", touching=False), "rec", "s") == [(1, 0, 2), (2, 1, 1)]


def chunks_plain(words, gap, least, most):
    out, cur, last = [], [], words[0][1]
    for p, s, e in words:
        if cur and (s - last > gap or len(cur) >= most):
            out.append(cur)
            cur, last = [p], s
        else:
            cur, last = cur + [p], e
    return [(c[0], c[-1] + 1) for c in [*out, cur] if len(c) >= least]


def test_gap_chunks_against_plain_version(spark):
    rng, data, want = random.Random(3), [], []
    for rec in range(5):
        t, words = 0.0, []
        for p in range(60):
            t += rng.choice([0.1, 0.4, 2.0])
            words.append((p, t, t + 0.3))
        data += [(rec, *w) for w in words]
        want += [(rec, *c) for c in chunks_plain(words, 1.2, 2, 7)]
    df = spark.createDataFrame(data, "rec int, pos int, s double, e double")
    assert rows(sequence.gap_chunks(df, "rec", "pos", "s", "e", 1.2, 2, 7), "rec", "beg") == sorted(want)


def test_interval_union_and_time(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0), (1, 1.2, 2.0), (1, 5.0, 6.0)], "rec int, s double, e double")
    u = sequence.interval_union(df, "rec", "s", "e", 0.25)
    assert [(r["start"], r["end"], r["before"]) for r in u.orderBy("island").collect()] == [(0.0, 2.25, 0.0), (4.75, 6.25, 2.25)]
    times = spark.createDataFrame([(1, 0.0), (1, 2.25), (1, 2.5)], "rec int, at double")
    assert [r["restored"] for r in sequence.restore_time(times, u, "rec", "at").orderBy("at").collect()] == [0.0, 2.25, 5.0]


def test_split_long(spark):
    df = spark.createDataFrame([(1, float(i), i + 1.0) for i in range(10)], "rec int, s double, e double")
    parts = [r["part"] for r in sequence.split_long(df, ["rec"], "s", "e", 4.0, ["s"]).orderBy("s").collect()]
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_intervals_against_plain_version(spark):
    rng = random.Random(5)
    spans = [(1, i, s := rng.randrange(0, 900), s + rng.randrange(0, 200)) for i in range(12)]
    points = [(1, i, s := rng.randrange(0, 1000), s + rng.randrange(0, 60)) for i in range(60)]
    sp = spark.createDataFrame(spans, "rec int, span int, b long, f long")
    pt = spark.createDataFrame(points, "rec int, pos int, s long, e long")
    for at, test in ((F.col("s"), lambda p, q: q[2] <= p[2] <= q[3]), ([F.col("s"), F.col("e")], lambda p, q: q[2] <= p[2] <= q[3] or q[2] <= p[3] <= q[3])):
        want = sorted((p[1], q[1]) for p in points for q in spans if test(p, q))
        assert rows(intervals.points_in_intervals(pt, sp, "rec", at, "b", "f", 50.0).select("pos", "span"), "pos", "span") == want
        first = {p: next(s for s in sorted(spans, key=lambda q: (q[2], q[1])) if test(points[p], s))[1] for p, _ in want}
        assert dict(rows(intervals.first_interval(pt, sp, "rec", at, "b", "f", 50.0, ["pos"], ["b", "span"]).select("pos", "span"))) == first
        assert {r["pos"] for r in intervals.outside_intervals(pt, sp, "rec", at, "b", "f", 50.0, ["pos"]).collect()} == {p[1] for p in points} - set(first)
    edge = spark.createDataFrame([(1, 9, 50, 50)], "rec int, pos int, s long, e long")
    two = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 50, 90)], "rec int, span int, b long, f long")
    assert rows(intervals.points_in_intervals(edge, two, "rec", F.col("s"), "b", "f", 10.0).select("span"), "span") == [(1,), (2,)]
    assert rows(intervals.points_in_intervals(edge, two, "rec", F.col("s"), "b", "f", 10.0, closed=False).select("span")) == [(2,)]


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_scripts():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 8))] for _ in range(2))
        ops = edit.script(a, b)
        assert sum(o != "equal" for o, _, _ in ops) == plain_distance(a, b)
        made, i = [], 0
        for op, x, y in ops:
            made += [b[y]] if op in ("insert", "replace") else [a[x]] if op == "equal" else []
        assert made == b
    assert edit.errors([], ["a", "b"]) == (0, 2, 0, 1, 1, 2.0)
    assert edit.trim(list("xabcy"), list("abcz")) == (1, 4, 0, 3)
    assert edit.trim(["a"], ["b"]) is None


def test_long_scripts_in_blocks(monkeypatch):
    """The trace through rows that are worked out again is that of the whole table."""
    rng = random.Random(17)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(0, 60))] for _ in range(2)) for _ in range(60)]
    pairs = [(list(a), list(b)) for a, b in pairs]
    monkeypatch.setattr(edit, "KEPT_ROWS", 1 << 20)
    whole = [edit.script(a, b) for a, b in pairs]
    for k in (1, 2, 7, 59):
        monkeypatch.setattr(edit, "KEPT_ROWS", k)
        assert [edit.script(a, b) for a, b in pairs] == whole


def plain_char_trim(a, b, least=3):
    """From the script of the joined words: the words that hold the first and last character of runs of equal ones."""
    x, y = " ".join(a), " ".join(b)
    kept = [(i, j) for op, i, j in edit.script(list(x), list(y)) if op == "equal"]
    runs = [[kept[0]]] if kept else []
    for p, q in zip(kept, kept[1:]):
        if q == (p[0] + 1, p[1] + 1):
            runs[-1].append(q)
        else:
            runs.append([q])
    runs = [r for r in runs if len(r) >= least]
    if not runs:
        return None
    word = lambda text, at: text[: at + (text[at] != " ")].count(" ") + (text[at] == " ")
    (i, j), (k, m) = runs[0][0], runs[-1][-1]
    return word(x, i), word(x, k) + 1, word(y, j), word(y, m) + 1


def test_char_trim(spark):
    assert edit.char_trim(["hello", "big", "world"], ["hallo", "big", "world"]) == (0, 3, 0, 3)
    assert edit.char_trim(["qq", "abcd", "zz"], ["x", "abcd"]) == (1, 2, 1, 2) and edit.char_trim(["ab"], ["cd"]) is None
    rng = random.Random(19)
    rows_ = [([("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))) for _ in range(rng.randrange(1, 7))] for _ in range(2)) for _ in range(120)]
    rows_ = [(i, list(a), list(b)) for i, (a, b) in enumerate(rows_)] + [(500, [], ["a"]), (501, None, ["abc"])]
    df = spark.createDataFrame(rows_, "i int, a array<string>, b array<string>")
    got = {r["i"]: r["trim"] and tuple(r["trim"]) for r in edit.with_char_trim(df, "a", "b").collect()}
    for i, a, b in rows_:
        want = plain_char_trim(a or [], b or [])
        # a run that begins or ends with the space between two words belongs to the word after it
        assert (got[i] is None) == (want is None)
        if want and " ".join(a)[0:1] and not any(" " == c for c in (" ".join(a) + " ".join(b))):
            assert got[i] == want


def test_errors_in_frames(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["a"], None)], "n array<string>, s array<string>")
    got = [r["errors"] for r in edit.with_errors(df, "n", "s").collect()]
    assert (got[0]["insert"], got[0]["replace"], got[0]["wer"]) == (1, 1, 0.667)
    assert got[1]["num"] == 1 and got[2]["delete"] == 1
    trims = [r["trim"] for r in edit.with_trim(df, "n", "s").collect()]
    assert tuple(trims[0]) == (0, 3, 0, 3) and trims[1] is None


def plain_path(scores, labels, pad):
    T, N, low = len(scores), len(labels), float("-inf")
    delta, back = [[low] * N for _ in range(T)], [[0] * N for _ in range(T)]
    delta[0][0] = scores[0][pad]
    for t in range(1, T):
        for n in range(max(0, t - T + N), min(t + 1, N)):
            come, stay = delta[t - 1][n - 1] if n else low, delta[t - 1][n]
            delta[t][n], back[t][n] = (come + scores[t][labels[n]], n - 1) if come > stay else (stay + scores[t][pad], n)
    path = [N - 1]
    for t in range(T - 1, 0, -1):
        path.append(back[t][path[-1]])
    return path[::-1]


def test_viterbi_follows_its_rule():
    rng = np.random.default_rng(1)
    for T, N in ((4, 4), (6, 3), (7, 4), (5, 1), (30, 9)):
        scores, labels = rng.normal(size=(T, 5)), rng.integers(0, 5, N)
        path = viterbi.best_path(scores, labels)
        assert path[0] == 0 and path[-1] == N - 1 and set(np.diff(path)) <= {0, 1}
        assert path.tolist() == plain_path(scores, labels, 0)
    assert set(viterbi.best_path(rng.normal(size=(2, 5)), np.array([4, 1, 4]))) == {-1}
    assert viterbi.word_spans(np.array([0, 1, 1, 2, 3, 4]), np.array([4, 1, 4, 2, 4]), 4) == [(1, 3), (4, 5)]


def test_best_window_against_plain_version(spark):
    rng = random.Random(11)
    corpus = [rng.choice("abcdefgh") for _ in range(40)]
    chunk = corpus[13:19]
    chunk[2] = "z"
    chunks = spark.createDataFrame([(1, 0, chunk)], "rec int, chunk int, words array<string>")
    texts = spark.createDataFrame([(1, corpus)], "rec int, words array<string>")
    places = texts.select("rec", F.posexplode("words").alias("pos", "word"))
    counts = [sum(w in chunk for w in corpus[i : i + 6]) for i in range(35)]
    got = rows(matching.candidates(chunks, places).select("beg", "count"), "beg")
    assert got == [(i, c) for i, c in enumerate(counts) if c >= 0.9 * max(counts)]
    best = min((plain_distance(" ".join(corpus[i : i + 6]), " ".join(chunk)), i) for i, c in enumerate(counts) if c >= 0.9 * max(counts))
    one = matching.best_windows(chunks, places, texts).first()
    assert (one["distance"], one["beg"]) == best
    short = spark.createDataFrame([(1, 0, ["a"] * 60)], "rec int, chunk int, words array<string>")
    assert matching.best_windows(short, places, texts).first()["end"] == 40


def test_multi_pass_finds_the_text(spark):
    from weftline.plans import pipeline

    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(300)]
    norm = [rng.choice(vocab) for _ in range(400)]
    said = norm[50:150] + norm[200:330]
    said = [w if i % 23 else "zzzzz" for i, w in enumerate(said)]
    reco = spark.createDataFrame([(1, i, w, i * 0.5 + (20 if i >= 100 else 0), i * 0.5 + 0.4 + (20 if i >= 100 else 0)) for i, w in enumerate(said)], "rec int, pos int, word string, start double, end double")
    ref = spark.createDataFrame([(1, i, w) for i, w in enumerate(norm)], "rec int, pos int, word string")
    found = pipeline.multi_pass(reco, ref).orderBy("reco_beg").collect()
    assert [(r["reco_beg"], r["norm_beg"]) for r in found][0] in ((1, 51), (0, 50))
    assert all(r["norm_beg"] - r["reco_beg"] in (50, 100) for r in found) and all(r["cer"] < 0.2 for r in found)
    single = pipeline.match_single(reco, ref, 50, 50).collect()
    assert {(r["chunk"], r["beg"]) for r in single if r["chunk"] in (0, 1)} == {(0, 50), (1, 100)}


def test_lines_and_statistics(spark):
    lines = spark.createDataFrame([(1, 0, "a", "Ab, cd", ["ab", "cd"], [(0, 2), (4, 6)]), (1, 1, "b", "ef", ["ef"], [(0, 2)]), (1, 2, "c", "gh", ["gh"], [(0, 2)])], "rec int, line int, id string, text string, words array<string>, normoff array<struct<s:int,e:int>>")
    ali = spark.createDataFrame([(1, 0, "ab", 0.0, 1.0), (1, 1, "cd", 1.0, 2.0), (1, 2, "ef", 2.0, 3.0)], "rec int, norm_pos int, word string, start double, end double")
    reco = spark.createDataFrame([(1, 0, "ab", 0.0, 1.0), (1, 1, "cx", 1.0, 2.0), (1, 2, "q", 1.5, 2.5), (1, 3, "zz", 8.0, 9.0), (1, 4, "yy", 12.0, 13.0)], "rec int, pos int, word string, start double, end double")
    out = {r["id"] or r["reco"]: r for r in resegment.by_lines(ali, reco, lines).collect()}
    # the word whose middle is on the border of two lines goes to both
    assert out["a"]["reco"] == "ab cx q" and out["b"]["reco"] == "q" and out["c"]["match_error"] == "only in reference" and out["c"]["start"] is None
    assert out["a"]["errors"]["replace"] == 1 and out["a"]["words"][1]["char_s"] == 4
    assert out["zz"]["match_error"] == "only in reco" and out["yy"]["start"] == 12.0
    first = {r["id"]: r for r in resegment.by_lines(ali, reco, lines, all_matches=False).collect() if r["id"]}
    assert first["a"]["reco"] == "ab cx q" and first["b"]["reco"] is None
    strict = resegment.by_lines(ali, reco, lines, worst_cer=0.9)
    kinds = {r["id"]: r for r in strict.collect() if r["id"]}
    assert kinds["b"]["match_error"] == "only in reference" and kinds["b"]["start"] == 2.0
    s = stats.file_statistics(strict, "rec").first()
    assert (s["ref_only_seg"], s["ok_match_seg"], s["ok_match_words"], s["reco_only_words"]) == (2, 1, 2, 3) and s["overall_wer"] == 50.0
    silent = resegment.by_silence(ali.withColumnRenamed("norm_pos", "pos"), reco, gap=2.0).orderBy("start").collect()
    assert [r["unaligned"] for r in silent] == [False, True, True] and silent[0]["reco"] == "ab cx q"


def test_restored_times(spark):
    """Against a scan of all islands; times on borders, before and beyond them; several keys; names that clash."""
    rng = random.Random(23)
    spans = [(k, s, s + rng.randrange(1, 9)) for k in range(3) for s in range(rng.randrange(3), 100, 12)]
    islands = sequence.interval_union(spark.createDataFrame(spans, "rec int, s long, e long"), "rec", "s", "e", 0)
    known = {}
    for r in islands.orderBy("island").collect():
        known.setdefault(r["rec"], []).append((r["before"], r["start"], r["end"]))
    times = spark.createDataFrame([(k, t, "x") for k in range(4) for t in range(0, 70)], "rec int, at long, start string")
    got = {(r["rec"], r["at"]): r["restored"] for r in sequence.restore_time(times, islands, "rec", "at").collect()}
    want = {}
    for k, found in known.items():
        for t in range(70):
            hit = [s + t - b for b, s, e in found if t <= b + e - s and (t > b or (b == 0 and t == 0))]
            if hit:
                want[k, t] = hit[0]
    assert got == want


def test_prefix_sums(spark):
    df = spark.createDataFrame([(list(range(300)),), ([],), ([5],), (list(range(128)),)], "x array<bigint>")
    for r in df.select("x", tx.prefix_sums(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]
    t = spark.createDataFrame([("\u00a0\t Ala [x] ma\u2003",)], "t string")
    assert [tuple(x) for x in t.select(tx.word_offsets(F.col("t")).alias("o")).first()["o"]] == [("ala", 0, 3), ("ma", 8, 10)]


def test_single_recording(spark):
    """From recognised words and frames to aligned words: chunks, windows, trimming, alignment, original times."""
    from weftline.plans import pipeline

    vocab = {c: i + 5 for i, c in enumerate("abcdefghij")}
    rng = random.Random(29)
    norm = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(60)]
    said = ["jjj", *norm[20:32], "iii"]
    reco = spark.createDataFrame([(1, i, w, 1.0 + i, 1.5 + i) for i, w in enumerate(said)], "rec int, pos int, word string, start double, end double")
    ref = spark.createDataFrame([(1, i, w) for i, w in enumerate(norm)], "rec int, pos int, word string")
    matches = pipeline.single_matches(reco, ref, 20, 20).collect()
    assert [(r["reco_beg"], r["reco_end"], r["norm_beg"], r["norm_end"], r["cer"]) for r in matches] == [(1, 13, 20, 32, 0.0)]
    scores = [(1, t, [float(rng.random()) for _ in range(15)]) for t in range(900)]
    frames = spark.createDataFrame(scores, "rec int, t int, scores array<double>")
    ali = pipeline.single_recording(reco, ref, frames, vocab, 20, 20).orderBy("start").collect()
    assert ali and {r["norm_pos"] for r in ali} <= set(range(20, 32)) and [r["norm_pos"] for r in ali] == sorted(r["norm_pos"] for r in ali)
    assert all(norm[r["norm_pos"]] == r["word"] for r in ali) and all(a["end"] <= b["start"] for a, b in zip(ali, ali[1:]))
    assert ali[0]["start"] >= 1.0 + 1 - 0.25 - 0.02 and ali[-1]["end"] <= 1.5 + 12 + 0.25 + 0.02


def test_order_and_scores(spark):
    segs = spark.createDataFrame([(1, "b", 2.0), (1, "none", None), (1, "a", 1.0), (2, "x", 0.0), (2, "none", None)], "rec int, id string, start double")
    assert rows(sequence.final_order(segs, "rec", "start", ["id"]).select("rec", "place", "id"), "rec", "place") == [(1, 0, "none"), (1, 1, "a"), (1, 2, "b"), (2, 0, "none"), (2, 1, "x")]
    docs = spark.createDataFrame([("d1", list("abcd")), ("d2", list("xbcde")), ("d3", ["q"])], "doc string, w array<string>")
    reco = spark.createDataFrame([(1, list("abcde")), (2, list("zzz")), (3, ["a"])], "rec int, w array<string>")
    got = {r["rec"]: (r["scores"], r["best"]) for r in matching.all_scores(reco, "rec", "w", matching.ngram_index(docs, "doc", "w"), docs, "doc").collect()}
    assert got == {1: ([2 / 3, 2 / 3, 0.0], "d1"), 2: ([0.0, 0.0, 0.0], None), 3: ([0.0, 0.0, 0.0], None)}
    assert matching.ngram_index(docs, "doc", "w", asked=matching.asked_grams(reco, "w")).count() == 4


def test_hot_ngrams(spark, monkeypatch):
    """Scores and votes are those of a plain count, whatever counts as hot."""
    from collections import Counter

    rng = random.Random(31)
    passages = [[f"p{k}w{i}" for i in range(6)] for k in range(4)]
    docs_ = {d: sum((p for p in rng.sample(passages, rng.randrange(0, 4))), [f"d{d}a", f"d{d}b", f"x{d % 5}", "y", "z"]) for d in range(60)}
    segs = [(s % 3, s, sum(rng.sample(passages, rng.randrange(0, 3)), []) + [f"d{s}a", f"d{s}b", f"x{s % 5}", "y", "z"][rng.randrange(3) :]) for s in range(25)]
    docs = spark.createDataFrame(list(docs_.items()), "doc long, w array<string>")
    said = spark.createDataFrame(segs, "rec long, seg long, w array<string>")
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hits = {s: Counter({d: sum(g in set(grams(w)) for g in grams(mine)) for d, w in docs_.items()}) for _, s, mine in segs}
    want = {(s, d, h, r) for s, c in hits.items() for r, (d, h) in enumerate(sorted(((d, h) for d, h in c.items() if h), key=lambda x: (-x[1], x[0]))[:10], 1)}
    votes = Counter((r, next(d for s2, d, _, k in sorted(want, key=lambda x: x[3]) if s2 == s and k == 1)) for r, s, _ in segs if any(hits[s].values()))
    for limit in (1000, 10, 0):
        monkeypatch.setattr(matching, "HOT_DOCUMENTS", limit)
        index = matching.ngram_index(docs, "doc", "w")
        got = matching.document_scores(said, "seg", "w", index).select("rec", "doc", "hits", "rank").collect()
        assert {tuple(r) for r in got} == want, limit
        assert {(r["rec"], r["doc"]): r["votes"] for r in matching.segment_votes(said, "rec", "seg", "w", index).collect()} == votes


def test_beam_search(spark):
    """A beam that holds all prefixes gives the sums over all frame paths; a bonus changes the order."""
    import itertools

    rng = np.random.default_rng(5)
    logs = decode.log_softmax(rng.normal(size=(5, 3)))
    sums = {}
    for path in itertools.product(range(3), repeat=5):
        labels = tuple(k for i, k in enumerate(path) if k and (not i or path[i - 1] != k))
        sums[labels] = np.logaddexp(sums.get(labels, -np.inf), sum(logs[t, k] for t, k in enumerate(path)))
    found = decode.beam_search(logs, width=10_000)
    assert [p for p, _ in found] == [p for p, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))] and all(abs(v - sums[p]) < 1e-9 for p, v in found)
    assert decode.beam_search(logs, width=10_000, bonus=lambda prefix, k: -50.0)[0][0] == ()
    assert decode.beam_search(np.zeros((0, 3))) == [((), 0.0)]
    scores = rng.normal(size=(2, 5, 3))
    frames = spark.createDataFrame([(r, t, scores[r, t].tolist()) for r in range(2) for t in range(5)], "rec int, t int, scores array<double>").repartition(3)
    got = {r["rec"]: (tuple(r["labels"]), r["score"]) for r in decode.decoded_labels(frames, "rec", width=10_000).collect()}
    for r in range(2):
        p, v = decode.beam_search(decode.log_softmax(scores[r]), width=10_000)[0]
        assert got[r][0] == p and got[r][1] == pytest.approx(v)


def test_ordered_ids(spark):
    df = spark.createDataFrame([(w,) for w in "zebra apple mango kiwi".split()], "w string")
    assert rows(sequence.ordered_ids(df, F.col("w")), "id") == [("apple", 1), ("kiwi", 2), ("mango", 3), ("zebra", 4)]


def test_small_helpers(spark):
    one = spark.range(1).select(tx.highlighted(F.lit("abcd"), F.lit(1), F.lit(3)).alias("h"), tx.frame_of(F.lit(1.99), 50.0).alias("f"), tx.first_beam(F.array().cast("array<string>")).alias("b")).first()
    assert one["h"] == "a<b>bc</b>d" and one["f"] == 99 and one["b"] is None
    arrays = spark.createDataFrame([(1, list(range(30)))], "rec int, x array<int>")
    cut = sequence.context_chunks(arrays, "x", 10, 3, 2)
    frames = cut.select("rec", "chunk", "beg", "own_beg", "own_end", F.posexplode(F.slice("x", F.col("beg") + 1, F.col("end") - F.col("beg"))).alias("i", "v"))
    merged = sequence.merged_chunks(frames, "rec", "chunk", "i", "own_beg", "own_end")
    assert rows(merged.select("t", "v"), "t") == [(i, i) for i in range(30)]
    words = spark.createDataFrame([(["b", "a", "b"],)], "w array<string>")
    vocab = stats.unigram_list(words, "w")
    assert rows(vocab, "id") == [("a", 1), ("b", 2)]
    back = stats.decoded(stats.encoded(spark.createDataFrame([("b",), ("z",)], "word string"), vocab).select("id"), vocab)
    assert sorted(r["word"] for r in back.collect()) == ["<unk>", "b"]
    with pytest.raises(Exception, match="words without times"):
        words.select(tx.same_length(F.col("w"), F.array(F.lit(1)))).collect()


def test_aligned_words_and_segments(spark):
    from weftline.plans import pipeline

    vocab = {"a": 1, "b": 2}
    # two voiced stretches, 0.5 to 1.0 s and 3.0 to 3.5 s; labels enter at fixed frames
    matches = spark.createDataFrame([(1, 0, 10, "ab ba", [(0.5, 1.0), (3.0, 3.5)])], "rec int, reco_beg int, norm_beg int, ref_text string, audio_offsets array<struct<start:double,end:double>>")
    entered = {30: 1, 35: 2, 40: 4, 150: 2, 155: 1, 160: 4}
    rows_ = [(1, t, [0.0 if k == 0 else (5.0 if entered.get(t) == k else -50.0) for k in range(5)]) for t in range(220)]
    frames = spark.createDataFrame(rows_, "rec int, t int, scores array<double>")
    ali = pipeline.aligned_words(matches, frames, vocab).orderBy("start").collect()

    # the same by hand, in frames
    mask = np.zeros(220, bool)
    for s, e in ((0.5, 1.0), (3.0, 3.5)):
        mask[int((s - 0.25) * 50) : int((e + 0.25) * 50)] = True
    labels = np.array([4, 1, 2, 4, 2, 1, 4])
    spans = viterbi.word_spans(viterbi.best_path(np.array([r[2] for r in rows_])[mask], labels), labels, 4)
    total = np.cumsum(mask) / 50
    want = [(10 + i, w, f := np.searchsorted(total, b / 50) / 50, f + (e - b) / 50) for i, ((b, e), w) in enumerate(zip(spans, ["ab", "ba"], strict=False))]
    assert [(r["norm_pos"], r["word"]) for r in ali] == [x[:2] for x in want]
    assert [(r["start"], r["end"]) for r in ali] == [pytest.approx(x[2:], abs=1e-6) for x in want]
    reco = spark.createDataFrame([(1, 0, "ab", 0.6, 0.8)], "rec int, pos int, word string, start double, end double")
    assert pipeline.segments(pipeline.aligned_words(matches, frames, vocab).withColumnRenamed("norm_pos", "pos"), reco).count() >= 1


def test_hot_ngrams_are_met_with_blocks(spark):
    """2,000 documents that hold different sets of 40 hot triples: the same best documents as by a plain count, and far fewer documents read than recordings times documents."""
    from weftline.operators import postings

    rng = random.Random(17)
    docs_ = {d: sorted(rng.sample(range(40), rng.choice([2, 4, 6, 20]))) for d in range(2000)}
    index = spark.createDataFrame([(f"g{g}", d) for d, held in docs_.items() for g in held] + [(f"rare{d}", d) for d in range(0, 2000, 3)], "gram string, doc long")
    asked = {r: {f"g{g}": rng.randrange(1, 3) for g in rng.sample(range(40), 30)} | {f"rare{rng.randrange(2000)}": 1} for r in range(50)}
    counted = spark.createDataFrame([(r, g, t) for r, held in asked.items() for g, t in held.items()] + [(None, "g1", 1)], "rec long, gram string, times int")
    asked[None] = {"g1": 1}
    met = []
    out = postings.best_documents(counted, ["rec"], index, 10, 200, 32, met).collect()
    for r, held in asked.items():
        plain = {d: sum(held.get(f"g{g}", 0) for g in has) + (held.get(f"rare{d}", 0) if d % 3 == 0 else 0) for d, has in docs_.items()}
        want = sorted(((h, d) for d, h in plain.items() if h), key=lambda x: (-x[0], x[1]))[:10]
        got = sorted(((x["hits"], x["doc"]) for x in out if x["rec"] == r), key=lambda x: (-x[0], x[1]))[:10]
        assert got == want, r
    read = met[0].filter("kid IS NOT NULL").count() * 32
    assert read < 0.35 * 51 * 2000, read
    assert len(out) < 0.1 * 51 * 2000


def test_edit_scripts_side_by_side_and_in_bands(monkeypatch):
    """The same script among equal ones as a full table's, whatever is held at a time."""
    rng = random.Random(41)

    def plain(a, b):
        cost = [[j if not i else i if not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        i, j, out = len(a), len(b), []
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                out.append(edit.EQUAL if a[i] == b[j] else edit.REPLACE)
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
                out.append(edit.DELETE)
            else:
                j -= 1
                out.append(edit.INSERT)
        return out[::-1]

    pairs = [([], []), ([], ["a"]), (["a"], [])]
    for _ in range(250):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 40))]
        b = [x for x in a for x in ([x] if rng.random() < 0.8 else [rng.choice("abcd"), x][: rng.randrange(0, 3)])] if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(rng.randrange(0, 40))]
        pairs.append((a, b))
    want = [plain(a, b) for a, b in pairs]
    for small, band, held, kept in ((1 << 14, 64, 1 << 22, 128), (1 << 14, 64, 3000, 7), (0, 64, 1 << 22, 128), (0, 1, 1 << 22, 128), (0, 2, 50, 3), (0, 1, 10, 1)):
        for name, value in (("SMALL_CELLS", small), ("BAND", band), ("HELD_CELLS", held), ("KEPT_ROWS", kept)):
            monkeypatch.setattr(edit, name, value)
        assert [x.tolist() for x in edit.scripts(pairs)] == want
    monkeypatch.undo()
    a = [f"w{i % 3000}" for i in range(20_000)]
    b = [*a[:50], "new", *a[50:9000], *a[9003:15_000], "x", *a[15_001:]]
    began = time.perf_counter()
    assert edit.errors(a, b) == (3, 1, 1, 20_000, 19_996, 0.0)
    assert time.perf_counter() - began < 5


def test_windows_by_bits():
    from weftline.operators import windows

    rng = random.Random(42)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
        return row[-1]

    for _ in range(150):
        a, b = ("".join(rng.choice("abé😀 ") for _ in range(rng.randrange(0, 22))) for _ in range(2))
        assert windows.distance(a, b) == plain(a, b)
        assert windows.end_distances(a, b).tolist() == [min(plain(a, b[i:j]) for i in range(j + 1)) for j in range(len(b) + 1)]
    vocab = [f"w{i}" for i in range(30)]
    for _ in range(150):
        words, n = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))], rng.randrange(1, 12)
        said = " ".join(rng.choice(vocab) for _ in range(n))
        last = max(1, len(words) - n + 1)
        begs = sorted(rng.sample(range(last), min(rng.randrange(1, 9), last)))
        assert windows.nearest(said, words, n, begs) == min((plain(said, " ".join(words[b : b + n])), b) for b in begs)
    # few of very many windows are compared
    words = [f"word{rng.randrange(3000)}" for _ in range(8000)]
    said, looked = [*words[5000:5050], "other", *words[5051:5100]], []
    found = windows.nearest(" ".join(said), words, 100, list(range(7900)), looked)
    assert found[1] == 5000 and len(looked) < 100


def test_near_counts_are_those_of_all_windows(spark, monkeypatch):
    """Ranges and groups of chunks don't change the candidates."""
    from weftline.operators import windows

    rng = random.Random(43)
    vocab = [f"w{i}" for i in range(25)]
    texts_ = {r: [rng.choice(vocab) for _ in range(n)] for r, n in (("a", 150), ("b", 7), ("c", 61), ("d", 1))}
    chunks_ = [(r, c, [rng.choice([*vocab, "never"]) for _ in range(rng.randrange(0, 13))]) for r in [*texts_, "none"] for c in range(5)]
    corpus = spark.createDataFrame([(r, i, w) for r, t in texts_.items() for i, w in enumerate(t)], "rec string, pos int, word string").repartition(4)
    chunks = spark.createDataFrame(chunks_, "rec string, chunk int, words array<string>")
    want = set()
    for r, c, words in chunks_:
        t, n = texts_.get(r, []), len(words)
        counts = {b: sum(w in words for w in t[b : b + n]) for b in range(max(len(t) - n + 1, 1))} if t and n else {}
        best = max(counts.values(), default=0)
        want |= {(r, c, n, b, k) for b, k in counts.items() if best and k >= best * 0.9}
    for size, at_once in ((4096, 64), (10, 2), (1, 1)):
        monkeypatch.setattr(windows, "RANGE_WORDS", size)
        monkeypatch.setattr(windows, "CHUNKS_AT_ONCE", at_once)
        assert {tuple(r) for r in matching.candidates(chunks, corpus, many=1 << 40).collect()} == want
    assert matching.candidates(chunks.limit(0), corpus).count() == 0


def test_dyadic_cells(spark):
    """Cells cover every bucket of an interval once and no other; a year at half a minute has fewer than a hundred."""
    spans = [(a, b) for a in range(-9, 10) for b in range(a, 11)] + [(0, 365 * 24 * 120), (12_345, 12_345 + 365 * 24 * 120), (-3, (1 << 42) + 5)]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("c", intervals.dyadic_cells(F.col("a"), F.col("b")))
    for r in df.collect():
        assert len(r["c"]) < 100 and sum(1 << x["level"] for x in r["c"]) == r["b"] - r["a"] + 1
        if r["b"] - r["a"] < 100:
            assert sorted(k for x in r["c"] for k in range(x["cell"] << x["level"], (x["cell"] + 1) << x["level"])) == list(range(r["a"], r["b"] + 1))


def test_points_in_intervals_of_any_length(spark):
    """Short and very long intervals, points before zero, several points of a row, nulls and clashing names, open and closed ends: as by all pairs."""
    rng = random.Random(51)
    spans = [(k % 3, k, s, s + rng.choice([0, 1, 7, 60, 5000, 10**7])) for k, s in ((k, rng.randrange(-300, 3000)) for k in range(60))] + [(0, 98, None, 5), (0, 99, 5, None), (1, 97, 50, 40)]
    points = [(k % 3, k, rng.randrange(-400, 9000), rng.randrange(-400, 9000)) for k in range(150)] + [(0, 990, None, 3), (0, 991, None, None)]
    i = spark.createDataFrame(spans, "rec int, span int, b long, f long")
    p = spark.createDataFrame(points, "rec int, pos int, x long, y long").withColumn("level", F.lit(1)).withColumn("cell", F.lit(1))
    for closed in (True, False):
        for columns in ("x", "y"), ("x",):
            got = intervals.points_in_intervals(p, i, "rec", [F.col(c) for c in columns], "b", "f", 30, closed).select("pos", "span").collect()
            inside = lambda t, b, f, closed=closed: t is not None and b is not None and f is not None and b <= t and (t <= f if closed else t < f)
            want = {(q, s) for r, q, x, y in points for k, s, b, f in spans if r == k and any(inside(t, b, f) for t in (x, y)[: len(columns)])}
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert intervals.points_in_intervals(p, i.limit(0), "rec", F.col("x"), "b", "f", 30).count() == 0


def test_scans_of_a_key_in_ranges(spark):
    """Unions of intervals and restored times are the same where a key is cut into ranges."""
    rng = random.Random(61)
    spans = [(rng.choice([0, 0, 0, 1, None]), s, s + rng.choice([1, 5, 40, 900])) for s in (rng.randrange(5000) for _ in range(700))] + [(2, 5, 9)]
    df = spark.createDataFrame(spans, "rec int, s long, e long").repartition(5)
    for margin in (0, 3):
        plain = {tuple(r) for r in sequence.interval_union(df, "rec", "s", "e", margin).collect()}
        assert {tuple(r) for r in sequence.interval_union(df, "rec", "s", "e", margin, key_rows=10).collect()} == plain and len(plain) > 5
    islands = sequence.interval_union(df.filter("e - s < 40"), "rec", "s", "e")
    times = spark.createDataFrame([(k, t, "x") for k in (0, 1, 3) for t in range(0, 2500, 3)], "rec int, at long, start string")
    want = {tuple(r) for r in sequence.restore_time(times, islands, "rec", "at").collect()}
    assert {tuple(r) for r in sequence.restore_time(times, islands, "rec", "at", key_rows=10).collect()} == want and len(want) > 100
    assert sequence.interval_union(df.limit(0), "rec", "s", "e", key_rows=0).count() == 0


@pytest.mark.parametrize("touching", [True, False])
def test_greedy_choice_of_a_key_in_ranges(spark, touching):
    """The same rows are kept where a key is cut into ranges; steps stand for a range."""
    rng = random.Random(71 + touching)
    spans = [(rng.choice([0, 0, 0, 1, None]), k, s, s + rng.choice([0, 1, 5, 40, 900])) for k, s in enumerate(rng.randrange(6000) for _ in range(900))] + [(2, 990, 5, 9), (0, 991, None, 4), (0, 992, 4, None)]
    df = spark.createDataFrame(spans, "rec int, pos int, s long, e long").repartition(5)
    plain = sorted(map(str, sequence.greedy_keep(df, "rec", "s", "e", ["s", "pos"], touching).collect()))
    ranged = sequence.greedy_keep(df, "rec", "s", "e", ["s", "pos"], touching, key_rows=10)
    assert sorted(map(str, ranged.collect())) == plain and 30 < len(plain) < 700 and ranged.columns == df.columns
    mine = sorted((s, e) for r, _, s, e in spans if r == 0 and s is not None and e is not None)
    steps = sequence._range_steps([s for s, _ in mine], [e for _, e in mine], touching)
    assert len(steps) < len(mine) / 3
    for last in range(-5, 7000, 7):
        want = last
        for s, e in mine:
            if s > want or (touching and s == want):
                want = e
        found = next((y for x, y in steps if x > last or (touching and x == last)), last)
        assert found == want, last
    assert sequence.greedy_keep(df.limit(0), "rec", "s", "e", key_rows=0).count() == 0


@pytest.mark.parametrize("compat", [False, True])
def test_paths_in_blocks(monkeypatch, compat):
    """The same path, with ties, whatever part of the table is held."""
    rng = np.random.default_rng(81)
    for _ in range(60):
        frames, states = int(rng.integers(1, 60)), int(rng.integers(1, 14))
        scores, labels = rng.integers(-3, 3, (frames, 5)).astype(float), rng.integers(0, 5, states)
        whole = viterbi.best_path(scores, labels, 0, compat)
        for held in (1, 7, 40, 200):
            monkeypatch.setattr(viterbi, "HELD_CELLS", held)
            assert viterbi.best_path(scores, labels, 0, compat).tolist() == whole.tolist()
        monkeypatch.undo()
        if frames >= states:
            assert whole[0] == 0 and whole[-1] == states - 1 and set(np.diff(whole).tolist()) <= {0, 1}
