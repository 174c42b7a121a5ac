"""Line dedup by content-defined chunks: against a plain version, recall on planted runs, and edge cases."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import line_chunks


def plain(data):
    """{(id, text): kept lines} by a dictionary of all chunks."""
    docs = {(i is not None, i, line_order(t), t or ""): line_chunks.chunks(t) for i, t in data}
    places = {}
    for d, (lines, ends) in docs.items():
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            above = lines[ends[k - 1] + 1 if k else 0 : a][::-1]
            below = lines[b + 1 : ends[k + 2] if k + 2 < len(ends) else len(lines)]
            places.setdefault(b"\n".join(lines[a : b + 1]), []).append((d, a, b, above, below))
    gone, kept = {d: set() for d in docs}, {d: set() for d in docs}
    for found in places.values():
        found.sort(key=lambda x: (x[0][:3], x[1]))
        od, oa, ob, oabove, obelow = found[0]
        for d, a, b, above, below in found[1:]:
            if d == od and a <= ob:
                continue
            up = next((k for k, (x, y) in enumerate(zip(above, oabove)) if x != y), min(len(above), len(oabove)))
            down = next((k for k, (x, y) in enumerate(zip(below, obelow)) if x != y), min(len(below), len(obelow)))
            if d == od:
                up = min(up, a - ob - 1)
                down = min(down, a - ob - 1 - up)
            gone[d] |= set(range(a - up, b + down + 1))
            kept[od] |= set(range(oa - up, ob + down + 1))
    return {d: b"\n".join(x for k, x in enumerate(lines) if k not in gone[d] - kept[d]).decode() for d, (lines, _) in docs.items()}


def line_order(text):
    """Rows of one id come in the order of the engine's hash of their texts; told to the plain version by ``orders``."""
    return ORDERS[text or ""]


ORDERS = {}


def cleaned(df):
    return line_chunks.clean(df).select("doc_id", "text", f"{line_chunks.DROP}_lines", f"{line_chunks.DROP}_removed").collect()


def compare(spark, data, parts=3):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"digest": F.lit(1), "number": F.lit(2), "gone": F.lit("x"), "mark": F.lit(3)}).repartition(parts)
    ORDERS.clear()
    ORDERS.update({r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()})
    want = plain(data)
    out = cleaned(df)
    assert Counter((r["doc_id"], r["text"] or "") for r in out) == Counter((i, want[i is not None, i, ORDERS[t or ""], t or ""]) for i, t in data)
    return out


def test_against_a_plain_version(spark):
    rng = random.Random(4)
    pool = [rng.choice(["", "a", "- x", "tiny", "§", f"a line of some length {k}", f"another line, longer than the one before {k}"]) + (f" {k}" if rng.random() < 0.4 else "") for k in range(60)]
    data = []
    for k in range(120):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            at = rng.randrange(len(pool))
            lines += pool[at : at + rng.randrange(1, 9)] if rng.random() < 0.6 else [f"own {rng.random()}"]
        data.append((rng.choice([k, k, k, 5, None]), "\n".join(lines)))
    data += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "\n\n\n\n"), (204, "a"), (205, "a"), data[0], data[1]]
    compare(spark, data)


def test_one_whole_copy_stays(spark):
    x, y, z = (f"the line that is called {c}" for c in "XYZ")
    out = {r["doc_id"]: r["text"] for r in compare(spark, [(0, f"{x}\n{y}"), (1, f"{x}\n{y}\n{z}"), (2, f"{y}\n{z}")])}
    assert out == {0: f"{x}\n{y}", 1: f"{y}\n{z}", 2: ""}


@pytest.mark.parametrize("longest", [24, 120])
def test_recall_on_planted_runs(spark, longest):
    """Of later copies of planted passages of 2 to 8 lines no line stays where lines have ``TARGET`` bytes or more; with tiny lines among them at least 0.9 of the copies lose two lines or more. No other line goes."""
    rng, data, planted, k = random.Random(longest), [], {}, 0
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9)))
    least = 1 if longest == 24 else line_chunks.TARGET

    def own(n):
        out = []
        while len(out) < n:
            line, size = word(), rng.randrange(least, longest)
            while len(line) < size:
                line += " " + word()
            out.append(line)
        return out

    for n in range(2, 9):
        for _ in range(40):
            passage, before, after = own(n), own(rng.randrange(1, 6)), own(rng.randrange(0, 6))
            data += [(k, "\n".join(own(3) + passage + own(2))), (k + 1, "\n".join(before + passage + after))]
            planted[k + 1] = (n, before, after)
            k += 2
    out = {r["doc_id"]: r for r in compare(spark, data)}
    assert all(out[i]["text"] == t for i, t in data if i not in planted)
    whole = {n: sum(out[i][f"{line_chunks.DROP}_removed"] >= 2 for i, (m, _, _) in planted.items() if m == n) / 40 for n in range(2, 9)}
    if longest == 120:
        assert all(out[i]["text"] == "\n".join([*b, *a]) for i, (_, b, a) in planted.items())
    else:
        # one line in two is shorter than the target
        assert whole[2] >= 0.5 and all(whole[n] >= 0.9 for n in range(4, 9)), whole


def test_lines_of_repeated_ids(spark):
    """Rows of one id, or of none, that hold different texts lose their own repeats only."""
    rng = random.Random(3)
    passage = [f"shared line {i}" for i in range(20)]
    unique = [f"unique {i} {rng.random()}" for i in range(40)]
    data = [(1, "\n".join(passage)), (7, "\n".join(["a", *passage, "b"])), (7, "\n".join(unique)), (None, "\n".join(["n", *passage])), (None, "\n".join(x + "!" for x in unique)), (9, "\n".join(passage)), (9, "\n".join(passage))]
    long = "\n".join(f"{k} {rng.random()}" for k in range(150_000))
    data += [(20, long), (21, long + "\nthe end of it")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"mark": F.lit(1), "numbers": F.lit(2)}).repartition(3)
    out = Counter((r["doc_id"], r["text"]) for r in line_chunks.clean(df).collect())
    # null ids come first, so theirs is the copy that stays
    want = [(1, ""), (7, "a\nb"), (7, "\n".join(unique)), (None, "\n".join(["n", *passage])), (None, "\n".join(x + "!" for x in unique)), (9, ""), (9, ""), (20, long), (21, "the end of it")]
    assert out == Counter(want)
    assert line_chunks.clean(df.limit(0)).count() == 0


def test_chunk_boundaries_resist_shifts():
    """Lines put in front, or changed, change the chunks near them only."""
    rng = random.Random(6)
    lines = [f"{i} {rng.random()}"[: rng.randrange(1, 20)] for i in range(400)]
    of = lambda x: {b"\n".join(ls[a : b + 1]) for ls, ends in [line_chunks.chunks("\n".join(x))] for a, b in zip(ends, ends[1:])}
    whole = of(lines)
    assert 150 < len(whole) < 399
    for shift in (1, 2, 3, 7):
        assert len(whole - of(["new"] * shift + lines)) <= 2 and len(whole - of(lines[:200] + ["new"] * shift + lines[200:])) <= 3


def test_many_places_join_without_a_hot_key(spark, monkeypatch):
    """The same rows where no table of keys can be broadcast whole."""
    from weftline.llm import common

    rng = random.Random(9)
    shared = "\n".join(f"a passage that many documents hold, line {k}" for k in range(3))
    data = [(k, f"own text of number {rng.random()}\n{shared}\nand after it {rng.random()}" if k % 3 else f"pair {k // 6} of a line\npair {k // 6} of a second line") for k in range(90)]
    plain_join = common.counted_join
    monkeypatch.setattr(line_chunks, "counted_join", lambda df, found, on: plain_join(df, found, on, limit=2))
    monkeypatch.setattr(line_chunks, "sized_broadcast", lambda df, **how: df)
    out = compare(spark, data)
    assert sum(hashlib.sha256(shared.encode()).hexdigest() != "" and shared in r["text"] for r in out) == 1
