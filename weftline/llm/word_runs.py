"""Runs of repeating words: maximal repetitions of a text's words, all of them, and the text without the repeats.

A run is a stretch of words with smallest period q (words q apart are equal) that holds at least two periods and
that no neighbouring word extends. By the runs theorem every run holds, under an order of the words or under the
reverse of it, a longest Lyndon word of length q that begins at one of its places. The longest
Lyndon word at i ends where the next suffix smaller than the one at i begins, that is at the next smaller value of the
inverse suffix array. Each such root [i, j) is extended to both sides by the longest common extensions of i
and j: minima of the LCP array of the text, and of the reversed text, between their ranks, from a sparse table.

Texts are worked on in groups of about ``GROUP_WORDS`` words (one longer text is a group of its own), joined by end marks
that are smaller than every word and differ from each other, so no repetition crosses them. Suffixes are sorted by
prefix doubling, in which only those still tied are sorted again; time is O(n log n) sorts of shrinking parts at worst, memory some 60 + 8 log2(n) bytes a word of a group.

Cases: null counts as empty and has no runs, and its text stays null; a text without a run stays as it is, one with runs becomes its kept words
joined by one space; rows of equal ids stay apart; an empty table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import slices, table, words

#: Runs shorter than this many words are no evidence of repetition.
LEAST = 12
GROUP_WORDS = 150_000
RUNS, COLLAPSED = "word_runs", "word_runs_collapsed"


class Suffixes:
    """Suffix ranks of an array of numbers from 0 on; the end is smaller than every number."""

    def __init__(self, s: np.ndarray, with_lcp: bool = True):
        n = len(s)
        following = np.zeros(n, np.int64)
        following[:-1] = s[1:] + 1
        key = s * (int(s.max(initial=0)) + 2) + following
        order = np.argsort(key)
        places = np.arange(n)
        key = key[order]
        starts = np.ones(n, bool)
        starts[1:] = key[1:] != key[:-1]
        #: by round: the rank of each suffix by its first 2, 4, 8 ... numbers
        self.ranks = [self._spread(order, starts, places)]
        made = np.zeros(n, np.int8)  # the round that told a suffix from the one before it in order
        length = 2
        while not starts.all():
            rank = self.ranks[-1]
            tied = ~starts
            tied[:-1] |= ~starts[1:]
            at = np.flatnonzero(tied)
            own = order[at]
            further = own + length
            then = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
            key = rank[own].astype(np.int64) * (n + 1) + then
            again = np.argsort(key)
            order[at] = own[again]
            key = key[again]
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            made[at[new & ~starts[at]]] = len(self.ranks)
            starts[at] |= new
            self.ranks.append(self._spread(order, starts, places, at, rank))
            length *= 2
        self.rank = self.ranks[-1]
        if with_lcp:
            self._extensions(s, order, made)
        del self.ranks

    @staticmethod
    def _spread(order, starts, places, at=None, before=None):
        """Ranks of suffixes: the place in order where the group of equals begins."""
        if at is None:
            rank = np.empty(len(order), np.int32)
            rank[order] = np.maximum.accumulate(np.where(starts, places, 0))
            return rank
        rank = before.copy()
        rank[order[at]] = np.maximum.accumulate(np.where(starts[at], at, 0))
        return rank

    def _extensions(self, s, order, made):
        """The LCP array, from the ranks of the rounds, and its sparse table of minima."""
        n = len(s)
        lcp = np.zeros(n, np.int32)
        if n > 1:
            lcp[1:] = s[order[1:]] == s[order[:-1]]
        for told in range(1, int(made.max(initial=0)) + 1):
            at = np.flatnonzero(made == told)
            a, b, total = order[at - 1], order[at], np.full(len(at), 1 << told, np.int64)
            for level in range(told - 2, -1, -1):
                total += self._same(self.ranks[level], a + total, b + total, n) << (level + 1)
            x, y = a + total, b + total
            inside = np.maximum(x, y) < n
            total += inside & (s[np.minimum(x, n - 1)] == s[np.minimum(y, n - 1)])
            lcp[at] = total
        self.minima = np.zeros((max(n, 1).bit_length(), n), np.int32)
        self.minima[0] = lcp
        for k in range(1, len(self.minima)):
            half, m = 1 << (k - 1), n - (1 << k) + 1
            if m > 0:
                np.minimum(self.minima[k - 1, :m], self.minima[k - 1, half : half + m], out=self.minima[k, :m])

    @staticmethod
    def _same(rank, x, y, n):
        """Whether suffixes x and y have equal ranks in a round, as 0 or 1. Where a group's prefix would pass the end the group holds one suffix."""
        inside = np.maximum(x, y) < n
        return (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])).astype(np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes i and j (i <> j) have in common; 0 where one begins beyond the end."""
        n = len(self.rank)
        inside = np.maximum(i, j) < n
        out = np.zeros(len(i), np.int64)
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out[inside] = np.minimum(self.minima[k, lo], self.minima[k, hi - (1 << k) + 1])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    n = len(values)
    values = [*values, -1]
    out = [n] * n
    for i in range(n - 2, -1, -1):
        x, j = values[i], i + 1
        while values[j] > x:
            j = out[j]
        out[i] = j
    return out


def runs(s: np.ndarray, marks: int, least: int = LEAST) -> np.ndarray:
    """Rows (first, end, period) of the runs of at least ``least`` numbers, in order. Numbers under ``marks`` are end marks, each of which stands once."""
    n = len(s)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, behind = Suffixes(s), Suffixes(s[::-1].copy())
    top, found = int(s.max()), []
    for turned in (False, True):
        # the reversed order leaves the end marks smallest
        rank = Suffixes(np.where(s < marks, s, top + marks - s), False).rank if turned else ahead.rank
        ends = np.array(next_smaller(rank.tolist()), np.int64)
        i = np.flatnonzero((s >= marks) & (ends < n))
        j = ends[i]
        # a run longer than its root has an equal neighbour on one side of it
        some = (s[i] == s[j]) | ((i > 0) & (s[i - 1] == s[j - 1]))
        i, j = i[some], j[some]
        first, end = i - behind.common(n - i, n - j), j + ahead.common(i, j)
        long = (end - first >= 2 * (j - i)) & (end - first >= least)
        found.append(np.stack([first[long], end[long], (j - i)[long]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _groups(texts: list[bytes | None]):
    """(number of the first, words of each) of neighbouring texts with some ``GROUP_WORDS`` words."""
    group, size, first = [], 0, 0
    for k, text in enumerate(texts):
        w = (text or b"").split()  # bytes are split at space and U+0009 to U+000D
        if group and size + len(w) > GROUP_WORDS:
            yield first, group
            group, size, first = [], 0, k
        group.append(w)
        size += len(w)
    if group:
        yield first, group


def found_runs(texts: list[bytes | None], least: int = LEAST) -> list[tuple[np.ndarray, list[bytes] | None]]:
    """For each text its runs (rows: first, end, period) and, where there are any, the words that are kept."""
    out = []
    for _, group in _groups(texts):
        number: dict[bytes, int] = {}
        for w in group:
            number.update(dict.fromkeys(w))
        number = {w: len(group) + k for k, w in enumerate(number)}
        begins = np.cumsum([0] + [len(w) + 1 for w in group])
        s = np.empty(begins[-1], np.int64)
        for k, w in enumerate(group):
            s[begins[k] : begins[k + 1] - 1] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            s[begins[k + 1] - 1] = k
        all_ = runs(s, len(group), least)
        cuts = np.searchsorted(all_[:, 0], begins)
        for k, w in enumerate(group):
            own = all_[cuts[k] : cuts[k + 1]] - np.array([begins[k], begins[k], 0])
            if not len(own):
                out.append((own, None))
                continue
            depth = np.zeros(len(w) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 1], -1)
            kept = np.cumsum(depth[:-1]) == 0
            # by start, then period
            out.append((own[np.lexsort((own[:, 2], own[:, 0]))], [w[x] for x in np.flatnonzero(kept).tolist()]))
    return out


def _rows(batches, text_at: int, least: int):
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for whole in batches:
        for batch in slices(whole, text_at):
            texts = batch.column(text_at).cast(pa.large_binary()).to_pylist()
            done = found_runs(texts, least)
            offsets = np.cumsum([0] + [len(r) for r, _ in done]).astype(np.int32)
            flat = np.concatenate([r for r, _ in done]) if done else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(item))
            texts = [t if kept is None else b" ".join(kept) for t, (_, kept) in zip(texts, done, strict=True)]
            collapsed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values), collapsed], names=[*batch.schema.names, RUNS, COLLAPSED])


def word_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the runs of at least ``least`` words of each text (array of start, length, period; by start, then period) and the text without what repeats: a word stays unless a run holds it after its first period."""
    added = StructType.fromDDL(f"{RUNS} array<struct<start:bigint,length:bigint,period:bigint>>, {COLLAPSED} string")
    schema = StructType([*docs.schema.fields, *added.fields])
    text_at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _rows(batches, text_at, least), schema)


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten the words from a place on repeat with a period, both taken from a checksum of the id (null: as it is)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (F.floor((n - a) / (3 + F.col("g") % 8)) + 1).cast("int")
    tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get("w", a + i % p))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    marked = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    return marked.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are the documents' own; in one of ten a tail is made periodic by ``with_tails``. A text without runs keeps all its words, joined by one space."""
    found = word_runs(with_tails(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform(RUNS, lambda r: F.struct((-r["length"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(RUNS, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size(RUNS) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    kept = F.when(F.size(RUNS) > 0, F.col(COLLAPSED)).otherwise(F.array_join(words(F.col("text")), " "))
    rows = found.select("doc_id", F.size(RUNS).cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(kept, 256).alias("collapsed_sha256"))
    length = -F.col("b.x")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.expr("1000 * (-b.x) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
