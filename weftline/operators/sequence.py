"""Operators on ordered rows of a group: chunks, gaps, greedy choices, unions of intervals, runs.

Windows are partitioned by the group's key. Choices that depend on earlier choices run as folds over
sorted partitions: a task streams through its rows with one state, so the length of a group doesn't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.sources.scratch import settled


def sorted_fold(df: DataFrame, keys: list[str], order: list, start: Callable, step: Callable, out: str, dealt: bool = False) -> DataFrame:
    """``df`` with the columns ``out`` (DDL) that ``step(state, row) -> (state, values)`` gives row by row, in each group of ``keys`` from ``start(row)`` on. ``dealt``: a group's rows are in one partition already, as after a window over ``keys``."""
    added = StructType.fromDDL(out)
    schema = StructType([*df.schema.fields, *added.fields])
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]):
        group, state = None, None
        target = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            values = []
            for row in rows:
                key = tuple(row[i] for i in at)
                if group is None or key != group:
                    group, state = key, start(row)
                state, got = step(state, row)
                values.append(got)
            if target is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(added)
            columns = [pa.array([v[i] for v in values], target.field(i).type) for i in range(len(target))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *target.names])

    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def gap_groups(df: DataFrame, key: str, start: str, end: str, gap: float, order: list | None = None, name: str = "group_no") -> DataFrame:
    """Numbers groups from 0: a row begins a new one if it starts more than ``gap`` after the row before it ended."""
    w = Window.partitionBy(key).orderBy(*(order or [start]))
    new = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def fixed_chunks(df: DataFrame, tokens: str, length: int, stride: int) -> DataFrame:
    """A row for each chunk of an array: chunk, beg, end, and its words. Chunks begin every ``stride`` words."""
    n = F.size(tokens)
    begins = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / F.lit(stride)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    numbered = df.select(*df.columns, F.explode(begins).alias("chunk"))
    beg = F.col("chunk") * stride
    return numbered.withColumn("beg", beg).withColumn("end", F.least(beg + length, F.size(tokens))).withColumn("words", F.slice(tokens, beg + 1, F.lit(length)))


def gap_chunks(df: DataFrame, key: str, pos: str, start: str, end: str, gap: float = 15.0, least: int = 15, most: int = 1000) -> DataFrame:
    """(key, beg, end): chunks of words, cut at gaps and at ``most`` words, those under ``least`` left out.

    After a cut the next gap is measured from the start, not the end, of the chunk's first word; a cut so depends on the one before it.
    Words without a start or an end are in no chunk.
    """
    columns = df.select(key, pos, start, end).filter(F.col(start).isNotNull() & F.col(end).isNotNull())

    def step(state, row):
        number, n, last = state
        if n and (row[2] - last > gap or n >= most):
            return (number + 1, 1, row[2]), (number + 1,)
        return (number, n + 1, row[3]), (number,)

    cut = sorted_fold(columns, [key], [pos], lambda row: (0, 0, row[2]), step, "chunk int")
    return cut.groupBy(key, "chunk").agg(F.min(pos).alias("beg"), (F.max(pos) + 1).alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least).select(key, "beg", "end")


def greedy_keep(df: DataFrame, key: str, start: str, end: str, order: list | None = None, touching: bool = True, key_rows: int | None = None) -> DataFrame:
    """Rows kept in the order of their start if they do not begin before the end of the row kept last; ``touching=False`` also drops those that begin at it. Rows without a start or an end take no time and are not kept.

    A key with more than ``key_rows`` rows (``KEY_ROWS``) is cut into ranges (``_greedy_ranges``); ``order`` then begins with the start.
    """
    df = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    order = order or [start]
    largest = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if order[0] == start else 0
    if largest > (KEY_ROWS if key_rows is None else key_rows):
        return _greedy_ranges(df, key, start, end, order, touching)
    s, e = df.columns.index(start), df.columns.index(end)

    def step(last, row):
        keep = last is None or row[s] > last or (touching and row[s] == last)
        return (row[e] if keep else last), (keep,)

    return sorted_fold(df, [key], order, lambda row: None, step, "__keep boolean").filter("__keep").drop("__keep")


def _range_steps(starts: list, ends: list, touching: bool) -> list[tuple]:
    """What a range of rows in order makes of the end kept before it: (begin, end) in order of begin, where an end that the row with that begin could follow becomes the end kept last. Later ends pass by the range.

    From the last row on: a row's choice leads to the first row that can follow it, and so to that one's result. Neighbours that lead to the same result are one step.
    """
    where = bisect_left if touching else bisect_right
    last = list(ends)
    steps: list[tuple] = []
    for i in range(len(starts) - 1, -1, -1):
        following = max(where(starts, ends[i]), i + 1)
        last[i] = ends[i] if following >= len(starts) else last[following]
        if not steps or steps[-1][1] != last[i]:
            steps.append((starts[i], last[i]))
    return steps[::-1]


def _greedy_ranges(df: DataFrame, key: str, start: str, end: str, order: list, touching: bool) -> DataFrame:
    """``greedy_keep`` of keys of any size. Rows are dealt into ranges of (key, order). Each range becomes the steps of ``_range_steps``, one row; one fold over a key's ranges tells the end kept before each, by a search among its steps, and then each range is
    folded by itself from there. So no task goes through the rows of more than its own range."""
    rows = settled(df.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id()))
    ordered = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(start).alias("s"), F.col(end).alias("e"))))
    kind = df.schema[start].dataType.simpleString()

    @F.pandas_udf(f"array<struct<s:{kind},e:{df.schema[end].dataType.simpleString()}>>")
    def steps(starts, ends):
        import pandas as pd

        return pd.Series([[{"s": a, "e": b} for a, b in _range_steps(list(x), list(y), touching)] for x, y in zip(starts, ends, strict=True)])

    held = rows.groupBy(key, "__p").agg(ordered.alias("r")).select(key, "__p", F.transform("r", lambda x: x["s"]).alias("s"), F.transform("r", lambda x: x["e"]).alias("e"))
    ranges = held.select(key, "__p", steps("s", "e").alias("steps"))
    at = ranges.columns.index("steps")

    def pass_on(last, row):
        found = row[at]
        if last is None:
            return found[0]["e"], (None,)
        where = (bisect_left if touching else bisect_right)([x["s"] for x in found], last)
        return (found[where]["e"] if where < len(found) else last), (last,)

    before = settled(sorted_fold(ranges, [key], ["__p"], lambda row: None, pass_on, f"__last {df.schema[end].dataType.simpleString()}").select(F.col(key).alias("__k"), F.col("__p").alias("__q"), "__last"))
    met = rows.join(before, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q"))).drop("__k", "__q")
    s, e, b = (met.columns.index(c) for c in (start, end, "__last"))

    def step(last, row):
        keep = last is None or row[s] > last or (touching and row[s] == last)
        return (row[e] if keep else last), (keep,)

    kept = sorted_fold(met, [key, "__p"], order, lambda row: row[b], step, "__keep boolean")
    return kept.filter("__keep").select(*df.columns)


def split_long(df: DataFrame, keys: list[str], start: str, end: str, longest: float, order: list) -> DataFrame:
    """Adds ``part``: groups of ``keys`` longer than ``longest`` are cut into parts of about equal duration. Rows without a start or an end stay in the part of the row before them, and begin none."""
    w = Window.partitionBy(*keys)
    first = F.min(F.struct(*order, F.col(start).alias("__v"))).over(w)["__v"]
    last = F.max(F.struct(*order, F.col(end).alias("__v"))).over(w)["__v"]
    span = last - first
    timed = df.withColumn("__part", F.when(span > longest, span / F.ceil(span / F.lit(longest))))
    s, e, p = timed.columns.index(start), timed.columns.index(end), timed.columns.index("__part")

    def step(state, row):
        number, begin, begun = state
        if row[s] is None or row[e] is None:
            return state, (number,)
        if begin is None:
            begin = row[s]
        if row[p] is not None and row[e] - begin > row[p] and begun:
            return (number + 1, row[s], True), (number + 1,)
        return (number, begin, True), (number,)

    return sorted_fold(timed, keys, order, lambda row: (0, row[s], False), step, "part int", dealt=True).drop("__part")


#: A key with more rows is cut into ranges; those of smaller ones are one window.
KEY_ROWS = 2_000_000


class Scan:
    """Running values over the rows of each key in order, of any number of rows a key.

    Where no key has more than ``key_rows`` rows these are window functions. Else rows are dealt into ranges of (key, order): values run inside each range,
    the totals of a key's ranges, one row for each, run over ranges, and the two are put together, so that no window holds a whole key.
    """

    def __init__(self, df: DataFrame, key: str, order: list[str], key_rows: int | None = None):
        self.key, self.order = key, order
        largest = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        self.ranged = largest > (KEY_ROWS if key_rows is None else key_rows)
        self.rows = settled(df.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id())) if self.ranged else df

    def add(self, name: str, kind: str, value: Column, inclusive: bool = False) -> None:
        """Adds the column ``name``: the max, sum or last non-null (``kind``) of ``value`` over the rows before each, and it; null before the first."""
        end = Window.currentRow if inclusive else -1
        agg = {"max": F.max, "sum": F.sum, "last": lambda x: F.last(x, ignorenulls=True)}[kind]
        if not self.ranged:
            self.rows = self.rows.withColumn(name, agg(value).over(Window.partitionBy(self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, end)))
            return
        rows = self.rows.withColumn("__v", value)
        own = agg(F.col("__v")).over(Window.partitionBy("__p", self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, end))
        total = F.max_by("__v", F.struct(*self.order)) if kind == "last" else agg("__v")
        totals = (rows.filter(F.col("__v").isNotNull()) if kind == "last" else rows).groupBy("__p", self.key).agg(total.alias("__t"))
        # one row for each range that a key reaches into
        ranges = rows.select("__p", self.key).distinct().join(totals, ["__p", self.key], "left")
        before = agg("__t").over(Window.partitionBy(self.key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
        carried = ranges.select(F.col("__p").alias("__q"), F.col(self.key).alias("__k"), before.alias("__c"))
        met = rows.withColumn("__own", own).join(carried, (F.col("__p") == F.col("__q")) & F.col(self.key).eqNullSafe(F.col("__k")))
        both = {"max": F.greatest("__own", "__c"), "sum": F.when(F.col("__own").isNull(), F.col("__c")).otherwise(F.col("__own") + F.coalesce("__c", F.lit(0))), "last": F.coalesce("__own", "__c")}[kind]
        self.rows = settled(met.withColumn(name, both).drop("__v", "__own", "__q", "__k", "__c"))

    def done(self) -> DataFrame:
        return self.rows.drop("__p") if self.ranged else self.rows


def interval_union(df: DataFrame, key: str, start: str, end: str, margin: float = 0.0, key_rows: int | None = None) -> DataFrame:
    """(key, island, start, end, before): maximal intervals covered, widened by ``margin`` and cut off at 0, and the time covered before each. A key may have any number of rows (``Scan``)."""
    wide = df.select(key, F.greatest(F.col(start) - margin, F.lit(0)).alias("s"), (F.col(end) + margin).alias("e"))
    scan = Scan(wide, key, ["s", "e"], key_rows)
    scan.add("reach", "max", F.col("e"))
    scan.add("island", "sum", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0), inclusive=True)
    islands = scan.done().groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    if not scan.ranged:
        before = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(key).orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
        return islands.withColumn("before", F.coalesce(before, F.lit(0)))
    covered = Scan(settled(islands), key, ["island"], key_rows)
    covered.add("before", "sum", F.col("end") - F.col("start"))
    return covered.done().withColumn("before", F.coalesce("before", F.lit(0)))


def restore_time(times: DataFrame, islands: DataFrame, key: str, at: str, key_rows: int | None = None) -> DataFrame:
    """Adds ``restored``: where the covered time ``at`` lies in the original time; times beyond all islands are left out.

    Islands and times are merged in one sorted pass for each key: a time takes the last island that begins, in covered time, before it (time 0 the first island). A key may have any number of rows (``Scan``).
    """
    own = F.struct(*(F.col(f"`{c}`") for c in times.columns)).alias("__row")
    t = times.select(F.col(key).alias("__k0"), F.col(at).alias("__v0"), F.lit(1).alias("__kind"), own, F.lit(None).cast(islands.schema["start"].dataType).alias("__s"), F.lit(None).cast(islands.schema["before"].dataType).alias("__b"), F.lit(None).cast(islands.schema["end"].dataType).alias("__e"))
    # an island that begins at a covered time holds what comes after it; the first also holds time 0
    i = islands.filter(F.col("end") > F.col("start")).select(F.col(key).alias("__k0"), F.col("before").alias("__v0"), F.when(F.col("before") == 0, 0).otherwise(2).alias("__kind"), F.lit(None).cast(t.schema["__row"].dataType).alias("__row"), F.col("start").alias("__s"), F.col("before").alias("__b"), F.col("end").alias("__e"))
    scan = Scan(t.unionByName(i), "__k0", ["__v0", "__kind"], key_rows)
    scan.add("__i", "last", F.when(F.col("__kind") != 1, F.struct("__s", "__b", "__e")), inclusive=True)
    found = scan.done().filter((F.col("__kind") == 1) & (F.col("__v0") - F.col("__i.__b") <= F.col("__i.__e") - F.col("__i.__s")))
    return found.select("__row.*", (F.col("__i.__s") + F.col("__v0") - F.col("__i.__b")).alias("restored"))


def merged_islands(df: DataFrame, key: str, start: str, end: str, gap: float, least: float) -> DataFrame:
    """(key, island, start, end): intervals whose distance is less than ``gap`` become one; of these, the ones of at least ``least`` stay, numbered from 0."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0)
    marked = df.select(key, F.col(start), F.col(end), new.alias("__new")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = marked.groupBy(key, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end")).filter(F.col("end") - F.col("start") >= least)
    return spans.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).cast("long").alias("island"), "start", "end")


def energy_islands(frames: DataFrame, key: str, at: str, level: str, floor: float, frame: float = 1.0) -> DataFrame:
    """(key, island, start, end): runs of frames whose level reaches ``floor``, in units of ``frame``: a stand-in for a voice detector's segments."""
    loud = frames.select(key, at, F.coalesce(F.col(level) >= floor, F.lit(False)).alias("__loud"))
    found = runs(loud, key, at, "__loud").filter("__loud")
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("beg")) - 1).cast("long").alias("island"), (F.col("beg") * F.lit(frame)).alias("start"), (F.col("end") * F.lit(frame)).alias("end"))


def final_order(segments: DataFrame, key: str, start: str, ties: list, name: str = "place") -> DataFrame:
    """Numbers the segments of each key from 0 in the order of their start; those without one come as if they began at 0."""
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col(start), F.lit(0)), *ties)
    return segments.withColumn(name, (F.row_number().over(order) - 1).cast("long"))


def runs(df: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """(key, run, label, beg, end): runs of equal neighbouring labels."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key, "run").agg(F.first(label).alias(label), F.min(at).alias("beg"), (F.max(at) + 1).alias("end"))


def collapsed(frames: DataFrame, key: str, at: str, label: str, pad: int) -> DataFrame:
    """(key, labels): labels of runs in order, without the pad: the greedy reading of frame labels."""
    kept = runs(frames, key, at, label).filter(F.col(label) != pad)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("run", label))), lambda x: x[label]).alias("labels"))


def gaps_between(segments: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Gaps that neighbouring segments (reco_beg, reco_end, norm_beg, norm_end) leave on both sides, and a head and a tail.

    ``lengths``: key, n_reco, n_norm. Head and tail take as many reference words as recognised ones, cut off at the ends of the reference.
    """
    w = Window.partitionBy(key).orderBy("reco_beg", "norm_beg")
    inner = segments.select(key, F.col("reco_end").alias("rb"), F.lead("reco_beg").over(w).alias("re"), F.col("norm_end").alias("nb"), F.lead("norm_beg").over(w).alias("ne"))
    ends = segments.groupBy(key).agg(F.min(F.struct("reco_beg", "norm_beg"))["reco_beg"].alias("first"), F.max(F.struct("reco_beg", "norm_beg", "reco_end"))["reco_end"].alias("last"), F.min("norm_beg").alias("low"), F.max(F.struct("norm_beg", "norm_end"))["norm_end"].alias("high")).join(lengths, key)
    short = F.greatest(F.col("first") - F.col("low"), F.lit(0))
    head = ends.select(key, short.alias("rb"), F.col("first").alias("re"), F.greatest(F.col("low") - F.col("first"), F.lit(0)).alias("nb"), F.col("low").alias("ne"))
    tail = ends.select(key, F.col("last").alias("rb"), F.col("n_reco").alias("re"), F.col("high").alias("nb"), F.least(F.col("high") + F.col("n_reco") - F.col("last"), F.col("n_norm")).alias("ne"))
    return inner.unionByName(head).unionByName(tail).filter("re > rb and ne > nb").select(key, F.col("rb").alias("reco_beg"), F.col("re").alias("reco_end"), F.col("nb").alias("norm_beg"), F.col("ne").alias("norm_end"))


def overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows that begin before the row before them ended."""
    w = Window.partitionBy(key).orderBy(start, end)
    return df.withColumn("previous_end", F.lag(end).over(w)).filter(F.col(start) < F.col("previous_end"))


def context_chunks(df: DataFrame, array: str, length: int, left: int, right: int) -> DataFrame:
    """A row for each chunk of ``length`` elements, with the elements that are its own: neighbours overlap by ``left + right``, of which each keeps its side. The chunk that reaches the end is the last."""
    step = length - left - right
    n = F.size(array)
    numbered = df.select(*df.columns, F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("chunk", "beg")).filter((F.col("chunk") == 0) | (F.col("beg") - step + length < n))
    end = F.least(F.col("beg") + length, n)
    own_beg = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("beg") + left)
    own_end = F.when(end == n, n).otherwise(end - right)
    return numbered.withColumn("end", end).withColumn("own_beg", own_beg).withColumn("own_end", own_end).filter("own_end > own_beg")


def ordered_ids(df: DataFrame, by: Column, name: str = "id", first: int = 1) -> DataFrame:
    """Numbers rows in the order of ``by`` over all partitions: ranges are counted, then numbered inside. No task sees all rows."""
    # written once: numbers of ranges must not change between the two reads
    spread = settled(df.repartitionByRange(by).withColumn("__p", F.spark_partition_id()))
    counts = spread.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(by))
    # one row for each partition
    return spread.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("before") + F.col("__i") - 1 + first).drop("__p", "__i", "before")


def merged_chunks(frames: DataFrame, key: str, chunk: str, at: str, own_beg: str, own_end: str) -> DataFrame:
    """Frames of overlapping chunks put together: of each chunk (rows numbered ``at`` from its begin ``beg``) those that are its own, with their number in the whole as ``t``."""
    t = F.col("beg") + F.col(at)
    return frames.withColumn("t", t).filter((F.col("t") >= F.col(own_beg)) & (F.col("t") < F.col(own_end))).drop(chunk, at, "beg", own_beg, own_end)


def timed_only(segments: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Segments that take time."""
    return segments.filter(F.col(end) > F.col(start))
