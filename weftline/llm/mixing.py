"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: shares of a total by weight, none
above ``most`` times the source's size, the excess reshared by weight (the
common level is found in closed form over the sources in the order in which
they fill up).

Within a source documents have unequal inclusion: the expected number of copies is e = min(most, c * preference), with c such
that the expected words are the target; those that reach ``most`` are set apart and c is raised for the rest. The preference is the
square root of a document's words, or a column (1 for equal odds), rounded to a quarter of a power of two, so that c follows
exactly from sums over few steps. A document gets floor(e) certain whole copies. For the remainder p =
e - floor(e) documents are ranked by the odds of a fixed random number divided
by the odds of p, (u / (1 - u)) / (p / (1 - p)), and taken from the smallest
as long as the source's target is not exceeded: a sample whose size, in words,
is fixed. One further document, of the size nearest to what is then missing, closes the gap.

A source may hold any share of the rows: the end of its sample is found by summing words
over equal ranges of the rank, then over equal ranges of the range in which the target is reached, and only the
documents of the range that is left are put in order, equal ones as one row with their number.

Cases: null or empty texts have size 0 and taken 0; the null source counts as
a source of its own, last; null ids and repeated rows take part as rows: of rows that agree in id and text
as many are taken as the target leaves room for, any of them; null, negative or zero preferences count as the least;
an empty table gives an empty result; other columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, sized_broadcast, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20240131
#: Equal ranges at each of the two levels, as a power of two; ranks have 40 bits.
RANGE_BITS, RANK_BITS = 10, 40
#: Preferences are powers of two of a quarter of a step, within these steps.
STEPS = 4
LEAST_STEP, MOST_STEP = -160, 160
ROW = ("key", "doc_id", "size", "mark")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source of ``sizes`` (source, size)."""
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    total = sources.agg((F.sum("source_size") * share).alias("total")).select("total").scalar()
    known = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("total", total)
    # sources fill up in the order of cap / weight: with those before it full, a source is below its cap if the level reached is
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the first that the level reached does not fill sets the level for itself and all after it
    levels = known.withColumn("level", (F.col("total") - before) / after).withColumn("place", F.row_number().over(fill))
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))).over(Window.partitionBy())
    full = first.isNull() | (F.col("place") < first["place"])
    return levels.select("source", "source_size", F.when(full, F.col("cap")).otherwise(first["level"] * F.col("weight")).alias("target"))


def inclusion_rates(docs: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, step, source_size, target, rate): the expected copies of a document of each step of preference. A few hundred rows a source at most."""
    sums = docs.filter("size > 0").groupBy("source", "step").agg(F.sum("size").alias("words")).withColumnRenamed("source", "own")
    known = sums.join(sized_broadcast(targets), F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("pref", F.pow(F.lit(2.0), F.col("step") / STEPS))
    # with the steps above at `most`, a step sets c if it stays below
    down = Window.partitionBy("source").orderBy(F.desc("step"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("pref")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    known = known.withColumn("c", F.greatest((F.col("target") - most * above) / rest, F.lit(0.0)))
    first = F.max(F.when(F.col("c") * F.col("pref") < most, F.struct("step", "c"))).over(Window.partitionBy("source"))
    full = first.isNull() | (F.col("step") > first["step"])
    return known.select("source", "step", "source_size", "target", F.when(full, F.lit(most)).otherwise(first["c"] * F.col("pref")).alias("rate"))


def _rank_key(p: Column, u: Column) -> Column:
    """q / (1 + q) of the Pareto rank q: the same order, between 0 and 1."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def sized(docs: DataFrame, preference: Column | None = None, *more: Column) -> DataFrame:
    """(doc_id, source, size, mark, step) of ``docs`` (doc_id, source, text), and ``more`` columns."""
    size = word_count(F.col("text"))
    wanted = F.sqrt(size) if preference is None else preference.cast("double")
    step = F.when(wanted > 0, F.greatest(F.least(F.round(F.log2(wanted) * STEPS), F.lit(MOST_STEP)), F.lit(LEAST_STEP))).otherwise(LEAST_STEP)
    return docs.select(*more, "doc_id", "source", size.alias("size"), _number(F.coalesce(F.col("text"), F.lit("")), 15).alias("mark"), step.cast("int").alias("step"))


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's digest as a number."""
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(digits)), 16, 10).cast("long")


def _plans(docs: DataFrame, targets: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """``docs`` (as ``sized`` gives them) with certain copies and, where a copy more is possible, the rank key and its whole number."""
    sums = sized_broadcast(targets.withColumnRenamed("source", "target_source"))
    joined = docs.join(sums, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    rates = sized_broadcast(rates.select(F.col("source").alias("rate_source"), F.col("step").alias("rate_step"), "rate"))
    joined = joined.join(rates, F.col("source").eqNullSafe(F.col("rate_source")) & (F.col("step") == F.col("rate_step")) & (F.col("size") > 0), "left").drop("rate_source", "rate_step")
    u = (_number(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "mark", F.lit(seed)), 13).cast("double") + 0.5) / F.lit(float(1 << 52))
    rate = F.coalesce("rate", F.lit(0.0))
    p = rate - F.floor(rate)
    planned = joined.withColumn("whole", F.floor(rate).cast("int")).withColumn("key", F.when(p > 0, _rank_key(p, u))).drop("rate")
    return planned.withColumn("rank", F.least(F.floor(F.col("key") * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long"))


def _reached(sums: DataFrame) -> DataFrame:
    """Of (source, rest, before, bin, words) the first bin of each source in which ``rest`` is exceeded, and the words before it."""
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = sums.withColumn("upto", upto).filter("upto > rest")
    return found.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("b"), F.first("rest").alias("rest")).select("source", "rest", "b.bin", "b.before")


def plan_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, range_bits: int = RANGE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``docs`` (as ``sized`` gives them): targets, rates, and cuts, which has one row for each source: where its sample ends (``end_``, of whose ``n`` equal rows ``take`` are in it) and the row that closes the gap (``close_``)."""
    targets = materialize(source_targets(docs, weights, share, most), "mix-targets")
    rates = materialize(inclusion_rates(docs, targets, most), "mix-rates")
    plans = _plans(docs, targets, rates, seed)
    wide, fine = RANK_BITS - range_bits, RANK_BITS - 2 * range_bits
    certain = plans.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("rest"), F.lit(0).cast("long").alias("before"))
    sums = plans.filter("key is not null").groupBy("source", F.shiftright("rank", wide).alias("bin")).agg(F.sum("size").alias("words"))
    by_source = lambda rows, other: rows.join(sized_broadcast(other.withColumnRenamed("source", "edge_source")), F.col("source").eqNullSafe(F.col("edge_source"))).drop("edge_source")
    edge = materialize(_reached(by_source(sums, materialize(certain, "mix-rests"))).withColumnRenamed("bin", "top"), "mix-edges")
    inside = by_source(plans.filter("key is not null"), edge).filter(F.shiftright("rank", wide) == F.col("top"))
    sums = inside.groupBy("source", "rest", "before", F.shiftright("rank", fine).alias("bin")).agg(F.sum("size").alias("words"))
    edge = materialize(_reached(sums).withColumnRenamed("bin", "low"), "mix-edges")
    inside = by_source(plans.filter("key is not null"), edge).filter(F.shiftright("rank", fine) == F.col("low"))
    same = inside.groupBy("source", "rest", "before", *ROW).agg(F.count("*").alias("n"))
    run = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy(*ROW).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = same.withColumn("run", run).withColumn("take", F.greatest(F.least(F.floor((F.col("rest") - F.col("run")) / F.col("size")), F.col("n")), F.lit(0)))
    ends = fits.filter("take < n").groupBy("source").agg(F.min(F.struct(*ROW, "take", "n", "run", "rest")).alias("e"))
    missing = F.col("e.rest") - F.col("e.run") - F.col("e.take") * F.col("e.size")
    ends = materialize(ends.select("source", *(F.col(f"e.{c}").alias(f"end_{c}") for c in (*ROW, "take", "n")), missing.alias("missing")), "mix-ends")
    # rows left out, of which the one nearest in size to what is missing closes the gap
    left = by_source(plans.filter("key is not null"), ends).filter(F.struct(*ROW) >= F.struct(*(f"end_{c}" for c in ROW))).filter((F.col("missing") > 0) & (F.col("size") <= 2 * F.col("missing")))
    off = F.abs(F.col("missing") - F.col("size"))
    closing = left.groupBy("source").agg(F.min(F.struct(off.alias("off"), *ROW)).alias("c")).select(F.col("source").alias("close_source"), *(F.col(f"c.{c}").alias(f"close_{c}") for c in ROW))
    closing = materialize(closing, "mix-closing")
    counts = plans.filter("key is not null").join(sized_broadcast(closing), F.col("source").eqNullSafe(F.col("close_source")) & _is("close")).groupBy("close_source").agg(F.count("*").alias("close_n")).withColumnRenamed("close_source", "counted")
    closing = closing.join(counts, F.col("close_source").eqNullSafe(F.col("counted"))).drop("counted")
    return targets, rates, materialize(ends.join(closing, F.col("source").eqNullSafe(F.col("close_source")), "left").drop("close_source").withColumnRenamed("source", "cut_source"), "mix-cuts")


def _is(kind: str) -> Column:
    """Whether a row is of the kind that ends a sample, or closes it."""
    return F.col("doc_id").eqNullSafe(F.col(f"{kind}_doc_id")) & F.coalesce((F.col("key") == F.col(f"{kind}_key")) & (F.col("size") == F.col(f"{kind}_size")) & (F.col("mark") == F.col(f"{kind}_mark")), F.lit(False))


def with_copies(docs: DataFrame, targets: DataFrame, rates: DataFrame, cuts: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with source_size, target and copies."""
    joined = _plans(docs, targets, rates, seed).join(sized_broadcast(cuts), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    end, close = _is("end"), _is("close")
    take = F.when(end, F.col("end_take")).otherwise(F.lit(0)) + close.cast("int")
    n = F.when(end, F.col("end_n")).when(close, F.col("close_n"))
    inside = F.struct(*ROW) < F.struct(*(f"end_{c}" for c in ROW))
    # a source whose remainder is never reached has no cut: all its documents are taken
    extra = F.when(F.col("key").isNull(), 0).when(F.col("end_key").isNull() | inside, 1).when(take == 0, 0).when(take >= n, 1)
    cut_columns = [c for c in cuts.columns]
    marked = joined.withColumn("extra", extra).withColumn("__take", take)
    if not cuts.filter("(end_take > 0 and end_take < end_n) or close_n > 1").isEmpty():
        # some of several equal rows are taken: they are numbered, in each partition first, so that no task sees them all
        held = materialize(marked.filter("extra is null").withColumn("__row", F.monotonically_increasing_id()), "mix-equal")
        held = held.withColumn("__part", F.shiftright("__row", 33))
        group = ["source", *ROW]
        counts = held.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*(F.col(c).alias(f"__{c}") for c in (*group, "__part")), before.alias("__before"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, "__part")]
        match = same[0]
        for x in same[1:]:
            match = match & x
        numbered = held.join(sized_broadcast(counts), match).withColumn("__number", F.col("__before") + F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__row")))
        numbered = numbered.withColumn("extra", (F.col("__number") <= F.col("__take")).cast("int")).select(*marked.columns)
        marked = marked.filter("extra is not null").unionByName(numbered)
    return marked.withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")).drop(*cut_columns, "extra", "__take", "whole", "key", "rank")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, preference: Column | str | None = None, seed: int = SEED, range_bits: int = RANGE_BITS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; ``preference`` names a column of expected copies relative to other documents of the source (none: the square root of the words)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    wanted = F.col(f"`{preference}`") if isinstance(preference, str) else preference
    slim = sized(docs, wanted, F.struct(*own).alias("row"))
    plan = plan_copies(materialize(slim.drop("row"), "mix-sizes"), weights, share, most, seed, range_bits)
    taken = with_copies(slim, *plan, seed).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return with_copies(docs, *plan_copies(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, ('0x' || left(md5(coalesce(text, '')), 15))::BIGINT AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, source_size * 2.0 AS cap, row_number() OVER o AS place, coalesce(sum(source_size * 2.0) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s WINDOW o AS (ORDER BY source_size * 2.0 / weight, source NULLS LAST)),
g AS (SELECT *, ((SELECT sum(source_size) * {SHARE} FROM s)::DOUBLE - before) / after AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN place >= (SELECT min(place) FROM g WHERE level * weight < cap) THEN (SELECT arg_min(level, place) FROM g WHERE level * weight < cap) * weight ELSE cap END::DOUBLE AS target FROM g),
p AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN round(log2(sqrt(size)) * {STEPS})::INT END AS step FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT source, step, any_value(target) AS target, sum(size)::DOUBLE AS words, pow(2.0, step / {STEPS}.0) AS pref FROM p WHERE size > 0 GROUP BY source, step),
c AS (SELECT *, greatest((target - {MOST} * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(words * pref) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c FROM w WINDOW o AS (PARTITION BY source ORDER BY step DESC)),
b AS (SELECT *, max(step) FILTER (c * pref < {MOST}) OVER (PARTITION BY source) AS top FROM c),
r AS (SELECT source, step, CASE WHEN top IS NULL OR step > top THEN {MOST} ELSE max(c) FILTER (step = top) OVER (PARTITION BY source) * pref END::DOUBLE AS rate FROM b),
x AS (SELECT p.*, coalesce(rate, 0.0) AS rate, (('0x' || left(md5(concat_ws(' ', coalesce(doc_id::VARCHAR, ''), size, mark, {SEED})), 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u FROM p LEFT JOIN r ON p.source IS NOT DISTINCT FROM r.source AND p.step = r.step),
q AS (SELECT *, floor(rate) AS whole, CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q FROM x),
k AS (SELECT *, q / (1 + q) AS key, target - sum(size * whole) OVER (PARTITION BY source) AS rest FROM q),
n AS (SELECT *, row_number() OVER () AS id, CASE WHEN key IS NOT NULL THEN sum(CASE WHEN key IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id NULLS FIRST, size, mark ROWS UNBOUNDED PRECEDING) <= rest ELSE false END AS taken_ FROM k),
m AS (SELECT *, rest - coalesce(sum(size) FILTER (taken_) OVER (PARTITION BY source), 0) AS missing FROM n),
e AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY abs(missing - size), key, doc_id NULLS FIRST, size, mark) AS z FROM m WHERE NOT taken_ AND key IS NOT NULL AND missing > 0 AND size <= 2 * missing) WHERE z = 1)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN taken_ OR id IN (SELECT id FROM e) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""
