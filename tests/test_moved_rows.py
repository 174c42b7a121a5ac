"""How often rows are repeated or moved for intervals and long groups."""

from pyspark.sql import functions as F

from weftline.operators import intervals, sequence


def test_points_of_short_intervals_are_not_repeated(spark, monkeypatch):
    points = spark.range(400).select((F.col("id") % 2).alias("rec"), F.col("id").alias("pos"), (F.col("id") * 0.7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.7 + 3).alias("b"))
    spans = spark.range(60).select((F.col("id") % 2).alias("rec"), F.col("id").alias("n"), (F.col("id") * 4.1).alias("s"), (F.col("id") * 4.1 + F.col("id") % 13).alias("e"))
    found = lambda: intervals.points_in_intervals(points, spans, "rec", [F.col("a"), F.col("b")], "s", "e", 3.0)
    rows = lambda df: sorted((r["pos"], r["n"]) for r in df.collect())
    p, i = [tuple(r) for r in points.collect()], [tuple(r) for r in spans.collect()]
    want = sorted((x[1], y[1]) for x in p for y in i if x[0] == y[0] and any(t is not None and y[2] <= t <= y[3] for t in x[2:]))
    few = found()
    assert rows(few) == want and set(few.columns) == {"rec", "pos", "a", "b", "n", "s", "e"}
    # one row for each bucket of a point: no second generator for the sizes of cells
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    monkeypatch.setattr(intervals, "FEW", 0)
    assert rows(found()) == want


def test_long_groups_are_moved_once(spark):
    words = spark.range(2000).select((F.col("id") % 3).alias("rec"), F.col("id").alias("pos"), (F.col("id") * 0.5).alias("start"), (F.col("id") * 0.5 + 0.2).alias("end"))
    grouped = sequence.gap_groups(words, "rec", "start", "end", 100.0, ["start", "pos"])
    cut = sequence.split_long(grouped, ["rec", "group_no"], "start", "end", 40.0, ["start", "pos"])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    spans = cut.groupBy("rec", "group_no", "part").agg((F.max("end") - F.min("start")).alias("d"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in spans) == 2000 and max(r["d"] for r in spans) <= 40.0
