"""Joins of points and intervals: an equality on the group and on a dyadic cell of time, then the exact condition.

Time is cut into buckets, buckets into cells of 1, 2, 4, 8 ... of them. An interval is the few cells that make it up, at most two of each size, however long it is; a
point is in one cell of each size. So a point and an interval that holds it meet in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of cells go up to two to this power; intervals of more buckets have several of the largest.
LARGEST = 40
#: Where no interval is longer than so many buckets, it is a row for each of them and a point is in one cell: points, of which there are more, are not repeated for each size.
FEW = 8


def dyadic_cells(first: Column, last: Column, largest: int = LARGEST) -> Column:
    """array<struct<level, cell>>: the cells that make up the buckets from ``first`` to ``last``, both included; cell c of level l is the buckets from c * 2^l on, and ``largest`` the highest level."""
    out = []
    for level in range(largest + 1):
        # whole cells of this level inside the buckets; those that do not pair up to larger ones are part of the answer
        lo, hi = -F.shiftright(-first, level), F.shiftright(last + 1, level)
        cell = lambda c, level=level: F.struct(F.lit(level).alias("level"), c.cast("long").alias("cell"))
        if level == largest:
            all_ = F.when(lo < hi, F.transform(F.sequence(lo, F.greatest(hi - 1, lo)), lambda c: F.struct(F.lit(largest).alias("level"), c.cast("long").alias("cell"))))
            whole = F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<struct<level:int,cell:bigint>>")
            return F.concat(whole, F.coalesce(all_, F.array().cast("array<struct<level:int,cell:bigint>>")))
        odd = lo.bitwiseAND(F.lit(1)) == 1
        out.append(F.when((lo < hi) & odd, cell(lo)))
        out.append(F.when((hi.bitwiseAND(F.lit(1)) == 1) & (hi > lo + odd.cast("long")), cell(hi - 1)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: Column | list[Column], start: str, end: str, bucket: float, closed: bool = True) -> DataFrame:
    """All pairs of a point and an interval of the same group that holds it (any of several points, if ``at`` is a list). ``bucket``: the shortest time that is told apart before the exact condition.

    Intervals without a start or an end, and points without a time, are in no pair.
    """
    ats = at if isinstance(at, list) else [at]
    number = lambda x: F.floor(x / F.lit(bucket)).cast("long")
    first, last = number(F.col(start)), number(F.greatest(F.col(start), F.col(end)))
    timed = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    # points only look at sizes that the longest interval can have
    longest = int(timed.agg(F.max(last - first + 1)).first()[0] or 1)
    largest = 0 if longest <= FEW else min(longest.bit_length() - 1, LARGEST)
    i = timed.withColumn("__c", F.explode(dyadic_cells(first, last, largest))).withColumnRenamed(key, "__k")
    i = i.withColumn("__l", F.col("__c.level")).withColumn("__b", F.col("__c.cell")).drop("__c")
    # times and cells are shuffled as numbers, not as arrays
    names = [f"__at{k}" for k in range(len(ats))]
    times = F.filter(F.array(*names), lambda x: x.isNotNull())
    p = points.withColumns(dict(zip(names, ats, strict=True))).withColumn("__pb", F.explode(F.array_distinct(F.transform(times, number))))
    p = p.withColumn("__pl", F.explode(F.array(*(F.lit(n) for n in range(largest + 1))))) if largest else p.withColumn("__pl", F.lit(0))
    p = p.withColumn("__pc", F.expr("shiftright(__pb, __pl)"))
    inside = lambda x: (x >= F.col(start)) & ((x <= F.col(end)) if closed else (x < F.col(end)))
    joined = p.join(i, (F.col(key) == F.col("__k")) & (F.col("__pl") == F.col("__l")) & (F.col("__pc") == F.col("__b")))
    # with several points a pair can meet in several buckets: it counts in the bucket of its first point inside
    hit = F.filter(times, inside)
    return joined.withColumn("__hit", hit).filter((F.size("__hit") > 0) & (number(F.col("__hit")[0]) == F.col("__pb"))).drop(*names, "__pb", "__pl", "__pc", "__l", "__b", "__k", "__hit")


def first_interval(points: DataFrame, intervals: DataFrame, key: str, at, start: str, end: str, bucket: float, point_id: list[str], order: list, closed: bool = True) -> DataFrame:
    """Each point with the first interval (by ``order``) that holds it."""
    pairs = points_in_intervals(points, intervals, key, at, start, end, bucket, closed)
    rank = F.row_number().over(Window.partitionBy(*point_id).orderBy(*order))
    return pairs.withColumn("__r", rank).filter("__r = 1").drop("__r")


def outside_intervals(points: DataFrame, intervals: DataFrame, key: str, at, start: str, end: str, bucket: float, point_id: list[str], closed: bool = True) -> DataFrame:
    """Points that no interval holds."""
    held = points_in_intervals(points, intervals, key, at, start, end, bucket, closed).select(*point_id).distinct()
    return points.join(held, point_id, "left_anti")
