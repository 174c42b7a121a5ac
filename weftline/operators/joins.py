"""Joins to a table of keys, some of which may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side with at most this many narrow rows is broadcast.
BROADCAST_ROWS = 400_000


def counted_join(df: DataFrame, found: DataFrame, on: str | list[str], n: str = "n", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the columns of ``found`` (settled; one row for each key, with a number ``n``, not below that of the rows of ``df`` that have it), null without one.

    Up to ``limit`` keys are broadcast. Of more, those that more than a ``limit``-th of all counted rows have, fewer than ``limit`` by their definition, are broadcast; none of the others is hot, and they join by a shuffle.
    """
    on = [on] if isinstance(on, str) else on
    size = found.agg(F.count("*").alias("keys"), F.coalesce(F.sum(n), F.lit(0)).alias("rows")).first()
    if size["keys"] <= limit:
        return df.join(F.broadcast(found.drop(n)), on, "left")
    hot = F.broadcast(found.filter(F.col(n) > size["rows"] / limit).drop(n))
    rest = found.filter(F.col(n) <= size["rows"] / limit).drop(n)
    return df.join(hot, on).unionByName(df.join(hot.select(*on), on, "left_anti").join(rest, on, "left"))
