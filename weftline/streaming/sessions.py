"""Silence grouping of a stream of timed words.

A session window closes once the watermark is ``gap`` past its last word. It compares starts with starts, so it equals
the batch grouping for words that are points in time; ``exact_groups`` compares each start with the end before it, as the batch operator does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_groups(words: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions, once they are closed."""
    sessions = words.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return sessions.agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end")).select(key, "start", "end", "n")


def exact_groups(words: DataFrame, key: str, at: str, start: str, end: str, gap: float, late: str) -> DataFrame:
    """(key, start, end, n): groups of words in order of arrival, by ``start - last end > gap``. ``at`` is the event time; a group is given out when the next begins or the watermark passes it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = words.schema[key].dataType.simpleString()

    def run(k, frames: Iterator, state: "GroupState"):
        import pandas as pd

        out = []
        if state.hasTimedOut:
            out.append((k[0], *state.get))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values([start, end])
            group = state.get if state.exists else None
            for s, e in zip(rows[start], rows[end], strict=True):
                if group is not None and s - group[1] > gap:
                    out.append((k[0], *group))
                    group = None
                group = (float(s), float(e), 1) if group is None else (group[0], float(e), group[2] + 1)
            state.update(group)
            latest = int(rows[at].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + int(gap * 1000) + 1)
        yield pd.DataFrame(out, columns=[key, "start", "end", "n"])

    return words.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, start double, end double, n long", "start double, end double, n long", "append", GroupStateTimeout.EventTimeTimeout)
