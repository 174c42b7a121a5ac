"""Grouping of timed words into segments: by silence, or by the lines of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import edit
from weftline.operators.intervals import first_interval, points_in_intervals
from weftline.operators.sequence import final_order, gap_groups, split_long
from weftline.sources.scratch import settled

#: Seconds in a bucket of the interval joins.
BUCKET = 30.0


def _timed(words: Column) -> Column:
    return F.transform(words, lambda x: F.struct(F.round(x["start"], 3).alias("time_s"), F.round(x["end"], 3).alias("time_e")))


def _said(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised words of each key in order: reco (array of words) and reco_words."""
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "pos", "end", "word"))).alias("w"))
    return got.select(*keys, F.transform("w", lambda x: x["word"]).alias("reco"), _timed(F.col("w")).alias("reco_words"))


def unaligned_segments(words: DataFrame, gap: float) -> DataFrame:
    """Segments of recognised words (rec, pos, word, start, end) that belong to nothing."""
    grouped = gap_groups(words, "rec", "start", "end", gap, ["start", "pos"])
    said = _said(grouped, ["rec", "group_no"])
    ends = F.col("reco_words")
    return said.select("rec", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("norm"), F.array_join("reco", " ").alias("reco"), ends[0]["time_s"].alias("start"), F.element_at(ends, -1)["time_e"].alias("end"), "reco_words", F.lit("only in reco").alias("match_error"))


def by_silence(ali: DataFrame, reco: DataFrame, gap: float = 2.0, longest: float | None = None) -> DataFrame:
    """Segments of aligned words (rec, pos, word, start, end) divided where it is silent, with the recognised words that begin or end inside, errors, and segments of those left over; ``place`` numbers them by start."""
    order = ["start", "pos"]
    grouped = gap_groups(ali, "rec", "start", "end", gap, order)
    grouped = split_long(grouped, ["rec", "group_no"], "start", "end", longest, order) if longest and longest > 0 else grouped.withColumn("part", F.lit(0))
    rows = grouped.groupBy("rec", "group_no", "part").agg(F.sort_array(F.collect_list(F.struct("start", "pos", "end", "word"))).alias("w"))
    segs = rows.select("rec", "group_no", "part", F.transform("w", lambda x: x["word"]).alias("norm_w"), _timed(F.col("w")).alias("words"))
    segs = settled(segs.withColumn("seg_start", F.col("words")[0]["time_s"]).withColumn("seg_end", F.element_at("words", -1)["time_e"]))
    spans = segs.select("rec", "group_no", "part", "seg_start", "seg_end")
    points = [F.col("start"), F.col("end")]
    held = settled(first_interval(reco, spans, "rec", points, "seg_start", "seg_end", BUCKET, ["rec", "pos"], ["seg_start", "group_no", "part"]))
    said = _said(held, ["rec", "group_no", "part"])
    full = edit.with_errors(edit.spread(segs.join(said, ["rec", "group_no", "part"], "left").withColumn("reco", F.coalesce("reco", F.array().cast("array<string>")))), "norm_w", "reco")
    done = full.select("rec", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"), F.array_join("norm_w", " ").alias("norm"), F.array_join("reco", " ").alias("reco"), F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "reco_words", F.lit(None).cast("string").alias("match_error"), "errors", F.lit(False).alias("unaligned"))
    rest = reco.join(held.select("rec", "pos"), ["rec", "pos"], "left_anti")
    all_ = done.unionByName(unaligned_segments(rest, gap).withColumn("unaligned", F.lit(True)), allowMissingColumns=True)
    return final_order(all_, "rec", "start", ["unaligned", "end"])


def by_lines(ali: DataFrame, reco: DataFrame, lines: DataFrame, gap: float = 2.0, worst_cer: float = float("inf"), all_matches: bool = True) -> DataFrame:
    """Segments of the reference's lines.

    ``ali``: rec, norm_pos, word, start, end; ``reco``: rec, pos, word, start, end; ``lines``: rec, line, id, text, words (of the normalised text) and, as an
    array of structs s, e, normoff. A recognised word goes to every line (or, without ``all_matches``, the first) whose time holds its midpoint; lines at ``worst_cer`` or above lose
    their words to the left-over segments. ``place`` numbers the segments by start; those without one come as if they began at 0.
    """
    before = F.coalesce(F.sum(F.size("words")).over(Window.partitionBy("rec").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the sum must be over lines: a window beside a generator would see its rows
    places = lines.select("rec", "line", before.alias("b"), "normoff").select("rec", "line", "b", F.posexplode("normoff").alias("i", "o")).select("rec", (F.col("b") + F.col("i")).alias("norm_pos"), "line", F.col("o.s").alias("char_s"), F.col("o.e").alias("char_e"))
    placed = ali.join(places, ["rec", "norm_pos"]).groupBy("rec", "line").agg(F.sort_array(F.collect_list(F.struct("start", "norm_pos", "end", "word", "char_s", "char_e"))).alias("w"))
    words = F.transform("w", lambda x: F.struct(F.round(x["start"], 3).alias("time_s"), F.round(x["end"], 3).alias("time_e"), x["char_s"].alias("char_s"), x["char_e"].alias("char_e")))
    timed = placed.select("rec", "line", F.transform("w", lambda x: x["word"]).alias("norm_w"), words.alias("words_t")).withColumn("seg_start", F.col("words_t")[0]["time_s"]).withColumn("seg_end", F.element_at("words_t", -1)["time_e"])
    timed = settled(timed)
    spans = timed.select("rec", "line", "seg_start", "seg_end")
    middle = (F.col("start") + F.col("end")) / 2
    inside = settled(points_in_intervals(reco, spans, "rec", middle, "seg_start", "seg_end", BUCKET) if all_matches else first_interval(reco, spans, "rec", middle, "seg_start", "seg_end", BUCKET, ["rec", "pos"], ["line"]))
    scored = edit.with_errors(edit.spread(timed.join(_said(inside, ["rec", "line"]), ["rec", "line"], "left")), "norm_w", "reco")
    heard = F.col("reco").isNotNull()
    bad = heard & (F.col("errors.cer") >= worst_cer)
    scored = settled(scored)
    full = lines.select("rec", "line", "id", "text").join(scored.withColumn("bad", bad), ["rec", "line"], "left")
    keep = lambda c: F.when(heard & ~F.col("bad"), c)
    norm = F.when(F.col("norm_w").isNotNull() & ~F.coalesce("bad", F.lit(False)), F.array_join("norm_w", " "))
    done = full.select("rec", "line", "id", "text", norm.alias("norm"), keep(F.array_join("reco", " ")).alias("reco"), F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.col("words_t").alias("words"), keep(F.col("reco_words")).alias("reco_words"), keep(F.col("errors")).alias("errors"))
    done = done.withColumn("match_error", F.when(F.col("norm").isNull(), "only in reference"))
    rest = reco.join(inside.select("rec", "pos"), ["rec", "pos"], "left_anti")
    freed = inside.join(scored.filter(bad).select("rec", "line"), ["rec", "line"], "left_semi").select(*reco.columns)
    all_ = done.unionByName(unaligned_segments(rest.unionByName(freed), gap), allowMissingColumns=True)
    return final_order(all_, "rec", "start", [F.col("line").asc_nulls_last(), "end"])
