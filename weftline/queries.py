"""Registered queries of the library's operators over the shared tables, and the SQL they are held against.

Roles: ``documents`` are reference transcripts, ``benchmark`` and ``conversations`` recognised texts, ``events`` timed
words or intervals of a user, ``embeddings`` frames of scores. Times are whole microseconds, so that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import edit_sql
from weftline.functions import text as tx
from weftline.operators import edit, intervals, joins, matching, resegment, sequence, stats, viterbi
from weftline.sources import readers, sinks
from weftline.sources.scratch import scratch, settled

SECOND = 1_000_000
#: Thresholds that suit the events table, whose words are hours apart.
GAP = 6 * 3600 * SECOND
LONGEST = 24 * 3600 * SECOND
SIGN_CHARS = r"[^\p{L}\p{N}_]"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    """(rec, pos, kind, s, e): intervals of ``value`` seconds from each event on."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return _t(spark, d, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), at.alias("s"), (at + F.round(F.col("value") * 100).cast("long") * F.lit(SECOND)).alias("e"))


EVENTS = "ev AS (SELECT user_id AS rec, event_id AS pos, event_type AS kind, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 1000000 AS e FROM events)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\[[^\]]*\]', ' ', 'g'), '/[^/]*/', ' ', 'g')), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"""


def _blank_sql(x: str, pattern: str) -> str:
    """Each match as long a run of spaces as it has characters."""
    return f"list_aggregate(list_transform(generate_series(1, len(regexp_split_to_array({x}, '{pattern}'))), lambda i: regexp_split_to_array({x}, '{pattern}')[i] || repeat(' ', coalesce(length(regexp_extract_all({x}, '{pattern}')[i]), 0))), 'string_agg', '')"


def _tokens(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.array_remove(F.split(tx.normalized(F.col("text")), " "), "").alias("w"))


def _words_sql(table: str, keys: str) -> str:
    return f"SELECT {keys}, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS w FROM {table}"


GRAMS = "unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE []::VARCHAR[] END)"

OLDER_GRAMS = GRAMS.replace("> 2", "> 3").replace("len(w) - 1)", "len(w) - 2)")


def norm_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.normalized(F.col("text")).alias("norm"))


def norm_offsets(spark, d):
    return tx.placed_words(_t(spark, d, "documents"), ["doc_id"], F.col("text"))


def blanked(spark, d):
    """Texts with brackets and slashes put in: what is erased keeps its length."""
    head = F.concat(F.lit("["), F.left("text", F.lit(5)), F.lit("] "), F.replace(F.left("text", F.lit(60)), F.lit(" "), F.lit(" /x [y/ ")), F.col("text"))
    rows = _t(spark, d, "documents").select("doc_id", tx.spaced(head).alias("x"))
    # the blanked text is worked out once; its words joined by single spaces are what ``tx.normalized`` gives
    return rows.select("doc_id", F.trim(F.regexp_replace("x", " +", " ")).alias("norm"), F.length("x").cast("long").alias("n"), F.length(F.rtrim("x")).cast("long").alias("last"))


def vocab_ids(spark, d):
    words = _tokens(_t(spark, d, "documents")).select(F.explode("w").alias("word")).distinct()
    return sequence.ordered_ids(words, F.col("word"))


def encode_oov(spark, d):
    vocab = vocab_ids(spark, d)
    said = _tokens(_t(spark, d, "benchmark"), "item_id").select("item_id", F.posexplode("w").alias("pos", "word"))
    return said.join(vocab, "word", "left").select("item_id", F.col("pos").cast("long").alias("pos"), F.coalesce("id", F.lit(0).cast("long")).alias("id"))


def _index(spark, d, said, compat=False):
    """The n-grams of ``said`` in the documents."""
    return matching.ngram_index(_tokens(_t(spark, d, "documents"), "doc_id"), "doc_id", "w", compat=compat, asked=matching.asked_grams(said, "w", compat=compat))


def ngram_doc_match_top10(spark, d):
    items = _tokens(_t(spark, d, "benchmark"), "item_id")
    found = matching.document_scores(items, "item_id", "w", _index(spark, d, items))
    return found.select(F.col("rec").alias("item_id"), F.col("doc").alias("doc_id"), "hits", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def ngram_best_document(spark, d):
    """By the older count, which leaves out a text's last n-gram."""
    items = _tokens(_t(spark, d, "benchmark"), "item_id")
    found = matching.best_document(items, "item_id", "w", _index(spark, d, items, compat=True), compat=True)
    return found.select(F.col("rec").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


def ngram_all_scores(spark, d):
    items, docs = _tokens(_t(spark, d, "benchmark"), "item_id"), _t(spark, d, "documents")
    found = matching.found_scores(items, "item_id", "w", _index(spark, d, items))
    best = found.groupBy(F.col("rec").alias("item_id")).agg(F.count("*").alias("found"), F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("doc_id"), F.max("score").alias("score"))
    total = docs.agg(F.count_distinct("doc_id").alias("documents"))
    rows = items.select("item_id").join(best, "item_id", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("item_id", "documents", F.coalesce("found", F.lit(0).cast("long")).alias("found"), "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def segment_vote(spark, d):
    said = _tokens(_t(spark, d, "conversations"), "conv_id", "turn")
    found = matching.segment_votes(said, "conv_id", "turn", "w", _index(spark, d, said))
    return found.select(F.col("rec").alias("conv_id"), F.col("doc").alias("doc_id"), "votes", F.round("share", 9).alias("share"))


def gap_segments(spark, d):
    grouped = sequence.gap_groups(_events(spark, d), "rec", "s", "e", GAP, ["s", "pos"])
    return grouped.groupBy("rec", "group_no").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def gap_chunks(spark, d):
    from pyspark.sql import Window

    numbered = _events(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("rec").orderBy("s", "pos")).cast("long") - 1)
    return sequence.gap_chunks(numbered, "rec", "n", "s", "e", GAP, 2, 5)


def fixed_chunks(spark, d):
    cut = sequence.fixed_chunks(_tokens(_t(spark, d, "conversations"), "conv_id", "turn"), "w", 20, 15)
    return cut.select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"), F.array_join("words", " ").alias("said"))


def interval_union(spark, d):
    return sequence.interval_union(_events(spark, d), "rec", "s", "e", 900 * SECOND).select("rec", "island", "start", "end", "before")


def voiced_time_map(spark, d):
    ev = _events(spark, d)
    islands = sequence.interval_union(ev, "rec", "s", "e", 0)
    total = islands.groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    times = total.select("rec", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"), "total").select("rec", F.col("k").cast("long").alias("k"), F.expr("total * k div 10").alias("at"))
    return sequence.restore_time(times, islands, "rec", "at").select("rec", "k", "restored")


def greedy_nonoverlap(spark, d):
    return sequence.greedy_keep(_events(spark, d), "rec", "s", "e", ["s", "pos"]).select("rec", "pos", "s", "e")


def greedy_apart(spark, d):
    return sequence.greedy_keep(_events(spark, d), "rec", "s", "e", ["s", "pos"], touching=False).select("rec", "pos", "s", "e")


def max_len_split(spark, d):
    grouped = sequence.gap_groups(_events(spark, d), "rec", "s", "e", GAP, ["s", "pos"])
    parts = sequence.split_long(grouped, ["rec", "group_no"], "s", "e", LONGEST, ["s", "pos"])
    return parts.groupBy("rec", "group_no", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).withColumn("part", F.col("part").cast("long"))


def _spans_points(spark, d):
    ev = _events(spark, d)
    spans = ev.filter("kind = 'purchase'").select("rec", F.col("pos").alias("span"), F.col("s").alias("b"), F.col("e").alias("f"))
    return spans, ev.filter("kind <> 'purchase'").select("rec", "pos", "s", "e")


def point_in_interval_all(spark, d):
    spans, points = _spans_points(spark, d)
    return intervals.points_in_intervals(points, spans, "rec", F.expr("(s + e) div 2"), "b", "f", 3600 * SECOND).select("rec", "pos", "span")


def point_in_interval_first(spark, d):
    spans, points = _spans_points(spark, d)
    return intervals.first_interval(points, spans, "rec", F.expr("(s + e) div 2"), "b", "f", 3600 * SECOND, ["rec", "pos"], ["b", "span"]).select("rec", "pos", "span")


def point_in_interval_half_open(spark, d):
    spans, points = _spans_points(spark, d)
    return intervals.points_in_intervals(points, spans, "rec", F.col("s"), "b", "f", 3600 * SECOND, closed=False).select("rec", "pos", "span")


def point_in_interval_start_or_end(spark, d):
    spans, points = _spans_points(spark, d)
    return intervals.first_interval(points, spans, "rec", [F.col("s"), F.col("e")], "b", "f", 3600 * SECOND, ["rec", "pos"], ["b", "span"]).select("rec", "pos", "span")


def unmatched(spark, d):
    spans, points = _spans_points(spark, d)
    return intervals.outside_intervals(points, spans, "rec", F.expr("(s + e) div 2"), "b", "f", 3600 * SECOND, ["rec", "pos"]).select("rec", "pos")


def _match_segments(spark, d):
    """Ranges on two sides made of the events: rank within the user, and twice that on the other side."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("rec").orderBy("s", "pos")).cast("long")
    ev = _events(spark, d).withColumn("r", rank)
    segs = ev.filter("kind = 'click'").select("rec", F.col("r").alias("reco_beg"), (F.col("r") + 1).alias("reco_end"), (F.col("r") * 2).alias("norm_beg"), (F.col("r") * 2 + 1).alias("norm_end"))
    return segs, ev.groupBy("rec").agg((F.max("r") + 3).alias("n_reco"), (F.max("r") * 2 + 4).alias("n_norm"))


def gaps_between(spark, d):
    return sequence.gaps_between(*_match_segments(spark, d), "rec")


def coverage(spark, d):
    segs, lengths = _match_segments(spark, d)
    return stats.coverage(segs, lengths, "rec", "reco_beg", "reco_end", "n_reco").select("rec", F.round("covered", 9).alias("covered"))


def overlap_check(spark, d):
    return sequence.overlaps(_events(spark, d), "rec", "s", "e").select("rec", "pos", "previous_end")


def _pairs(spark, d):
    """Each benchmark item with its best document: chunks, corpus words, corpus texts."""
    items = _tokens(_t(spark, d, "benchmark"), "item_id")
    best = settled(matching.document_scores(items, "item_id", "w", _index(spark, d, items), top=1).select(F.col("rec").alias("item_id"), F.col("doc").alias("doc_id")))
    chunks = settled(best.join(items, "item_id").select(F.col("item_id").alias("rec"), F.lit(0).alias("chunk"), F.col("w").alias("words")))
    # joined before they are taken apart: few documents are the best of an item
    texts = settled(_tokens(_t(spark, d, "documents").join(F.broadcast(best), "doc_id") if best.count() <= joins.BROADCAST_ROWS else _t(spark, d, "documents").join(best, "doc_id"), "item_id").select(F.col("item_id").alias("rec"), F.col("w").alias("words")))
    return chunks, texts.select("rec", F.posexplode("words").alias("pos", "word")), texts


def bow_candidates(spark, d):
    chunks, corpus, _ = _pairs(spark, d)
    return matching.candidates(chunks, corpus, many=1 << 40).select(F.col("rec").alias("item_id"), F.col("beg").cast("long").alias("beg"), F.col("count").cast("long").alias("hits"))


def bow_candidates_many(spark, d):
    """With more than three windows near the best only those at 0.99 of it stay."""
    chunks, corpus, _ = _pairs(spark, d)
    return matching.candidates(chunks, corpus, many=3).select(F.col("rec").alias("item_id"), F.col("beg").cast("long").alias("beg"), F.col("count").cast("long").alias("hits"))


def best_window(spark, d):
    return matching.best_windows(*_pairs(spark, d)).select(F.col("rec").alias("item_id"), F.col("beg").cast("long").alias("beg"), "end", "distance", F.round("relative", 9).alias("relative"))


def window_errors(spark, d):
    """Word and character errors of each best window, and the part between its first and last right words."""
    chunks, corpus, texts = _pairs(spark, d)
    best = matching.best_windows(chunks, corpus, texts)
    rows = best.join(texts, "rec").select("rec", "beg", F.slice("words", (F.col("beg") + 1).cast("int"), (F.col("end") - F.col("beg")).cast("int")).alias("norm")).join(chunks.select("rec", F.col("words").alias("said")), "rec")
    out = edit.with_trim(edit.with_errors(rows, "norm", "said"), "norm", "said")
    count = lambda c: F.col(c).cast("long").alias(c.rsplit(".")[-1])
    return out.select(F.col("rec").alias("item_id"), *(count(f"errors.{c}") for c in ("delete", "insert", "replace", "num", "corr")), "errors.wer", "errors.cer", tx.error_bucket(F.col("errors.wer")).alias("bucket"), F.col("trim.a_beg").cast("long").alias("beg"), F.col("trim.a_end").cast("long").alias("end"))


def cer_pairs(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("said"))
    dist = F.levenshtein("p_name", "said")
    return p.join(other, "p_partkey").select("p_partkey", dist.cast("long").alias("distance"), F.round(dist / F.length("p_name"), 9).alias("cer"), tx.error_bucket(dist / F.length("p_name")).alias("bucket"))


def rms_db(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(tx.decibels(F.col("embedding")), 6).alias("db"))


def energy_filter(spark, d):
    floor = -18.1
    return _t(spark, d, "embeddings").select("vec_id", tx.decibels(F.col("embedding")).alias("rms")).filter(F.col("rms") >= floor).select("vec_id")


def context_chunks(spark, d):
    rows = sequence.context_chunks(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 20, 4, 2)
    return rows.select("vec_id", *(F.col(c).cast("long").alias(c) for c in ("chunk", "beg", "end", "own_beg", "own_end")))


def _frames(spark, d):
    """Fifty vectors make a recording; the greatest component of a vector is its label."""
    v = _t(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("rec"), (F.col("vec_id") % 50).cast("int").alias("t"), F.col("embedding").alias("scores"))
    return v.withColumn("label", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


def label_runs(spark, d):
    return sequence.runs(_frames(spark, d), "rec", "t", "label").select("rec", *(F.col(c).cast("long").alias(c) for c in ("run", "label", "beg", "end")))


def greedy_labels(spark, d):
    found = sequence.collapsed(_frames(spark, d), "rec", "t", "label", 0)
    return found.select("rec", F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


def viterbi_words(spark, d):
    f = _frames(spark, d)
    labels = f.select("rec").distinct().select("rec", F.array(*(F.lit(x) for x in (4, 1, 2, 4, 3, 5, 4))).alias("labels"), F.array(F.lit("ab"), F.lit("ce")).alias("words"))
    return viterbi.align(f, labels, "rec").withColumn("pos", F.col("pos").cast("long"))


def _ref_lines(spark, d):
    """Turns as reference lines, their words half a second apart, and recognised words that drop every tenth and misspell every seventh."""
    lines = _t(spark, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("line"), F.format_string("c%d_%d", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = lines.withColumn("words", F.array_remove(F.split(tx.normalized(F.col("text")), " "), ""))
    # the places of the words in the normalised text
    lines = lines.withColumn("normoff", F.transform(tx.word_offsets(F.array_join("words", " ")), lambda o: F.struct(o["beg"].cast("int").alias("s"), o["end"].cast("int").alias("e"))))
    from pyspark.sql import Window

    order = Window.partitionBy("rec").orderBy("line", "i")
    lines = settled(lines)
    said = lines.select("rec", "line", F.posexplode("words").alias("i", "word")).withColumn("pos", F.row_number().over(order) - 1)
    said = settled(said.select("rec", "pos", "word", (F.col("pos") * 0.5).alias("start"), (F.col("pos") * 0.5 + 0.25).alias("end")))
    reco = said.filter("pos % 10 <> 3").withColumn("word", F.when(F.col("pos") % 7 == 0, F.concat("word", F.lit("x"))).otherwise(F.col("word")))
    return lines, said.filter("pos % 31 <> 5").select("rec", F.col("pos").alias("norm_pos"), "word", "start", "end"), reco


def resegment_lines(spark, d):
    lines, ali, reco = _ref_lines(spark, d)
    out = resegment.by_lines(ali, reco, lines)
    return out.select("rec", "id", "norm", "reco", "start", "end", F.size("words").cast("long").alias("n_words"), "errors.wer", "errors.cer", "match_error", "place")


def segment_stats(spark, d):
    lines, ali, reco = _ref_lines(spark, d)
    return stats.file_statistics(resegment.by_lines(ali, reco, lines, worst_cer=0.5), "rec")


def silence_segments(spark, d):
    _, ali, reco = _ref_lines(spark, d)
    out = resegment.by_silence(ali.withColumnRenamed("norm_pos", "pos"), reco, gap=0.6, longest=10.0)
    return out.select("rec", "norm", "reco", "start", "end", "errors.wer", "errors.cer", "unaligned", "place")


def total_length(spark, d):
    return stats.total_length(_events(spark, d), F.col("e") - F.col("s"))


def merged_islands(spark, d):
    """Intervals less than two hours apart become one; those under half an hour go."""
    return sequence.merged_islands(_events(spark, d), "rec", "s", "e", 7200 * SECOND, 1800 * SECOND)


def energy_islands(spark, d):
    """Frames of each recording that reach a level, as islands."""
    v = _t(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("rec"), (F.col("vec_id") % 50).alias("t"), tx.decibels(F.col("embedding")).alias("db"))
    return sequence.energy_islands(v, "rec", "t", "db", -18.1)


def padded_batches(spark, d):
    """Turns of a conversation, four at a time, as lengths of words padded to the longest turn."""
    turns = _tokens(_t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.transform("w", F.length).alias("x"))
    rows = sinks.padded_batches(turns, "conv_id", ["turn"], "x", 4, -1)
    return rows.select("conv_id", "turn", "batch", F.array_join("x", " ").alias("x"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).cast("long").alias("real"))


def char_trim(spark, d):
    """The part of each item between the first and the last three equal characters of it and its best window."""
    chunks, corpus, texts = _pairs(spark, d)
    best = matching.best_windows(chunks, corpus, texts)
    rows = best.join(texts, "rec").select("rec", F.slice("words", (F.col("beg") + 1).cast("int"), (F.col("end") - F.col("beg")).cast("int")).alias("norm")).join(chunks.select("rec", F.col("words").alias("said")), "rec")
    return edit.with_char_trim(rows, "norm", "said").select(F.col("rec").alias("item_id"), "trim.*")


def merged_frames(spark, d):
    """Vectors cut into chunks with context and put together again from the chunks' own parts."""
    cut = sequence.context_chunks(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 20, 4, 2)
    frames = cut.select("vec_id", "chunk", "beg", "own_beg", "own_end", F.posexplode(F.slice("embedding", F.col("beg") + 1, F.col("end") - F.col("beg"))).alias("i", "v"))
    return sequence.merged_chunks(frames, "vec_id", "chunk", "i", "own_beg", "own_end").select("vec_id", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))


def decoded_words(spark, d):
    """Items' words as ids and back; words that no document has become <unk>."""
    vocab = vocab_ids(spark, d)
    said = _tokens(_t(spark, d, "benchmark"), "item_id").select("item_id", F.posexplode("w").alias("pos", "word"))
    said = said.withColumn("word", F.when(F.col("pos") % 9 == 4, F.concat("word", F.lit("\u00a7"))).otherwise(F.col("word")))
    ids = stats.encoded(said, vocab).drop("word")
    return stats.decoded(ids, vocab).select("item_id", F.col("pos").cast("long").alias("pos"), "word")


def text_helpers(spark, d):
    """Bare words, frame numbers, marked spans, label numbers and the first reading of an item."""
    ids = F.create_map(*(F.lit(x) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz") for x in (c, k + 5)))
    t, i = F.col("text"), F.col("item_id")
    labels = tx.labels_of(F.regexp_replace(F.lower(t), "[^a-z ]", ""), ids, 4)
    return _t(spark, d, "benchmark").select("item_id", F.array_join(tx.bare_words(t), " ").alias("bare"), tx.frame_of(i * 0.37, 50.0).cast("long").alias("frame"), tx.highlighted(t, (i % 5).cast("int"), (i % 5 + 3).cast("int")).alias("marked"), F.array_join(labels, " ").alias("labels"), tx.first_beam(F.split(t, " ")).alias("best"), tx.midpoint(i, i * 2).alias("middle"))


def byte_ranges(spark, d):
    """Slices of the pages by four kinds of range requests."""
    header = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("bytes="), F.col("page_id").cast("string"), F.lit("-"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("bytes=10-"), (F.col("page_id") + 20).cast("string"))).when(F.col("page_id") % 4 == 2, F.lit("bytes=-50")).otherwise(F.lit(None).cast("string"))
    pages = _t(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), header.alias("header"))
    cut = pages.withColumn("r", tx.byte_range(F.col("header"), F.octet_length("body").cast("bigint")))
    return cut.select("page_id", "r.begin", "r.end", F.col("r.status").cast("long").alias("status"), F.sha2(F.substring(F.col("body"), (F.col("r.begin") + 1).cast("int"), (F.col("r.end") - F.col("r.begin")).cast("int")), 256).alias("sha"))


def norm_json_files(spark, d):
    """Normalised turns, one JSON file for each conversation, written and read back as words numbered through the conversation."""
    path = scratch(spark, "norm")
    offsets = F.transform(tx.word_offsets(F.col("text")), lambda o: F.array(o["beg"], o["end"]))
    lines = _t(spark, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("line"), F.format_string("c%d_%d", "conv_id", "turn").alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    lines = lines.withColumn("norm", tx.normalized(F.col("text"))).withColumn("normoff", offsets)
    sinks.write_json_documents(lines, "rec", ["line", "uid"], ["uid", "text", "norm", "normoff"], path)
    found = readers.line_words(readers.normalised_lines(spark, path))
    return found.select("rec", *(F.col(c).cast("long").alias(c) for c in ("pos", "line")), "word")


def recognition_files(spark, d):
    """Turns as recognised segments whose words are half a second apart, written as recognition records and read back as words with absolute times."""
    path = scratch(spark, "recognised")
    turns = _tokens(_t(spark, d, "conversations"), "conv_id", "turn").filter(F.size("w") > 0)
    begin = F.col("turn") * 1000.0
    timed = F.transform("w", lambda x, i: F.struct(x.alias("word"), (begin + i * 0.5).alias("start"), (begin + i * 0.5 + 0.25).alias("end")))
    segs = turns.select(F.col("conv_id").alias("rec"), F.format_string("seg_%04d", "turn").alias("seg"), F.lit(16000.0).alias("samp_freq"), F.size("w").cast("long").alias("length"), F.lit(-20.0).alias("rms"), begin.alias("start"), (begin + F.size("w") * 0.5).alias("end"), timed.alias("words"))
    sinks.write_recognition(segs, path)
    return readers.recognised_map(spark, path).select("rec", "seg", F.col("pos").cast("long").alias("pos"), "word", "start", "end")


def logits_files(spark, d):
    path = scratch(spark, "logits")
    sinks.write_logits(_t(spark, d, "embeddings").select(F.expr("cast(vec_id div 50 as string)").alias("rec_id"), (F.col("vec_id") % 50).cast("int").alias("t"), F.col("embedding").alias("logits")), path)
    return readers.logits(spark, path).select("rec_id", F.col("t").cast("long").alias("t"), F.size("logits").cast("long").alias("n"), F.aggregate("logits", F.lit(0.0), lambda a, x: a * 0.5 + x.cast("double")).alias("mixed"))


def vocabulary_files(spark, d):
    path = scratch(spark, "vocabulary")
    sinks.write_vocabulary(vocab_ids(spark, d), path)
    return readers.vocabulary(spark, path).select(F.col("id").cast("long").alias("id"), "word")


def word_list_files(spark, d):
    path = scratch(spark, "words")
    sinks.write_lines(stats.unigram_list(_tokens(_t(spark, d, "benchmark")), "w"), "word", path)
    return readers.word_list(spark, path)


def voiced_files(spark, d):
    """Voiced segments as JSON lines without their samples, read back, those under the floor left out."""
    path = scratch(spark, "voiced")
    rows = _t(spark, d, "events").select(F.format_string("u%d_seg_%04d", "user_id", "event_id").alias("id"), F.format_string("u%d", "user_id").alias("reco_id"), F.lit(16000).alias("samp_freq"), F.col("event_id").cast("int").alias("length"), (-F.col("event_id") % 60).cast("double").alias("rms"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 0.5).cast("double").alias("end"), F.array(F.lit(0.0)).alias("input_values"))
    sinks.write_json(rows, path, ["input_values"])
    return readers.energy_filter(readers.voiced_segments(spark, path)).select("id", "reco_id", F.col("length").cast("long").alias("length"), "rms", "start", "end")


def transcript_files(spark, d):
    """Turns as lines "uid TAB text", every seventh without a TAB: what is read, normalised, and what is rejected."""
    path = scratch(spark, "transcript")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]+", " ")
    lines = _t(spark, d, "conversations").select(F.concat(F.lit(" "), F.format_string("c%d_%d", "conv_id", "turn"), F.when(F.col("turn") % 7 == 6, " ").otherwise("\t"), text, F.lit("  ")).alias("line"))
    sinks.write_lines(lines, "line", path)
    good, bad = readers.transcript_lines(spark, path)
    return good.select("uid", "norm").unionByName(bad.select(F.col("value").alias("uid"), F.lit(None).cast("string").alias("norm")))


def csv_files(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.option("header", True).schema("n_nationkey long, n_name string, n_regionkey long").csv(path)


def duration_stats(spark, d):
    return stats.durations(_events(spark, d), "rec", "s", "e").withColumn("mean", F.round("mean", 3))


def word_counts(spark, d):
    return _tokens(_t(spark, d, "documents"), "lang").select("lang", F.explode("w").alias("word")).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("word").alias("types"))


def trigram_counts(spark, d):
    # some six characters a word
    return stats.ngram_counts(_tokens(_t(spark, d, "documents"), "text"), "w", 3, F.length("text") / 6)


def names_and_formats(spark, d):
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", tx.video_id(url).alias("yt"), tx.file_stem(url).alias("stem"), tx.segment_id(F.lit("page"), F.col("page_id")).alias("seg"), tx.percent(F.col("page_id") / F.lit(8.0)).alias("pct"))


def char_word_index(spark, d):
    return _t(spark, d, "benchmark").select("item_id", tx.word_at(F.col("text"), F.col("item_id").cast("int") % 97).cast("long").alias("word"))


def labelled_documents(spark, d):
    """Documents with their date-like side value, or 0: a left join with a default."""
    labels = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    return _t(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0).cast("long")).alias("quality"))


QUERIES = {f.__name__: f for f in (norm_text, norm_offsets, blanked, vocab_ids, encode_oov, ngram_doc_match_top10, ngram_best_document, ngram_all_scores, segment_vote, gap_segments, gap_chunks, fixed_chunks, interval_union, voiced_time_map, greedy_nonoverlap, greedy_apart, max_len_split, point_in_interval_all, point_in_interval_first, point_in_interval_half_open, point_in_interval_start_or_end, unmatched, gaps_between, coverage, overlap_check, bow_candidates, bow_candidates_many, best_window, window_errors, cer_pairs, rms_db, energy_filter, context_chunks, label_runs, greedy_labels, viterbi_words, resegment_lines, segment_stats, silence_segments, total_length, merged_islands, energy_islands, padded_batches, char_trim, merged_frames, decoded_words, text_helpers, byte_ranges, norm_json_files, recognition_files, logits_files, vocabulary_files, word_list_files, voiced_files, transcript_files, csv_files, duration_stats, word_counts, trigram_counts, names_and_formats, char_word_index, labelled_documents)}

_VOCAB = f"voc AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(w) AS word FROM ({_words_sql('documents', 'doc_id')})))"
_INDEX = f"ix AS (SELECT DISTINCT {GRAMS} AS gram, doc_id FROM ({_words_sql('documents', 'doc_id')}))"
_ITEMS = f"it AS ({_words_sql('benchmark', 'item_id')})"
_HITS = f"{_INDEX}, {_ITEMS}, gr AS (SELECT item_id, len(w) AS words, greatest(len(w) - 2, 0) AS grams, {GRAMS} AS gram FROM it), hits AS (SELECT item_id, words, grams, doc_id, count(*) AS hits FROM gr JOIN ix USING (gram) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM hits)"
_SPANS = f"{EVENTS}, sp AS (SELECT rec, pos AS span, s AS b, e AS f FROM ev WHERE kind = 'purchase'), pt AS (SELECT rec, pos, s, e FROM ev WHERE kind <> 'purchase')"
_GROUPS = f"{EVENTS}, g AS (SELECT *, coalesce(CAST(s - lag(e) OVER w > {GAP} AS INT), 0) AS new FROM ev WINDOW w AS (PARTITION BY rec ORDER BY s, pos)), gr AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY s, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM g)"
_SEGS = f"{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, pos) AS r FROM ev), sg AS (SELECT rec, r AS rb, r + 1 AS re, r * 2 AS nb, r * 2 + 1 AS ne FROM r WHERE kind = 'click'), ln AS (SELECT rec, max(r) + 3 AS n_reco, max(r) * 2 + 4 AS n_norm FROM r GROUP BY rec)"


def _greedy(op: str) -> str:
    return f"WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, pos) AS n FROM ev), k AS (SELECT rec, n, pos, s, e, e AS last, true AS keep FROM o WHERE n = 1 UNION ALL SELECT o.rec, o.n, o.pos, o.s, o.e, CASE WHEN o.s {op} k.last THEN o.e ELSE k.last END, o.s {op} k.last FROM k JOIN o ON o.rec = k.rec AND o.n = k.n + 1) SELECT rec, pos, s, e FROM k WHERE keep"


def _islands(margin: int) -> str:
    return f"{EVENTS}, x AS (SELECT rec, greatest(s - {margin}, 0) AS s, e + {margin} AS e FROM ev), y AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM y), isl AS (SELECT rec, island, min(s) AS start, max(e) AS \"end\" FROM z GROUP BY ALL), u AS (SELECT *, coalesce(sum(\"end\" - start) OVER (PARTITION BY rec ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM isl)"


ORACLE_SQL = {
    "norm_text": f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents",
    "vocab_ids": f"WITH {_VOCAB} SELECT word, id FROM voc",
    "encode_oov": f"WITH {_VOCAB}, {_ITEMS}, u AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM it) SELECT item_id, pos, coalesce(id, 0) AS id FROM u LEFT JOIN voc USING (word)",
    "ngram_doc_match_top10": f"WITH {_HITS} SELECT item_id, doc_id, hits, round(hits / words, 9) AS score, rank FROM rk WHERE rank <= 10",
    "ngram_best_document": f"WITH {_HITS.replace(GRAMS, OLDER_GRAMS)} SELECT item_id, doc_id, round(hits / (grams - 1), 9) AS score FROM rk WHERE rank = 1",
    "segment_vote": f"WITH {_INDEX}, sg AS ({_words_sql('conversations', 'conv_id, turn')}), gr AS (SELECT conv_id, turn, {GRAMS} AS gram FROM sg), h AS (SELECT conv_id, turn, doc_id, count(*) AS hits FROM gr JOIN ix USING (gram) GROUP BY ALL), win AS (SELECT conv_id, turn, doc_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, doc_id) AS r FROM h), v AS (SELECT conv_id, doc_id, count(*) AS votes FROM win WHERE r = 1 GROUP BY ALL) SELECT conv_id, doc_id, votes, round(votes / sum(votes) OVER (PARTITION BY conv_id), 9) AS share FROM v",
    "gap_segments": f"WITH {_GROUPS} SELECT rec, group_no, min(s) AS s, max(e) AS e, count(*) AS n FROM gr GROUP BY ALL",
    "gap_chunks": f"WITH RECURSIVE {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, pos) - 1 AS n FROM ev), k AS (SELECT rec, n, 0 AS chunk, 1 AS c, e AS last FROM o WHERE n = 0 UNION ALL SELECT o.rec, o.n, CASE WHEN o.s - k.last > {GAP} OR k.c >= 5 THEN k.chunk + 1 ELSE k.chunk END, CASE WHEN o.s - k.last > {GAP} OR k.c >= 5 THEN 1 ELSE k.c + 1 END, CASE WHEN o.s - k.last > {GAP} OR k.c >= 5 THEN o.s ELSE o.e END FROM k JOIN o ON o.rec = k.rec AND o.n = k.n + 1) SELECT rec, min(n) AS beg, max(n) + 1 AS \"end\" FROM k GROUP BY rec, chunk HAVING count(*) >= 2",
    "fixed_chunks": f"WITH t AS ({_words_sql('conversations', 'conv_id, turn')}), c AS (SELECT *, unnest(range(0, CAST(ceil(len(w) / 15) AS BIGINT))) AS chunk FROM t) SELECT conv_id, turn, chunk, chunk * 15 AS beg, least(chunk * 15 + 20, len(w)) AS \"end\", array_to_string(w[chunk * 15 + 1 : chunk * 15 + 20], ' ') AS said FROM c",
    "interval_union": f"WITH {_islands(900 * SECOND)} SELECT rec, island, start, \"end\", before FROM u",
    "voiced_time_map": f"WITH {_islands(0)}, tot AS (SELECT rec, sum(\"end\" - start)::BIGINT AS total FROM u GROUP BY rec), t AS (SELECT rec, k, total * k // 10 AS spot FROM tot, range(1, 10) r(k)) SELECT t.rec, k, min(start + spot - before) AS restored FROM t JOIN u ON u.rec = t.rec AND spot <= before + \"end\" - start AND (spot > before OR spot = 0 AND before = 0) GROUP BY ALL",
    "greedy_nonoverlap": _greedy(">="),
    "greedy_apart": _greedy(">"),
    "max_len_split": f"WITH RECURSIVE {_GROUPS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec, group_no ORDER BY s, pos) AS n, last_value(e) OVER (PARTITION BY rec, group_no ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(s) OVER (PARTITION BY rec, group_no ORDER BY s, pos) AS span FROM gr), k AS (SELECT rec, group_no, n, s, e, s AS b, 0::BIGINT AS part FROM o WHERE n = 1 UNION ALL SELECT o.rec, o.group_no, o.n, o.s, o.e, CASE WHEN o.span > {LONGEST} AND o.e - k.b > o.span / ceil(o.span / {LONGEST}) THEN o.s ELSE k.b END, CASE WHEN o.span > {LONGEST} AND o.e - k.b > o.span / ceil(o.span / {LONGEST}) THEN k.part + 1 ELSE k.part END FROM k JOIN o ON o.rec = k.rec AND o.group_no = k.group_no AND o.n = k.n + 1) SELECT rec, group_no, part, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY ALL",
    "point_in_interval_all": f"WITH {_SPANS} SELECT pt.rec, pos, span FROM pt JOIN sp ON pt.rec = sp.rec AND (s + e) // 2 BETWEEN b AND f",
    "point_in_interval_first": f"WITH {_SPANS} SELECT rec, pos, span FROM (SELECT pt.rec, pos, span, row_number() OVER (PARTITION BY pt.rec, pos ORDER BY b, span) AS r FROM pt JOIN sp ON pt.rec = sp.rec AND (s + e) // 2 BETWEEN b AND f) WHERE r = 1",
    "point_in_interval_half_open": f"WITH {_SPANS} SELECT pt.rec, pos, span FROM pt JOIN sp ON pt.rec = sp.rec AND s >= b AND s < f",
    "point_in_interval_start_or_end": f"WITH {_SPANS} SELECT rec, pos, span FROM (SELECT pt.rec, pos, span, row_number() OVER (PARTITION BY pt.rec, pos ORDER BY b, span) AS r FROM pt JOIN sp ON pt.rec = sp.rec AND (s BETWEEN b AND f OR e BETWEEN b AND f)) WHERE r = 1",
    "unmatched": f"WITH {_SPANS} SELECT rec, pos FROM pt WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.rec = pt.rec AND (s + e) // 2 BETWEEN b AND f)",
    "gaps_between": f"WITH {_SEGS}, i AS (SELECT rec, re AS rb, lead(rb) OVER w AS re, ne AS nb, lead(nb) OVER w AS ne FROM sg WINDOW w AS (PARTITION BY rec ORDER BY rb, nb)), m AS (SELECT sg.rec, min(rb) AS f, max(re) AS l, min(nb) AS lo, max(ne) AS hi, any_value(n_reco) AS n_reco, any_value(n_norm) AS n_norm FROM sg JOIN ln ON ln.rec = sg.rec GROUP BY sg.rec), a AS (SELECT * FROM i UNION ALL SELECT rec, greatest(f - lo, 0), f, greatest(lo - f, 0), lo FROM m UNION ALL SELECT rec, l, n_reco, hi, least(hi + n_reco - l, n_norm) FROM m) SELECT rec, rb AS reco_beg, re AS reco_end, nb AS norm_beg, ne AS norm_end FROM a WHERE re > rb AND ne > nb",
    "coverage": f"WITH {_SEGS} SELECT ln.rec, round(coalesce(sum(re - rb), 0) / any_value(n_reco), 9) AS covered FROM ln LEFT JOIN sg ON sg.rec = ln.rec GROUP BY ln.rec",
    "overlap_check": f"WITH {EVENTS}, l AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY s, e) AS previous_end FROM ev) SELECT rec, pos, previous_end FROM l WHERE s < previous_end",
    "bow_candidates": f"WITH {_HITS}, dw AS ({_words_sql('documents', 'doc_id')}), pr AS (SELECT rk.item_id, it.w AS c, dw.w AS d FROM rk JOIN it USING (item_id) JOIN dw USING (doc_id) WHERE rank = 1), h AS (SELECT item_id, len(c) AS n, len(d) AS size, unnest(list_transform(d, lambda x: CAST(list_contains(c, x) AS INT))) AS hit, generate_subscripts(d, 1) - 1 AS p FROM pr), cs AS (SELECT *, sum(hit) OVER (PARTITION BY item_id ORDER BY p) AS s FROM h), win AS (SELECT a.item_id, a.p AS beg, b.s - a.s + a.hit AS hits FROM cs a JOIN cs b ON a.item_id = b.item_id AND b.p = least(a.p + a.n, a.size) - 1 WHERE a.p < greatest(a.size - a.n + 1, 1)) SELECT item_id, beg, hits::BIGINT AS hits FROM win QUALIFY hits > 0 AND hits >= max(hits) OVER (PARTITION BY item_id) * 0.9",
    "cer_pairs": "WITH p AS (SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance, levenshtein(a.p_name, b.p_name) / length(a.p_name) AS c FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, distance, round(c, 9) AS cer, CASE WHEN c < 0.01 THEN 'perfect' WHEN c < 0.1 THEN 'good' WHEN c < 0.5 THEN 'mediocre' WHEN c < 1 THEN 'bad' ELSE 'terrible' END AS bucket FROM p",
    "rms_db": "SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))), 6) AS db FROM embeddings",
    "energy_filter": "SELECT vec_id FROM embeddings WHERE 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))) >= -18.1",
    "context_chunks": "WITH c AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, CAST(ceil(len(embedding) / 14) AS BIGINT))) AS chunk FROM embeddings), k AS (SELECT *, chunk * 14 AS beg, least(chunk * 14 + 20, n) AS \"end\" FROM c), o AS (SELECT *, CASE WHEN chunk = 0 THEN 0 ELSE beg + 4 END AS own_beg, CASE WHEN \"end\" = n THEN n ELSE \"end\" - 2 END AS own_end FROM k) SELECT vec_id, chunk, beg, \"end\", own_beg, own_end FROM o WHERE own_end > own_beg AND (chunk = 0 OR beg - 14 + 20 < n)",
    "label_runs": "WITH f AS (SELECT vec_id // 50 AS rec, vec_id % 50 AS t, list_position(embedding, list_max(embedding)) - 1 AS label FROM embeddings), n AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY rec ORDER BY t) THEN 0 ELSE 1 END AS new FROM f), r AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT rec, run, any_value(label)::BIGINT AS label, min(t) AS beg, max(t) + 1 AS \"end\" FROM r GROUP BY rec, run",
    "greedy_labels": "WITH f AS (SELECT vec_id // 50 AS rec, vec_id % 50 AS t, list_position(embedding, list_max(embedding)) - 1 AS label FROM embeddings), n AS (SELECT *, label IS DISTINCT FROM lag(label) OVER (PARTITION BY rec ORDER BY t) AS new FROM f) SELECT rec, string_agg(label::VARCHAR, ' ' ORDER BY t) AS labels FROM n WHERE new AND label <> 0 GROUP BY rec",
    "duration_stats": f"WITH {EVENTS} SELECT rec, count(*) AS n, round(avg(e - s), 3) AS mean, min(e - s) AS shortest, max(e - s) AS longest FROM ev GROUP BY rec",
    "word_counts": f"WITH t AS ({_words_sql('documents', 'lang')}), u AS (SELECT lang, unnest(w) AS word FROM t) SELECT lang, count(*) AS n, count(DISTINCT word) AS types FROM u GROUP BY lang",
    "trigram_counts": f"WITH t AS ({_words_sql('documents', 'doc_id')}), u AS (SELECT unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE []::VARCHAR[] END) AS gram FROM t) SELECT gram, count(*) AS n FROM u GROUP BY gram",
    "names_and_formats": r"SELECT page_id, coalesce(regexp_extract_all(url, '[0-9a-zA-Z_-]{11}')[-1], '') AS yt, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '(.)\.[^.]*$', '\1') AS stem, printf('page_seg_%04d', page_id) AS seg, printf('%.2f%%', page_id / 8.0 * 100) AS pct FROM pages",
    "char_word_index": "WITH t AS (SELECT item_id, item_id % 97 AS spot, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, spot, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t), c AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM u) SELECT item_id, coalesce(min(i) FILTER (upto > spot), any_value(n) - 1) AS word FROM c GROUP BY item_id",
    "labelled_documents": "SELECT doc_id, coalesce(max(quality), 0)::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id",
}

_WORDS_OF_TURNS = _words_sql("conversations", "conv_id, turn, text")
_BLANKED = f"t AS (@rows), t2 AS (SELECT id, {_blank_sql('x', tx.BRACKETS)} AS x FROM t), t3 AS (SELECT id, regexp_replace(lower({_blank_sql('x', tx.SLASHES)}), '{tx.NOT_WORD}', ' ', 'g') AS x FROM t2)"
_DOC_HITS = f"{_HITS}, dw AS ({_words_sql('documents', 'doc_id')})"

ORACLE_SQL |= {
    "norm_offsets": "WITH " + _BLANKED.replace("@rows", f"SELECT doc_id AS id, {STRIP.format('text')} AS x FROM documents") + """,
      s AS (SELECT id, string_split(x, ' ') AS w FROM t3), u AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM s),
      a AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg FROM u)
      SELECT id AS doc_id, word, beg, beg + length(word) AS "end" FROM a WHERE word <> ''""",
    "blanked": "WITH " + _BLANKED.replace("@rows", "SELECT doc_id AS id, '[' || left(text, 5) || '] ' || replace(left(text, 60), ' ', ' /x [y/ ') || text AS x FROM documents") + """
      SELECT id AS doc_id, array_to_string(list_filter(string_split(x, ' '), lambda y: y <> ''), ' ') AS norm, length(x) AS n, length(regexp_replace(x, ' +$', '')) AS last FROM t3""",
    "bow_candidates_many": f"WITH {edit_sql.best_windows(_DOC_HITS)} SELECT item_id, beg, hits::BIGINT AS hits FROM cand WHERE found <= 3 OR hits >= best * 0.99",
    "best_window": f"WITH {edit_sql.best_windows(_DOC_HITS)} SELECT item_id, beg, least(beg + n, size) AS \"end\", distance, round(distance / length(said), 9) AS relative FROM bw",
    "window_errors": edit_sql.window_errors(_DOC_HITS),
    "char_trim": edit_sql.char_trim(_DOC_HITS),
    "viterbi_words": edit_sql.VITERBI,
    "resegment_lines": edit_sql.resegment_lines(_WORDS_OF_TURNS),
    "segment_stats": edit_sql.segment_stats(_WORDS_OF_TURNS),
    "silence_segments": edit_sql.silence_segments(_WORDS_OF_TURNS, 0.6, 10.0),
    "ngram_all_scores": f"WITH {_HITS}, s AS (SELECT item_id, doc_id, hits / (len(w) - 2) AS score FROM hits JOIN it USING (item_id)), b AS (SELECT item_id, count(*) AS found, max(score) AS score, arg_min(doc_id, (-score, doc_id)) AS doc_id FROM s GROUP BY item_id) SELECT item_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, coalesce(found, 0) AS found, doc_id, round(coalesce(score, 0.0), 9) AS score FROM it LEFT JOIN b USING (item_id)",
    "total_length": f"WITH {EVENTS} SELECT count(*) AS n, sum(e - s)::BIGINT AS total FROM ev",
    "merged_islands": f"""WITH {EVENTS}, x AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
      y AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= {7200 * SECOND} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x),
      z AS (SELECT rec, min(s) AS start, max(e) AS "end" FROM y GROUP BY rec, g HAVING max(e) - min(s) >= {1800 * SECOND})
      SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY start) - 1 AS island, start, "end" FROM z""",
    "energy_islands": """WITH v AS (SELECT vec_id // 50 AS rec, vec_id % 50 AS t, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))) >= -18.1 AS loud FROM embeddings),
      n AS (SELECT *, t - row_number() OVER (PARTITION BY rec ORDER BY t) AS g FROM v WHERE loud), s AS (SELECT rec, min(t) AS b, max(t) + 1 AS f FROM n GROUP BY rec, g)
      SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY b) - 1 AS island, b::DOUBLE AS start, f::DOUBLE AS "end" FROM s""",
    "padded_batches": f"""WITH t AS ({_words_sql('conversations', 'conv_id, turn')}), b AS (SELECT conv_id, turn, w, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch FROM t),
      m AS (SELECT *, max(len(w)) OVER (PARTITION BY conv_id, batch) AS k FROM b)
      SELECT conv_id, turn, batch, array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN i <= len(w) THEN length(w[i])::VARCHAR ELSE '-1' END), ' ') AS x, len(w) AS real FROM m""",
    "merged_frames": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "decoded_words": f"WITH {_VOCAB}, {_ITEMS}, u AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM it) SELECT item_id, pos, CASE WHEN pos % 9 = 4 OR voc.word IS NULL THEN '<unk>' ELSE u.word END AS word FROM u LEFT JOIN voc USING (word)",
    "text_helpers": r"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')), ' ') AS bare,
      trunc(item_id * 0.37::DOUBLE * 50)::BIGINT AS frame, left(text, item_id % 5) || '<b>' || substr(text, item_id % 5 + 1, 3) || '</b>' || substr(text, item_id % 5 + 4) AS marked,
      array_to_string([4] || list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ''), lambda c: c <> ''), lambda c: CASE WHEN c = ' ' THEN 4 ELSE unicode(c) - 92 END) || [4], ' ') AS labels,
      string_split(text, ' ')[1] AS best, (item_id + item_id * 2) / 2 AS middle FROM benchmark""",
    "byte_ranges": """WITH p AS (SELECT page_id, encode(html) AS b, octet_length(encode(html)) AS n FROM pages),
      r AS (SELECT *, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN 10 WHEN 2 THEN greatest(n - 50, 0) ELSE 0 END AS begin, CASE page_id % 4 WHEN 1 THEN least(page_id + 21, n) ELSE n END AS f FROM p),
      q AS (SELECT *, CASE WHEN page_id % 4 = 3 THEN 200 WHEN begin >= n OR f <= begin THEN 416 ELSE 206 END AS status FROM r)
      SELECT page_id, begin, CASE WHEN status = 416 THEN begin ELSE f END AS "end", status, sha256(CASE WHEN status = 416 THEN ''::BLOB ELSE unhex(substr(hex(b), (begin * 2 + 1)::BIGINT, ((f - begin) * 2)::BIGINT)) END) AS sha FROM q""",
    "norm_json_files": f"WITH t AS ({_words_sql('conversations', 'conv_id, turn')}), u AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t) SELECT conv_id::VARCHAR AS rec, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos, turn AS line, word FROM u",
    "recognition_files": f"WITH t AS ({_words_sql('conversations', 'conv_id, turn')}), u AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t) SELECT conv_id::VARCHAR AS rec, printf('seg_%04d', turn) AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 1000.0 + i * 0.5, turn, i) - 1 AS pos, word, turn * 1000.0::DOUBLE + i * 0.5::DOUBLE AS start, turn * 1000.0::DOUBLE + i * 0.5::DOUBLE + 0.25 AS \"end\" FROM u",
    "logits_files": "SELECT (vec_id // 50)::VARCHAR AS rec_id, vec_id % 50 AS t, len(embedding) AS n, list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE)), lambda a, x: a * 0.5 + x) AS mixed FROM embeddings",
    "vocabulary_files": f"WITH {_VOCAB} SELECT id, word FROM voc",
    "word_list_files": f"SELECT DISTINCT unnest(w) AS word FROM ({_words_sql('benchmark', 'item_id')})",
    "voiced_files": "SELECT printf('u%d_seg_%04d', user_id, event_id) AS id, printf('u%d', user_id) AS reco_id, event_id AS length, (-event_id % 60)::DOUBLE AS rms, event_id::DOUBLE AS start, event_id + 0.5::DOUBLE AS \"end\" FROM events WHERE -event_id % 60 >= -45",
    "transcript_files": f"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\\t\\r\\n]+', ' ', 'g') AS text FROM conversations)
      SELECT printf('c%d_%d', conv_id, turn) AS uid, {NORM.format('text')} AS norm FROM t WHERE turn % 7 <> 6
      UNION ALL SELECT {STRIP.format("printf('c%d_%d', conv_id, turn) || ' ' || text")}, NULL FROM t WHERE turn % 7 = 6""",
    "csv_files": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
}
