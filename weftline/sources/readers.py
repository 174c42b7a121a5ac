"""Readers: files to typed DataFrames. Paths may be globs or folders of any file system that Spark reads."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import decibels, file_stem, normalized, stripped, words

CHUNK = "struct<text:string,timestamp:array<double>>"
RECO_SEGMENT = f"struct<reco_id:string,samp_freq:double,length:bigint,rms:double,start:double,end:double,text:string,chunks:array<{CHUNK}>>"
RECO_LIST = "array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double>>,acoustic_score:double,lm_score:double>>"
NORM_LIST = "array<struct<uid:string,text:string,norm:string,normoff:array<array<int>>>>"
SEGMENTS = "array<struct<id:string,text:string,norm:string,reco:string,start:double,end:double,words:array<struct<time_s:double,time_e:double,char_s:int,char_e:int>>,reco_words:array<struct<time_s:double,time_e:double>>,errors:struct<delete:int,insert:int,replace:int,num:int,corr:int,wer:double,cer:double>,match_error:string,unaligned:boolean>>"


def _files(spark: SparkSession, path, suffix: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", f"*.{suffix}") if suffix else reader
    return reader.load(path)


def _documents(spark: SparkSession, path) -> DataFrame:
    """(rec, body): a row for each file; rec is the file's name without its suffix, or the value of a folder ``rec=...``. Files without a byte have no row."""
    folder = F.url_decode(F.regexp_extract("path", r"/rec=([^/]*)/[^/]*$", 1))
    files = _nested_files(spark, path) if isinstance(path, str) and _has_folders(spark, path) else _files(spark, path)
    return files.filter(~F.regexp_extract("path", "([^/]+)$", 1).startswith("_")).select(F.when(folder != "", folder).otherwise(file_stem("path")).alias("rec"), F.decode("content", "UTF-8").alias("body"))


def _nested_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of all folders below ``path``. The folders are listed by a few tasks a core; Spark alone would start one for each, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(name, before)


def _has_folders(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder with a folder for each recording, as the writers of this package leave it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/rec=*")
    return len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []) > 0


def wav(spark: SparkSession, path) -> DataFrame:
    """(id, samp_freq, length_s, samples array<float> from -1 to 1); the channels of a recording follow each other."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(raw)) as f:
                    width, channels, rate, frames = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
                if width == 3:
                    b = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) / 2**31
                else:
                    x = np.frombuffer(frames, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                    x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
                x = x.reshape(-1, channels)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([len(x) / rate]), pa.array([x.T.ravel().astype(np.float32)], pa.list_(pa.float32()))], names=["id", "samp_freq", "length_s", "samples"])

    return _files(spark, path, "wav").select(file_stem("path").alias("id"), "content").mapInArrow(run, "id string, samp_freq int, length_s double, samples array<float>")


def voiced_segments(spark: SparkSession, path) -> DataFrame:
    """JSON lines of voiced segments."""
    return spark.read.schema("id string, reco_id string, samp_freq int, length int, rms double, start double, end double").json(path)


def voiced_pairs(spark: SparkSession, path) -> DataFrame:
    """(rec, seg, start, end) of files with an array of pairs."""
    pairs = _documents(spark, path).select("rec", F.posexplode(F.from_json("body", "array<array<double>>")).alias("seg", "p"))
    return pairs.select("rec", "seg", F.col("p")[0].alias("start"), F.col("p")[1].alias("end"))


def cut_audio(audio: DataFrame, segments: DataFrame, floor_db: float | None = -45.0) -> DataFrame:
    """Voiced segments (rec, seg, start, end) with their samples and level; those under ``floor_db`` are left out."""
    joined = segments.join(audio, segments["rec"] == audio["id"])
    at = lambda c: (F.col(c) * F.col("samp_freq")).cast("int")
    cut = joined.select("rec", "seg", "start", "end", "samp_freq", F.slice("samples", at("start") + 1, F.greatest(at("end") - at("start"), F.lit(0))).alias("samples")).withColumn("rms", decibels(F.col("samples")))
    return cut if floor_db is None else cut.filter(F.col("rms") >= floor_db)


def energy_filter(segments: DataFrame, floor_db: float = -45.0) -> DataFrame:
    return segments.filter(F.col("rms") >= floor_db)


def recognised_map(spark: SparkSession, path) -> DataFrame:
    """(rec, seg, pos, word, start, end) of files that map segment ids to segments with chunks; times are made absolute. Segments without chunks give no words."""
    segs = _documents(spark, path).select(F.explode(F.from_json("body", f"map<string,{RECO_SEGMENT}>")).alias("seg", "s"))
    rows = segs.select(F.col("s.reco_id").alias("rec"), "seg", F.col("s.start").alias("begin"), F.posexplode("s.chunks").alias("i", "c"))
    placed = rows.select("rec", "seg", "i", F.col("c.text").alias("word"), (F.col("begin") + F.col("c.timestamp")[0]).alias("start"), (F.col("begin") + F.col("c.timestamp")[1]).alias("end"))
    return with_positions(placed, "rec", ["start", "seg", "i"]).drop("i")


def recognised_list(spark: SparkSession, path) -> DataFrame:
    """(rec, seg, pos, word, start, end) of files with a list of segments; words without a time, or times without a word, are left out."""
    segs = _documents(spark, path).select("rec", F.posexplode(F.from_json("body", RECO_LIST)).alias("seg", "s"))
    pairs = F.filter(F.arrays_zip(words(F.col("s.text")).alias("word"), F.col("s.words").alias("time")), lambda x: x["word"].isNotNull() & x["time"].isNotNull())
    rows = segs.select("rec", "seg", F.posexplode(pairs).alias("i", "w"))
    return with_positions(rows.select("rec", "seg", "i", F.col("w.word").alias("word"), F.col("w.time.start").alias("start"), F.col("w.time.end").alias("end")), "rec", ["seg", "i"]).drop("i")


def with_positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 in each key."""
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def normalised_lines(spark: SparkSession, path) -> DataFrame:
    """(rec, line, uid, text, norm, normoff array<struct<s,e>>)."""
    rows = _documents(spark, path).select("rec", F.posexplode(F.from_json("body", NORM_LIST)).alias("line", "s"))
    return rows.select("rec", "line", "s.uid", "s.text", "s.norm", F.transform("s.normoff", lambda x: F.struct(x[0].alias("s"), x[1].alias("e"))).alias("normoff"))


def line_words(lines: DataFrame) -> DataFrame:
    """(rec, pos, line, word) of normalised lines, numbered through each recording."""
    rows = lines.select("rec", "line", F.posexplode(words(F.col("norm"))).alias("i", "word"))
    return with_positions(rows, "rec", ["line", "i"]).select("rec", "pos", "line", "word")


def transcript_text(spark: SparkSession, path) -> DataFrame:
    """(rec, words) of plain text files."""
    return _documents(spark, path).select("rec", words(F.col("body")).alias("words"))


def transcript(spark: SparkSession, path) -> DataFrame:
    """(rec, words) of files that are either normalised JSON or plain text."""
    body = _documents(spark, path)
    parsed = F.from_json("body", NORM_LIST)
    from_json = F.flatten(F.transform(parsed, lambda s: words(s["norm"])))
    return body.select("rec", F.when(F.ltrim("body").startswith("[") & parsed.isNotNull(), from_json).otherwise(words(F.col("body"))).alias("words"))


def transcript_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(uid, text, norm) of lines "uid TAB text", and the lines that have no TAB."""
    lines = spark.read.text(path).select(stripped(F.col("value")).alias("value")).filter("value <> ''")
    parts = F.split("value", "\t", 2)
    good = lines.filter(F.contains("value", F.lit("\t"))).select(parts[0].alias("uid"), parts[1].alias("text"))
    return good.withColumn("norm", normalized(F.col("text"))), lines.filter(~F.contains("value", F.lit("\t")))


def logits(spark: SparkSession, path) -> DataFrame:
    """(rec_id, t, logits array<float>)."""
    return spark.read.schema("rec_id string, t int, logits array<float>").parquet(path)


def logits_npz(spark: SparkSession, path) -> DataFrame:
    """(rec_id, t, logits array<float>) of .npz files, whose first array has a row for each frame."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("rec_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(raw)) as found:
                    x = np.asarray(found[found.files[0]], np.float32)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), lists], names=["rec_id", "t", "logits"])

    return _files(spark, path, "npz").select(file_stem("path").alias("rec_id"), "content").mapInArrow(run, "rec_id string, t int, logits array<float>")


def arpa_unigrams(spark: SparkSession, path) -> DataFrame:
    """Words of the 1-gram section of ARPA files: its second fields up to the first blank line, without those that begin with <."""
    body = F.regexp_extract(F.regexp_replace("body", "\r\n?", "\n"), r"(?s)(?:^|\n)\\1-grams:[^\n]*\n(.*?)(?:\n[ \t]*\n|\n?$)", 1)
    rows = _documents(spark, path).select(F.explode(F.split(body, "\n")).alias("l")).select(F.get(words(F.col("l")), 1).alias("word"))
    return rows.filter(F.col("word").isNotNull() & ~F.startswith("word", F.lit("<")))


def arpa_model(spark: SparkSession, path) -> DataFrame:
    """(n, gram, logp, backoff) of ARPA files of any size: a line with a tab is a gram, as long as it has words, so files can be read in parts."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.col("value").rlike("^[ ]*-?[0-9.]+([eE][-+]?[0-9]+)?\t"))
    gram = F.trim(parts[1])
    return lines.select(F.size(F.split(gram, " +")).alias("n"), F.regexp_replace(gram, " +", " ").alias("gram"), F.trim(parts[0]).cast("double").alias("logp"), F.get(parts, F.lit(2)).cast("double").alias("backoff"))


def word_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")


def vocabulary(spark: SparkSession, path) -> DataFrame:
    """(id, word) of lines "id word"."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).filter(F.contains("value", F.lit(" "))).select(parts[0].cast("int").alias("id"), parts[1].alias("word"))


def tokenizer_vocabulary(spark: SparkSession, path, renamed: dict[str, str] | None = None, lower: bool = False) -> DataFrame:
    """(token, id) of a JSON object, in the order of ids, with tokens renamed or in lower case."""
    rows = _documents(spark, path).select(F.explode(F.from_json("body", "map<string,int>")).alias("token", "id"))
    name = F.col("token")
    for old, new in (renamed or {}).items():
        name = F.when(F.col("token") == old, new).otherwise(name)
    return rows.select((F.lower(name) if lower else name).alias("token"), "id").orderBy("id")


def segments(spark: SparkSession, path) -> DataFrame:
    """Segments of final files: rec and the fields of a segment; absent fields are null."""
    return _documents(spark, path).select("rec", F.posexplode(F.from_json("body", SEGMENTS)).alias("n", "s")).select("rec", "n", "s.*")


def settings(spark: SparkSession, path, default: dict[str, str]) -> dict[str, str]:
    """A small JSON object of settings, over ``default``; an absent file gives the default."""
    from pyspark.errors import AnalysisException

    try:
        found = _documents(spark, path).select(F.from_json("body", "map<string,string>").alias("m")).first()
    except AnalysisException:
        return dict(default)
    return default | ((found and found["m"]) or {})


def dates(spark: SparkSession, path) -> DataFrame:
    """(utt, date) of a JSON object."""
    return _documents(spark, path).select(F.explode(F.from_json("body", "map<string,string>")).alias("utt", "date"))


def with_model(df: DataFrame, model, schema: str) -> DataFrame:
    """Rows that an outside model makes of batches of rows: ``model`` maps an iterator of pandas frames, and loads itself once in each worker."""
    return df.mapInPandas(model, schema)
