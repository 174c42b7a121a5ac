"""Recordings of any length: WAV files read in blocks of samples, each part of a file by a task of its own.

``spark.read.format("wav_blocks")`` after ``register(spark)``. A pattern in the path picks files before any is opened; the source takes no filters, as Spark 4.1 keeps those of
one query for the next one over the same table. The file systems are pyarrow's (local paths, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.text import decibels

#: Frames of a block, and bytes of a file that a task reads.
BLOCK_FRAMES, PART_BYTES = 1 << 16, 32 << 20
BLOCKS = "id string, samp_freq int, channels int, frames long, channel int, block long, samples array<float>"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def listed(path: str) -> list[tuple[str, str, int]]:
    """(id, place, bytes) of a WAV file, of the WAV files of a folder, or of a pattern with * in its last part."""
    from pyarrow import fs

    folder, _, last = path.rpartition("/")
    pattern = last if "*" in last else "*.wav"
    store, at = _store(folder if "*" in last else path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    files = sorted((f for f in found if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, pattern))), key=lambda f: f.path)
    return [(posixpath.splitext(f.base_name)[0], f.path, f.size) for f in files]


def header(file) -> tuple[int, int, int, int, int]:
    """Channels, frames a second, bytes of a sample, place of the samples, frames: from the chunks of an open file."""
    size, at, form = file.size(), 12, None
    file.seek(0)
    riff = file.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if kind not in (1, 0xFFFE):
                raise ValueError(f"samples of kind {kind} instead of whole numbers")
            form = channels, rate, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            # a file that was cut off, or whose length was never filled in, ends where it ends
            return *form, at + 8, min(length, size - at - 8) // (form[0] * form[2])
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def samples_of(raw: bytes, width: int) -> np.ndarray:
    """Samples from -1 to 1."""
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) / 2**31
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    return (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)


class Part(InputPartition):
    """Bytes [beg, end) of a file: the blocks that begin there are read by one task."""

    def __init__(self, rec: str, place: str, beg: int, end: int):
        super().__init__(None)
        self.rec, self.place, self.beg, self.end = rec, place, beg, end


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.headers = options["path"], options.get("headers", "false").lower() == "true"
        self.part, self.block = int(options.get("partBytes", PART_BYTES)), int(options.get("blockFrames", BLOCK_FRAMES))

    def partitions(self):
        files = listed(self.path)
        step = (lambda size: max(size, 1)) if self.headers else (lambda size: self.part)
        return [Part(rec, place, at, at + step(size)) for rec, place, size in files for at in range(0, max(size, 1), step(size))]

    def read(self, part):
        schema = pa.schema([("id", pa.string()), ("samp_freq", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("channel", pa.int32()), ("block", pa.int64()), ("samples", pa.list_(pa.float32()))])
        if part is None:  # no file at all
            return
        store, _ = _store(self.path.rpartition("/")[0] if "*" in self.path else self.path)
        with store.open_input_file(part.place) as file:
            channels, rate, width, start, frames = header(file)
            frame = channels * width
            if self.headers:
                yield pa.RecordBatch.from_pylist([{"id": part.rec, "samp_freq": rate, "channels": channels, "frames": frames, "channel": None, "block": None, "samples": None}], schema=schema)
                return
            # the first block also belongs to the bytes of the header before it
            low = 0 if part.beg <= start else -(-(part.beg - start) // (frame * self.block))
            for block in range(low, -(-frames // self.block)):
                at = start + block * self.block * frame
                if at >= part.end and block > 0 or (block == 0 and part.beg > 0):
                    if at >= part.end:
                        break
                    continue
                file.seek(at)
                x = samples_of(file.read(min(self.block, frames - block * self.block) * frame), width).reshape(-1, channels).astype(np.float32)
                rows = [{"id": part.rec, "samp_freq": rate, "channels": channels, "frames": frames, "channel": c, "block": block, "samples": x[:, c]} for c in range(channels)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WavBlocks(DataSource):
    """Rows (id, samp_freq, channels, frames, channel, block, samples): block b of a channel holds its samples from b * ``blockFrames`` on. With ``headers`` one row for each file, without samples."""

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavBlocks)


def wav_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of samples of the WAV files at ``path``."""
    register(spark)
    return spark.read.format("wav_blocks").options(**options).load(path)


def cut_blocks(spark: SparkSession, path: str, segments: DataFrame, floor_db: float | None = -45.0, block_frames: int = BLOCK_FRAMES, **options) -> DataFrame:
    """Voiced segments (rec, seg, start, end) of the recordings at ``path`` with their samples and level, as ``readers.cut_audio`` gives them; those under ``floor_db`` are left out.

    A segment meets the blocks that it covers, so no row holds more than the longest segment. Where there are several channels they count as following each other.
    """
    info = wav_blocks(spark, path, headers="true").select(F.col("id").alias("rec"), "samp_freq", "channels", "frames")
    at = lambda c: (F.col(c) * F.col("samp_freq")).cast("long")
    wanted = segments.select("rec", "seg", "start", "end").join(info, "rec").withColumn("s", at("start")).withColumn("e", F.greatest(at("end"), at("start")))
    # stretches of channels, then of blocks
    piece = wanted.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    lo, hi = (F.least(F.greatest(F.col(c) - F.col("channel") * F.col("frames"), F.lit(0)), F.col("frames")) for c in ("s", "e"))
    piece = piece.withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_frames), F.floor((F.col("hi") - 1) / block_frames))))
    blocks = wav_blocks(spark, path, blockFrames=str(block_frames), **options).select(F.col("id").alias("rec"), "channel", "block", "samples")
    first = F.col("block") * block_frames
    beg = F.greatest(F.col("lo") - first, F.lit(0)).cast("int")
    length = (F.least(F.col("hi") - first, F.lit(block_frames).cast("long")) - beg).cast("int")
    met = piece.join(blocks, ["rec", "channel", "block"]).select("rec", "seg", "channel", "block", F.slice("samples", beg + 1, length).alias("x"))
    joined = met.groupBy("rec", "seg").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("channel", "block", "x"))), lambda y: y["x"])).alias("samples"))
    cut = wanted.select("rec", "seg", "start", "end", "samp_freq").join(joined, ["rec", "seg"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<float>"))).withColumn("rms", decibels(F.col("samples")))
    return cut if floor_db is None else cut.filter(F.col("rms") >= floor_db)
