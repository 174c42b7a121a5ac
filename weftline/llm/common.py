"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import counted_join  # noqa: F401  (joins to keys of which some are hot)

#: White space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Tables with at most this many rows of a few fixed-width columns are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20

#: Names this process's folder of intermediate tables.
_RUN = uuid.uuid4().hex
_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it. Where that is unset a local session uses its own temp folder; a cluster has to name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in this process's folder, which is deleted when the process ends."""
    folder = f"{shared_dir(spark)}/weftline/{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete_at_end, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _delete_at_end(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except (Py4JError, OSError):  # the session's JVM is gone
        pass


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: a later stage that loses an executor rereads the files instead of running what came before again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, weight=None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, and ``most`` bytes by the column ``weight`` (of rows that aren't narrow), else unchanged, so that the join shuffles. Give it materialized tables."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if weight is None else weight), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= limit and found["b"] <= most else df


def slices(batch: pa.RecordBatch, text_at: int, rows: int = 2048, size: int = 16 << 20):
    """``batch`` in parts of at most ``rows`` rows whose texts have at most ``size`` bytes together, or one row: what a task holds beside a batch doesn't grow with the lengths of its texts."""
    upto, at = np.cumsum(pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(upto):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + rows, len(upto))
        yield batch.slice(at, end - at)
        at = end
