"""A place for files and tables that a query writes and reads back, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session that names none uses its own temp folder; a cluster has to name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
    return place.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/weftline-files/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows does not run it again, also after an executor is lost.

    The shuffle files of the write are deleted when it ends. Else they stay until the driver happens to collect its garbage, and those of all steps of a query can be on disk at once.
    """
    path, conf = scratch(df.sparkSession, "settled"), df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def let_go(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._settled_at)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):  # the session's JVM is gone
        pass
