"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.
    Where the setting is unset a temporary one is set on a local master; on a
    cluster that is an error, since executors could not share it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrid-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Rows of an Arrow batch. Spark's own 10,000 long texts would be gigabytes.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lets texts go to Python in batches of at most BATCH_ROWS rows."""
    now = int(spark.conf.get(BATCH_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def work_dir(spark: SparkSession, name: str) -> str:
    """A path in it that nothing else has."""
    return f"{shared_dir(spark)}/lexigrid-{name}-{uuid.uuid4().hex}"


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
