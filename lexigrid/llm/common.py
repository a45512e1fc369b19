"""Shared folder, written tables, size-checked semi joins."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.shared import bound_batches, work_dir

#: A word is a run of any characters but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids that may be broadcast: 8 bytes each, so about 16 MB of data.
BROADCAST_IDS = 1_000_000
#: Rows with strings or arrays that may be broadcast, by their bytes.
BROADCAST_BYTES = 32 << 20


#: Folders of scratch tables that this process has asked for.
MADE: list[str] = []


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch tables, or those of all operators called since
    ``len(MADE)`` was ``since``. For when the results that read them are
    written or no longer needed: results are lazy and read these tables."""
    while len(MADE) > since:
        delete(spark, MADE.pop())


class Scratch:
    """Tables written to the shared folder to cut lineage: an executor that is
    lost later costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, work_dir(spark, name), 0
        self.paths: list[tuple[DataFrame, str]] = []
        MADE.append(self.root)
        bound_batches(spark)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.paths[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that save() returned and nothing reads any more."""
        for df, path in [x for x in self.paths if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
            self.paths.remove((df, path))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now,
    rather than whenever the driver next collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns what a Python worker has freed to the system: it counts as the
    executor's memory, and workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch of large rows.
BATCH_BYTES = 4 << 20


def bound_bytes(spark: SparkSession) -> None:
    """Lets rows go to Python in batches of about BATCH_BYTES at most (a larger
    row stands alone), where bound_batches' number of them is too many."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``names`` has it
    (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def aside(docs: DataFrame, *seen: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but ``seen`` under a name that no operator uses,
    and the columns that select all of them back, in order."""
    told = {c: c if c in seen else f"aside{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(f"`{c}`").alias(t) for c, t in told.items()]), [F.col(t).alias(c) for c, t in told.items()]


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """About how many bytes the column holds: the size of the files that are
    read, by the optimizer's statistics, else (rows of the driver, results of
    Python) by a scan."""
    known = int(str(docs.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def pieces(size: int, each: int, least: int = 64) -> int:
    """A power of two: as many pieces of ``each`` bytes as there are."""
    return 1 << max(least - 1, -(-size // each) - 1).bit_length()


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """Rows of a few numbers, marked for broadcast if they are at most ``limit``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bounded_bytes(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if the rows' sizes sum to at most
    ``limit``."""
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= limit else df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """df's rows whose key is in ids (a written table): by broadcast if it has
    at most ``limit`` rows, else by a shuffled join."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, how)
