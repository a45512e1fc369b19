"""Immutable shards under a versioned manifest, compacted by size tiers."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lexigrid.llm.common import delete, fresh

MANIFEST = "shard string, bytes bigint, rows bigint, tier int"
#: Rows of a manifest that may be broadcast.
BROADCAST_SHARDS = 200_000
#: Times that a writer begins anew after another has committed first.
RETRIES = 20
#: Seconds after which vacuum() takes a writer that has not committed for dead.
ABANDONED = 7 * 24 * 3600


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    """A table under ``root`` (a path of any file system that Spark knows).

    Data files are never changed. A version is the folder ``manifest/<n>``, a
    Parquet list of live shards that is written aside and renamed into place:
    readers see the old version or the new one, and of two writers one gets
    Conflict and begins anew. An executor lost while writing costs a retried
    task, since only files of committed tasks enter a manifest.

    A writer leaves a mark in ``writing/`` before it writes its folder of data
    and takes it away once its version stands, so that vacuum() spares files
    that no version lists yet.

    Rows may hold nulls anywhere, repeat or tie; they are kept as they are. A
    table without rows is a version without shards. No column name is reserved.
    The driver holds names of shards (one per 64 MB), never rows."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.schema = None  # of the last arrival

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; -1 before the first."""
        p, fs = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return -1
        return max([int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()], default=-1)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{v:08d}")

    def commit(self, live: DataFrame, base: int) -> int:
        """Makes ``live`` version base + 1, atomically."""
        aside = f"{self.root}/manifest-{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(aside)
        jvm = self.spark.sparkContext._jvm
        parent, fs = self._fs(f"{self.root}/manifest")
        fs.mkdirs(parent)
        src, _ = self._fs(aside)
        dst, _ = self._fs(f"{self.root}/manifest/{base + 1:08d}")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(src, dst, options)
        except Exception as e:
            delete(self.spark, aside)
            if not fs.exists(dst):
                raise
            raise Conflict(f"version {base + 1} exists") from e
        return base + 1

    def begin(self) -> str:
        """The name of a new folder of data, marked as being written."""
        name = uuid.uuid4().hex
        p, fs = self._fs(f"{self.root}/writing/{name}")
        fs.mkdirs(p)
        return name

    def end(self, name: str, committed: bool) -> None:
        """Takes the mark away; the data too unless they are committed."""
        if not committed:
            delete(self.spark, f"{self.root}/data/{name}")
        delete(self.spark, f"{self.root}/writing/{name}")

    def _written(self, name: str) -> DataFrame:
        """Manifest rows of the files of a folder; reads footers only."""
        size = F.col("bytes").cast("double")
        tier = F.greatest(F.lit(0), F.floor(F.log(size / (self.target / self.fanout**4)) / F.log(F.lit(float(self.fanout))))).cast("int")
        try:
            written = self.spark.read.parquet(f"{self.root}/data/{name}")
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return self.spark.createDataFrame([], MANIFEST)  # no partition, so no file
        files = written.groupBy(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return files.select("shard", "bytes", "rows", tier.alias("tier"))

    def append(self, df: DataFrame) -> int:
        """Each partition of the arrivals becomes a shard, without a shuffle.
        An empty arrival commits a version with nothing new. Where another
        writer commits first, the same files enter the version after it."""
        name, done = self.begin(), False
        self.schema = df.schema
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
            new = self.spark.createDataFrame(self._written(name).collect(), MANIFEST)
            for _ in range(RETRIES):
                base = self.version()
                try:
                    got = self.commit(self.manifest(base).unionByName(new), base)
                    done = True
                    return got
                except Conflict:
                    continue
            raise Conflict(f"{RETRIES} versions came first")
        finally:
            self.end(name, done)

    def plan(self, version: int) -> DataFrame:
        """(shard, bytes, grp): runs of shards to merge. Shards of one tier are
        taken by size and cut where they fill a target-sized file; a run stays
        if it neither fills half of one nor has ``fanout`` members."""
        w = W.partitionBy("tier").orderBy("bytes", "shard")
        small = self.manifest(version).where(F.col("bytes") < self.target / 2)
        cum = F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, -1))
        runs = small.withColumn("cut", F.floor(F.coalesce(cum, F.lit(0)) / self.target))
        group = W.partitionBy("tier", "cut")
        runs = runs.withColumn("n", F.count("*").over(group)).withColumn("sum", F.sum("bytes").over(group))
        runs = runs.where((F.col("n") >= self.fanout) | ((F.col("n") > 1) & (F.col("sum") >= self.target / 2)))
        return runs.select("shard", "bytes", (F.dense_rank().over(W.orderBy("tier", "cut")) - 1).alias("grp"))

    def keys(self, groups: int) -> DataFrame:
        """(grp, key): for each group a number that Spark's hash partitioning
        into so many parts puts into a part of its own."""
        part = F.pmod(F.hash("id"), F.lit(groups)).alias("grp")
        # a group gets no number with probability exp(-50); it then shares a part
        some = self.spark.range(50 * groups).groupBy(part).agg(F.min("id").alias("key"))
        return self.spark.range(groups).select(F.col("id").cast("int").alias("grp")).join(some, "grp", "left").select("grp", F.coalesce("key", "grp").alias("key"))

    def compact(self) -> int:
        """Merges until no run is left; each pass is one committed version, and
        one that another writer came before is planned anew. A merged file is
        one task's, of at most 1.5 times the target."""
        while True:
            base = self.version()
            plan = self.plan(base).persist()
            shards = [r.shard for r in plan.select("shard").collect()]
            if not shards:
                plan.unpersist()
                return base
            name, done = self.begin(), False
            try:
                groups = plan.agg(F.max("grp")).first()[0] + 1
                rows = self.spark.read.parquet(*shards)
                shard, grp, key = (fresh(rows.columns, c) for c in ("shard", "grp", "key"))
                runs = plan.join(self.keys(groups), "grp").select(F.col("shard").alias(shard), F.col("grp").alias(grp), F.col("key").alias(key))
                rows = rows.withColumn(shard, F.col("_metadata.file_path"))
                rows = rows.join(F.broadcast(runs) if len(shards) <= BROADCAST_SHARDS else runs, shard).drop(shard)
                rows.repartition(groups, key).drop(key).write.option("compression", "zstd").partitionBy(grp).parquet(f"{self.root}/data/{name}")
                live = self.manifest(base).join(plan.select("shard"), "shard", "left_anti")
                self.commit(live.unionByName(self._written(name)), base)
                done = True
            except Conflict:
                continue
            finally:
                self.end(name, done)
                plan.unpersist()

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, with the shard of each row as its last
        column: ``shard``, with underscores added where the table has a column
        of that name itself."""
        shards = [r.shard for r in self.manifest(version).select("shard").collect()]
        if not shards and self.schema is None:
            raise FileNotFoundError(f"{self.root} has no data at this version")
        df = self.spark.read.parquet(*shards) if shards else self.spark.createDataFrame([], self.schema)
        file = F.regexp_extract(F.col("_metadata.file_path"), "/data/(.*)$", 1) if shards else F.lit("")
        return df.withColumn(fresh(df.columns, "shard"), file)

    def vacuum(self, versions: int = 1, abandoned: float = ABANDONED) -> int:
        """Deletes data files that none of the last ``versions`` versions list,
        for when no reader is left at an older one; the number deleted. Files
        of a writer that has not committed yet stay, unless it began over
        ``abandoned`` seconds ago."""
        data, fs = self._fs(f"{self.root}/data")
        if not fs.exists(data):
            return 0
        listed, files = fs.listFiles(data, True), []
        while listed.hasNext():
            files.append(listed.next().getPath())
        # the files first, then the marks, then the manifests: a writer whose
        # mark is gone by now has a version that the manifests include
        marks, _ = self._fs(f"{self.root}/writing")
        old = 1000 * (time.time() - abandoned)
        writing = {s.getPath().getName() for s in fs.listStatus(marks) if s.getModificationTime() >= old} if fs.exists(marks) else set()
        last = self.version()
        lists = [self.manifest(v).select("shard") for v in range(max(0, last - versions + 1), last + 1)]
        live = {r.shard.rpartition("/data/")[2] for r in reduce(DataFrame.union, lists).collect()} if lists else set()
        gone = 0
        for f in files:
            name = f.toString().rpartition("/data/")[2]
            if name.endswith(".parquet") and name not in live and name.partition("/")[0] not in writing:
                fs.delete(f, False)
                gone += 1
        return gone
