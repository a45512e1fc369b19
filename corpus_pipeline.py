"""Documents to training shards in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it back as the next one's
docs. All but the last return the columns of documents. Extra columns pass
through unchanged, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import common, decontam, mixing, quality, shards, simjoin
from lexigrid.llm.common import Scratch, aside, fresh, keep_ids
from lexigrid.shared import work_dir

#: Score from which a document passes.
QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score passes. Null and empty texts are scored
    like others; every repeated row is judged alike."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = aside(docs, "doc_id", "text")
    return quality.score(rows, model, keep_text=True).where(F.col("score") >= QUALITY).select(*back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.
    Rows equal in id and text are one document; documents without words, or
    with a null id, are all kept."""
    scratch = Scratch(spark, "pipeline")
    groups = scratch.save(simjoin.similar_groups(docs.select("doc_id", "text")).select("doc_id", "component_id"))
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = scratch.save(kept)
    out = keep_ids(docs.where("doc_id is not null"), kept.select("doc_id"), "doc_id")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.union(docs.where("doc_id is null").select(*out.columns)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no contaminating share of a benchmark item."""
    found = decontam.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_row=True)
    row = fresh(docs.columns, "row")
    bad = Scratch(spark, "pipeline").save(found.where("contaminated").select(F.col("row").alias(row)).distinct())
    return keep_ids(docs.withColumn(row, decontam.row_key()), bad, row, "left_anti").select(*docs.columns)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: sources at their target weights, a row for each
    copy the mix takes. The last copy of a source may be cut after a word, and
    its n_chars says what is left. Documents without words are not taken."""
    rows, back = aside(docs, "doc_id", "text", "source", "n_chars")
    rows = mixing.expand(mixing.mix(rows))
    n_chars = F.when(F.col("words") < F.col("size"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes compacted shards under a committed manifest; doc_id, chars and
    shard of every row."""
    store = shards.ShardStore(spark, work_dir(spark, "shards"))
    store.append(docs)
    store.compact()
    store.vacuum()
    rows = store.read()
    return rows.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.col(rows.columns[-1]).alias("shard"))


STAGES = [("quality", classify), ("jaccard", deduplicate), ("decontamination", decontaminate), ("mixing", blend), ("sharding", shard)]

#: A trained model decides the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for name, stage in STAGES:
        since = len(common.MADE)
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        common.clean(spark, since)  # the stage's result is written
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
