"""The whole batch job: corpus folder in, four tables and a summary out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.counting import TABLES, count_all, prepare, summary
from lexigrid.operators.sinks import progress, write_exact, write_stats, write_stats_text
from lexigrid.operators.stats import run_stats
from lexigrid.sources.corpus import METRICS, read_corpus


def run_job(spark: SparkSession, corpus: str, out: str) -> DataFrame:
    """Counts once (one scan of the corpus), writes ``counts`` as Parquet by
    kind, then the four sorted CSV tables from it; returns the summary."""
    count_all(prepare(read_corpus(spark, corpus), strip=True)).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/counts")
    counts = spark.read.parquet(f"{out}/counts")
    for kind in TABLES:
        write_exact(counts.where(F.col("kind") == kind).drop("kind"), f"{out}/{kind}.csv")
    return summary(counts)


def benchmark_job(spark: SparkSession, docs: DataFrame, out: str, runs: int = 10, warmup: int = 2) -> DataFrame:
    """Times the whole processing of the texts, warm-ups first, and writes the
    statistics as CSV and text under ``threads_<n>``: threads, times, and how
    many distinct n-grams of each kind there are."""
    threads = spark.sparkContext.defaultParallelism
    rows = []
    for i in range(warmup + runs):
        wall, cpu = time.perf_counter(), time.process_time()
        count_all(prepare(docs, strip=True)).write.format("noop").mode("overwrite").save()
        rows.append((i, time.perf_counter() - wall, time.process_time() - cpu, i < warmup))
        progress(i, warmup + runs, *rows[-1][1:])
    unique = {r.kind: r.total_unique for r in summary(count_all(prepare(docs, strip=True))).collect()}  # of four kinds
    stats = run_stats(spark.createDataFrame(rows, "run int, wall double, cpu double, warmup boolean"))
    stats = stats.withColumns({"threads": F.lit(threads), **{k: F.lit(unique.get(k, 0)) for k in TABLES}}).select(*METRICS)
    write_stats(stats, f"{out}/threads_{threads}/performance_stats.csv")
    write_stats_text(stats, f"{out}/threads_{threads}/performance_stats.txt")
    return stats
