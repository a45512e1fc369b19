"""Run statistics and scaling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(runs: DataFrame, *by: str) -> DataFrame:
    """Mean, min, max, population deviation and CV in percent of wall and CPU
    seconds; warm-up runs are left out."""
    kept = runs.where(~F.col("warmup"))
    aggs = []
    for c in ("wall", "cpu"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.stddev_pop(c).alias(f"{c}_std"), (F.stddev_pop(c) / F.avg(c) * 100).alias(f"{c}_cv")]
    return kept.groupBy(*by).agg(*aggs)


def speedup(summary: DataFrame, baseline: DataFrame) -> DataFrame:
    """Speedup, efficiency and scalability in percent against a one-row
    baseline(base)."""
    return summary.crossJoin(F.broadcast(baseline.limit(1))).select(
        "threads", "wall_mean", (F.col("base") / F.col("wall_mean")).alias("speedup"),
        (F.col("base") / F.col("wall_mean") / F.col("threads")).alias("efficiency"),
        (F.col("base") / F.col("wall_mean") / F.col("threads") * 100).alias("scalability_pct"),
    )


def layout_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a - b) / a in percent for the thread counts that both have."""
    return a.select("threads", F.col("wall_mean").alias("a")).join(b.select("threads", F.col("wall_mean").alias("b")), "threads").select("threads", "a", "b", ((F.col("a") - F.col("b")) / F.col("a") * 100).alias("diff_pct"))


def best_run(summary: DataFrame) -> DataFrame:
    """The thread count with the smallest mean wall time."""
    return summary.agg(F.min_by("threads", F.struct("wall_mean", "threads")).alias("threads"), F.min("wall_mean").alias("wall_mean"))


def common_threads(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("threads").intersect(b.select("threads")).orderBy("threads")


def all_threads(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("threads").union(b.select("threads")).distinct().orderBy("threads")


def first_number(text: str) -> Column:
    """Digits of the first word that holds any."""
    digits = F.regexp_replace(F.regexp_extract(F.col(text), r"(\S*\d\S*)", 1), r"\D", "")
    return F.nullif(digits, F.lit("")).cast("bigint")


def sweep_summary(threads: DataFrame, stats: DataFrame, metrics: tuple[str, ...] = ("wall_mean",), failed: DataFrame | None = None) -> DataFrame:
    """A line for each thread count that was asked for. A run without figures
    shows N/A, one that is in failed(threads) ERROR."""
    runs = threads.join(stats.select("threads", *metrics), "threads", "left")
    bad = F.lit(False)
    if failed is not None:
        runs = runs.join(failed.select("threads", F.lit(True).alias("failed")).distinct(), "threads", "left")
        bad = F.coalesce("failed", F.lit(False))
    text = lambda c: F.when(bad, "ERROR").when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.3f", F.col(c))).alias(c)
    return runs.select("threads", *map(text, metrics))
