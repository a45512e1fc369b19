"""Running n-gram counts over a stream of documents (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.counting import count_ngrams, prepare


def stream_documents(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_counts(stream: DataFrame, kind: str, n: int) -> DataFrame:
    """Counts so far, for output mode complete or update. The state holds a row
    per distinct n-gram: bounded for characters, unbounded for words."""
    return count_ngrams(prepare(stream), kind, n)


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, kind: str, n: int) -> DataFrame:
    """Counts per event-time window, closed by a watermark, so that the state
    of word n-grams stays bounded."""
    from lexigrid.functions.grams import char_grams, word_grams
    from lexigrid.functions.text import normalize

    make = word_grams if kind == "word" else char_grams
    rows = stream.withWatermark(ts, late).select(F.window(ts, width).alias("window"), normalize(F.col("text")).alias("norm"), ts)
    return rows.select("window", F.explode(make(F.col("norm"), n)).alias("ngram")).groupBy("window", "ngram").agg(F.count("*").alias("frequency"))
