"""Readers: text corpora, n-gram tables, run statistics."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("lexigrid")

NGRAM_SCHEMA = "ngram string, frequency bigint"
# Names of the metrics that are counts, and of those that are text.
INT_METRICS = ("threads", "word_bigrams", "word_trigrams", "char_bigrams", "char_trigrams")
TEXT_METRICS = ("data_layout",)
#: Metrics of a run, in the order in which they are written.
METRICS = ("threads", *[f"{c}_{m}" for c in ("wall", "cpu") for m in ("mean", "min", "max", "std", "cv")], *INT_METRICS[1:])
#: Inputs of fewer bytes than this are dealt anew by spread().
SMALL = 256 << 20


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id = file path, text): every ``*.txt`` directly in a folder, each
    file whole. Files that vanish, can't be read or are empty (they have no
    n-gram) are skipped. A missing folder, or one without such a file, is an error."""
    df = (
        spark.read.option("pathGlobFilter", "*.txt")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .text(path, wholetext=True)
    )
    if not df.inputFiles():
        raise FileNotFoundError(f"no .txt file in {path}")
    return df.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def from_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table of documents."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, since its files may be a single row
    group, which one task reads. Larger ones have splits enough and stay."""
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_ngram_csv(spark: SparkSession, path: str) -> DataFrame:
    """An n-gram table back from CSV. Of repeated n-grams the last stands;
    lines whose number is malformed are skipped with a warning; a missing file
    is an empty table, with a warning."""
    try:
        raw = spark.read.schema("ngram string, digits string").csv(path).where("ngram is not null")
    except AnalysisException as e:
        if not missing(e):
            raise
        log.warning("no file %s", path)
        return spark.createDataFrame([], NGRAM_SCHEMA)
    number = F.regexp_extract("digits", r"^\s*\+?(\d+)", 1)  # as far as it is a number
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = raw.select("ngram", "digits", number.try_cast("bigint").alias("frequency"), place.alias("place"))
    header = (F.col("ngram") == "ngram") & (F.col("digits") == "frequency")
    bad = rows.where(F.col("frequency").isNull() & ~F.coalesce(header, F.lit(False))).count()
    if bad:
        log.warning("%d lines of %s have no number", bad, path)
    return rows.where("frequency is not null").groupBy("ngram").agg(F.max_by("frequency", "place").alias("frequency"))


def read_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of ``key,value`` lines: counts bigint, the layout's
    name a string, others double. A malformed number is null."""
    raw = spark.read.schema("metric string, value string").csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    wide = raw.withColumn("file", F.col("_metadata.file_path")).groupBy("file").pivot("metric").agg(F.first("value"))
    kind = lambda c: "bigint" if c in INT_METRICS else "string" if c in TEXT_METRICS else "double"
    return wide.select("file", *[F.expr(f"try_cast(`{c}` as {kind(c)})").alias(c) for c in wide.columns if c != "file"])


# How a metric's line begins in the text form, in either spelling.
TXT_LABELS = {"mean": "Mean", "min": "Min(?:imum)?", "max": "Max(?:imum)?", "std": "Std(?: Deviation)?", "cv": r"(?:CV|Coeff\. Variation)"}
TXT_UNIQUE = {"word_bigrams": "Word Bigrams", "word_trigrams": "Word Trigrams", "char_bigrams": "Char Bigrams", "char_trigrams": "Char Trigrams"}


def txt_patterns() -> dict[str, str]:
    """A pattern for each metric. The times stand in two blocks of like lines."""
    out = {"threads": r"(?i)threads(?: used)?:\s*(\d+)"}
    for kind in ("wall", "cpu"):
        out |= {f"{kind}_{m}": rf"(?si)\b{kind}(?:-clock)?(?: time)?.*?\b{label}:\s*([0-9.]+)" for m, label in TXT_LABELS.items()}
    return out | {k: rf"(?i){label}:\s*(\d+)" for k, label in TXT_UNIQUE.items()}


def read_stats_txt(spark: SparkSession, path: str) -> DataFrame:
    """The same metrics from free text; an absent one is null."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    pick = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return raw.select("file", *[pick(p).try_cast("bigint" if k in INT_METRICS else "double").alias(k) for k, p in txt_patterns().items()])


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of every ``threads_*`` folder under root, all metrics that
    its files have; a folder's CSV is preferred to its text form. The key is
    the thread count in the file."""
    frames = []
    for rank, (name, read) in enumerate((("performance_stats.csv", read_stats_csv), ("performance_stats.txt", read_stats_txt))):
        try:
            df = read(spark, f"{root}/threads_*/{name}")
        except AnalysisException as e:
            if not missing(e):
                raise
            continue
        folder = F.regexp_extract("file", r"(.*/threads_[^/]*)/.*$", 1)
        frames.append(df.select(folder.alias("folder"), F.lit(rank).alias("rank"), *[c for c in df.columns if c != "file"]))
    if not frames:
        raise FileNotFoundError(f"no statistics under {root}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    best = out.groupBy("folder").agg(F.min_by(F.struct(*[c for c in out.columns if c != "folder"]), "rank").alias("s"))
    return best.select("s.*").drop("rank").where("threads is not null").orderBy("threads")


def book_ids(spark: SparkSession, first: list[int], upto: int) -> DataFrame:
    """Download list: chosen ids and 1..upto, each once, in order. (Fetching
    is left to other tools.)"""
    chosen = spark.createDataFrame([(int(i),) for i in first], "book_id bigint")
    return chosen.union(spark.range(1, upto + 1).toDF("book_id")).distinct().orderBy("book_id")


def thread_count(value: object) -> int:
    """A parallelism setting from user input: an integer in 1..1000."""
    n = int(str(value).strip())
    if not 1 <= n <= 1000:
        raise ValueError(f"{n} is not in 1..1000")
    return n
