"""Counting and ranking n-grams.

Each task counts its own buffers of text and sends distinct n-grams with their
counts through one hash exchange; a hot n-gram therefore sends one row per
buffer. Ranking adds one range exchange (all_sorted) or none (top_n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.batches import counter
from lexigrid.functions.grams import char_grams, spaced, word_grams
from lexigrid.functions.text import clean, normalize, words
from lexigrid.shared import bound_batches

COUNTS = "kind string, ngram string, frequency bigint"
#: Longest n-grams of letters that a 64-bit number holds.
LONGEST = 13
#: name -> (token kind, n): the four tables of the job.
TABLES = {"word_bigrams": ("word", 2), "word_trigrams": ("word", 3), "char_bigrams": ("char", 2), "char_trigrams": ("char", 3)}


def prepare(docs: DataFrame, strip: bool = False, punct: str = "space") -> DataFrame:
    """(doc_id, norm): boilerplate removed on request, then normalized."""
    text = clean(F.col("text")) if strip else F.col("text")
    return docs.select("doc_id", normalize(text, punct).alias("norm"))


def count_ngrams(prepared: DataFrame, kind: str, n: int, *by: str) -> DataFrame:
    """(ngram, frequency) of one kind, per value of the columns ``by`` if any."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if kind not in ("word", "char"):
        raise ValueError(f"kind must be 'word' or 'char', not {kind!r}")
    if not by and (kind == "word" or n <= LONGEST):
        return count_batches(prepared, (kind, kind, n)).groupBy("ngram").agg(F.sum("frequency").alias("frequency"))
    if kind == "word":
        return prepared.select(*by, F.explode(word_grams(F.col("norm"), n)).alias("ngram")).groupBy(*by, "ngram").agg(F.count("*").alias("frequency"))
    compact = prepared.select(*by, F.explode(char_grams(F.col("norm"), n)).alias("g")).groupBy(*by, "g").agg(F.count("*").alias("frequency"))
    return compact.select(*by, spaced(F.col("g")).alias("ngram"), "frequency")


def count_batches(prepared: DataFrame, *kinds: tuple[str, str, int]) -> DataFrame:
    """(kind, ngram, frequency) of each task's buffers, to be summed."""
    bound_batches(prepared.sparkSession)
    return prepared.select("norm").mapInArrow(counter(kinds), COUNTS)


def count_all(prepared: DataFrame) -> DataFrame:
    """(kind, ngram, frequency): the four tables from one scan and one
    normalization of the corpus."""
    return count_batches(prepared, *[(k, *v) for k, v in TABLES.items()]).groupBy("kind", "ngram").agg(F.sum("frequency").alias("frequency"))


def all_sorted(counts: DataFrame) -> DataFrame:
    """Every row by frequency, largest first; ties by n-gram."""
    return counts.orderBy(F.desc("frequency"), "ngram")


def top_n(counts: DataFrame, k: int) -> DataFrame:
    """The first k rows of all_sorted, without a full sort."""
    return counts.orderBy(F.desc("frequency"), "ngram").limit(k)


def summary(counts: DataFrame) -> DataFrame:
    """Per kind: distinct n-grams and occurrences."""
    return counts.groupBy("kind").agg(F.count("*").alias("total_unique"), F.sum("frequency").alias("total_count"))


def first_entries(counts: DataFrame) -> DataFrame:
    """Per kind: the top entry (ties: smallest n-gram)."""
    best = F.min(F.struct((-F.col("frequency")).alias("neg"), F.col("ngram").alias("ngram"))).alias("b")
    return counts.groupBy("kind").agg(best).select("kind", "b.ngram", (-F.col("b.neg")).alias("frequency"))


def vocabulary(prepared: DataFrame) -> DataFrame:
    """Distinct words and their counts."""
    return count_ngrams(prepared, "word", 1).toDF("word", "n")


def split_key(counts: DataFrame) -> DataFrame:
    """The tokens of each key in columns (at most three)."""
    part = F.split("ngram", " ")
    return counts.select("*", *[F.get(part, F.lit(i)).alias(f"token_{i + 1}") for i in range(3)], F.size(part).alias("length"))


def tokens_per_document(prepared: DataFrame) -> DataFrame:
    """Words and letters of each document."""
    return prepared.select("doc_id", F.size(words(F.col("norm"))).cast("bigint").alias("n_words"), F.length(F.replace("norm", F.lit(" "), F.lit(""))).cast("bigint").alias("n_letters"))
