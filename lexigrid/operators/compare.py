"""Comparing n-gram tables by one full outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def classify(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """(by.., ngram, left_freq, right_freq, status): match, mismatch, only_left or only_right."""
    a = left.select(*by, "ngram", F.col("frequency").alias("left_freq"))
    b = right.select(*by, "ngram", F.col("frequency").alias("right_freq"))
    status = (
        F.when(F.col("right_freq").isNull(), "only_left")
        .when(F.col("left_freq").isNull(), "only_right")
        .when(F.col("left_freq") == F.col("right_freq"), "match")
        .otherwise("mismatch")
    )
    return a.join(b, [*by, "ngram"], "full_outer").select(*by, "ngram", "left_freq", "right_freq", status.alias("status"))


def compare(name: str, left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Totals, matches, errors, verdict and accuracy in percent (100 when both
    are empty): one row, or one for each value of the columns ``by`` (all
    kinds of tables by one join)."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = classify(left, right, *by).groupBy(*by).agg(
        F.count("left_freq").alias("left_unique"), F.count("right_freq").alias("right_unique"),
        F.coalesce(F.sum("left_freq"), F.lit(0)).alias("left_total"), F.coalesce(F.sum("right_freq"), F.lit(0)).alias("right_total"),
        n("match").alias("matches"), n("mismatch").alias("mismatches"), n("only_left").alias("only_left"), n("only_right").alias("only_right"),
    )
    most = F.greatest("left_unique", "right_unique")
    return got.select(
        F.lit(name).alias("name"), "*",
        (F.col("mismatches") + F.col("only_left") + F.col("only_right") == 0).alias("is_correct"),
        F.when(most == 0, 100.0).otherwise(F.col("matches") / most * 100.0).alias("accuracy"),
    )


def verdict(comparisons: DataFrame) -> DataFrame:
    """All comparisons together: correct only if each is; overall accuracy is
    matches over matches and errors, 100 when there is nothing."""
    bad = F.col("mismatches") + F.col("only_left") + F.col("only_right")
    got = comparisons.agg(F.sum("matches").alias("matches"), F.sum(bad).alias("errors"), F.bool_and("is_correct").alias("is_correct"))
    both = F.col("matches") + F.col("errors")
    return got.select("matches", "errors", "is_correct", F.when(both == 0, 100.0).otherwise(F.col("matches") / both * 100.0).alias("accuracy"))


def examples(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """At most k n-grams of each kind of difference, smallest first."""
    w = W.partitionBy("status").orderBy("ngram")
    diff = classify(left, right).where("status <> 'match'")
    return diff.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of right whose n-gram is not in left."""
    return right.join(left, "ngram", "left_anti")


def agreement(programs: DataFrame) -> DataFrame:
    """programs(program, kind, total_unique): does every program's count of a
    kind equal that of the first program by name?"""
    first = programs.groupBy("kind").agg(F.min_by("total_unique", "program").alias("expected"))
    return programs.join(first, "kind").groupBy("program").agg(F.bool_and(F.col("total_unique") == F.col("expected")).alias("agrees"))
