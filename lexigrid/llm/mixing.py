"""Mixing sources to target weights along a time-varying curriculum.
DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, aside, word_count

#: Bucket totals that may be broadcast (three numbers each).
BROADCAST_BUCKETS = 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes(source, source_size) with weight, target and slope.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total. A target above cap * source_size stops there and the excess is
    reshared by weight until none is above. In order of cap * size / weight
    the stopped sources come first, so running sums give the fixed point at
    once. All sums are whole numbers. ``slope`` is the source's schedule: its
    weight at training time t in [0, 1] is proportional to 1 + slope * (2t - 1)."""
    one = F.lit(0).alias("one")
    rows = sizes.select("source", F.col("source_size").cast("bigint").alias("source_size"), one)
    by_name = W.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("n", F.count("*").over(W.partitionBy("one")))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("bigint"))
    most = (F.col("source_size") * cap).alias("most")
    rows = rows.withColumn("most", most).withColumn("total", F.sum("source_size").over(W.partitionBy("one")))
    w = W.partitionBy("one").orderBy(F.col("most") / F.col("weight"), "rank")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("over", F.col("left") * F.col("weight") > F.col("most") * F.col("w_left"))
    rows = rows.withColumn("stopped", F.min("over").over(w.rowsBetween(W.unboundedPreceding, 0)))
    free = ~F.col("stopped")
    everything = W.partitionBy("one")
    rest = F.col("total") - F.sum(F.when(free, 0).otherwise(F.col("most"))).over(everything)
    weight = F.sum(F.when(free, F.col("weight")).otherwise(0)).over(everything)
    target = F.when(free, (F.col("weight") * rest).cast("double") / weight.cast("double")).otherwise(F.col("most").cast("double"))
    slope = F.when(F.col("n") > 1, 0.8 - 1.6 * F.col("rank") / (F.col("n") - 1)).otherwise(0.0)
    return rows.select("source", "source_size", F.col("weight"), target.alias("target"), slope.alias("slope"))


#: Columns that mix() adds; stream is what expand() needs to know.
ADDED = ["size", "source_size", "target", "taken", "position", "stream"]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """docs with size (words), source_size, target, taken (words that the mix
    takes of it, repeats counted), position, and stream.

    Each source is a stream: its documents in md5 order of doc_id, repeated.
    The mix takes the first ``round(target)`` words of the stream: whole
    passes, then a part of one that may end inside a document. position is the
    training time at which the stream reaches the document's first copy: the
    source's schedule is integrated to its cumulative demand, and that is
    inverted. It is null where nothing is taken. Null texts have size 0.
    Repeated rows are documents of their own.

    The running sum is two-level (totals of 4096 buckets of each source, then
    inside a bucket), so a source with a third of all rows is spread over as
    many tasks as there are buckets. Of each source only a row of totals is
    seen at once, by one task. Rows keep docs' own columns; docs' columns of the
    added names are replaced."""
    docs, back = aside(docs.drop(*ADDED), "doc_id", "text", "source")
    own = docs.columns
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = docs.select(*own, word_count(F.col("text")).alias("size"), order.alias("_order"), name.alias("_name"))
    sized = sized.withColumn("_bucket", F.substring("_order", 1, 3))
    scratch = Scratch(docs.sparkSession, "mixing")
    totals = scratch.save(sized.groupBy("_name", "source", "_bucket").agg(F.sum("size").alias("words")))
    goal = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_name"), "source_size", "target", "slope")
    start = F.coalesce(F.sum("words").over(W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = scratch.save(totals.select("_name", "_bucket", start.alias("_start")).join(goal, "_name"))
    few = buckets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    rows = sized.join(F.broadcast(buckets) if few else buckets, ["_name", "_bucket"])
    w = W.partitionBy("_name", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rows = rows.withColumn("_passes", passes).withColumn("_rest", F.round(F.col("target") - passes * F.col("source_size")).cast("bigint"))
    rows = rows.withColumn("_part", F.least("size", F.greatest(F.lit(0), F.col("_rest") - F.col("_before"))).cast("bigint"))
    rows = rows.withColumn("taken", (F.col("_passes") * F.col("size") + F.col("_part")).cast("bigint"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, training_time(F.col("_before"), F.col("target"), F.col("slope"))))
    stream = F.struct(F.col("_before").alias("before"), F.col("_passes").alias("passes"), F.col("_part").alias("part"), "slope")
    return rows.withColumn("stream", stream).select(*back, *ADDED)


def training_time(words, target, slope):
    """Inverse of target * ((1 - slope) * t + slope * t * t), the integral of
    the schedule, at so many words; in [0, 1]."""
    y = F.least(F.lit(1.0), words / target)
    lead = 1.0 - slope
    root = F.sqrt(lead * lead + 4.0 * slope * y)
    return F.when(y <= 0, 0.0).otherwise(2.0 * y / (lead + root))


def by_position(mixed: DataFrame) -> DataFrame:
    """One row per document, range-sorted by training position (ties and the
    documents that are not taken by doc_id)."""
    return mixed.drop("stream").orderBy("position", "doc_id")


def expand(mixed: DataFrame) -> DataFrame:
    """The training sequence: a row for each copy the mix takes (number
    ``copy``), range-sorted by its own position. The last copy of a source's
    stream may be cut after a word (``words`` of it are left). Columns of these
    two names are replaced; equal rows of mix() give equal copies."""
    mixed = mixed.drop("copy", "words")
    passes, part = F.col("stream.passes"), F.col("stream.part")
    n = passes + (part > 0).cast("bigint")
    # as many copies as whole passes, and one for the part: cap + 1 at most
    copies = F.when((n > 0) & (F.col("taken") > 0), F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = mixed.select("*", F.explode(copies).alias("copy"))
    rows = rows.withColumn("words", F.when(F.col("copy") < passes, F.col("size")).otherwise(part))
    at = training_time(F.col("stream.before") + F.col("copy") * F.col("source_size"), F.col("target"), F.col("stream.slope"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    # pieces end where a word ends; trailing blanks are a piece without a word
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("words"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut)
    return rows.withColumn("text", text).withColumn("position", at).drop("stream").orderBy("position", "doc_id", "copy")
