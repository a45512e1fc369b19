"""Benchmark decontamination by a prefix-filtered set join.
DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, bounded, bounded_bytes, keep_ids, lower_ascii

#: Words are runs of letters a-z, digits and any non-ASCII characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: Benchmark shingles that may be broadcast: 8 bytes each.
BROADCAST_SHINGLES = 1_000_000


def bench_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    count = F.size(words) - (n - 1)
    one = lambda i: F.xxhash64(F.lit(n), *[words[i + k] for k in range(n)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, len, words, win): every run of ``width`` words of an item, or all
    its words where it has fewer; items without words give none. win, two hashes
    of the words, is what a window is known by: items may share an id."""
    w = F.col("w")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), bench_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
    rows = rows.select("item", "w", F.explode(starts).alias("at"))
    rows = rows.select("item", F.least(F.size(w), F.lit(width)).alias("len"), F.slice(w, F.col("at") + 1, width).alias("words"))
    return rows.select("*", F.struct(F.xxhash64("len", "words").alias("a"), F.xxhash64(F.lit(1), "len", "words").alias("b")).alias("win")).distinct()


def row_key() -> Column:
    """What a row of documents is known by: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id").isNull().cast("int"), F.col("doc_id"), F.col("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    1. Every shingle (3 words) of the documents is looked up among those of
       the benchmark's windows; what matches is kept with its position.
    2. Shingles are ordered by rarity in the documents. To hold a window a
       document must hold its rarest shingle, so that one is its prefix; a
       window with a shingle that occurs nowhere is dropped.
    3. A match of a prefix fixes where the window would start; the start and
       the document's length bound it.
    4. The words there are compared with the window's, exactly.

    A document's word is hit if any occurrence covers it; it is contaminated
    if hit words are at least 1 / share of its words. Null or empty texts have
    no words. Repeated rows each get the result. Null item ids count as one
    item with an empty id; items with one id are one item. Other columns are
    not looked at. Only what comes of the benchmark, and short lists of hits,
    are broadcast, if their bytes are few; else the joins shuffle."""
    scratch = Scratch(docs.sparkSession, "decontam")
    row = row_key().alias("row")
    windows = scratch.save(item_windows(benchmark, width))
    size = F.least("len", F.lit(SHINGLE))
    distinct = windows.select("win", "len", "words").distinct()
    parts = None
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())  # of 1, 2 and 3
    for n in sizes:
        some = distinct.where(size == n).select("win", "len", F.posexplode(shingle_hashes(F.col("words"), n)).alias("off", "h"))
        parts = some if parts is None else parts.union(some)
    counted = docs.select("doc_id", row, F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(BENCH_WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    if parts is None:
        found = docs.sparkSession.createDataFrame([], "row bigint, n_hit bigint, items array<string>")
    else:
        parts = scratch.save(parts)
        known = scratch.save(parts.select("h").distinct())
        lists = F.concat(*[shingle_hashes(F.col("w"), n) for n in sizes]) if len(sizes) > 1 else shingle_hashes(F.col("w"), sizes[0])
        spans = docs.select(row, bench_words(F.col("text")).alias("w"))
        # positions run over the lists of all sizes; the size's list gives the offset back
        spans = spans.select("row", F.size("w").alias("n"), F.posexplode(lists).alias("i", "h"))
        hits = scratch.save(spans.join(bounded(known, BROADCAST_SHINGLES), "h"))
        seen = hits.groupBy("h").agg(F.count("*").alias("df"))
        ranked = parts.join(seen, "h", "left").groupBy("win", "len").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min(F.struct("df", "h", "off")).alias("p"))
        prefix = scratch.save(ranked.where("least > 0").select("len", "p.h", "p.off").distinct())
        base, starts = F.lit(0), None
        for n in sizes:  # where the list of this size begins
            here = F.when(F.least("len", F.lit(SHINGLE)) == n, F.col("i") - base)
            starts = here if starts is None else F.coalesce(starts, here)
            base = base + F.greatest(F.col("n") - (n - 1), F.lit(0))
        cand = hits.join(bounded(prefix, BROADCAST_SHINGLES), "h").withColumn("start", starts - F.col("off"))
        cand = cand.where("start >= 0 and start + len <= n").select("row", "start", "len").distinct()
        cand = scratch.save(cand)
        spots = cand.groupBy("row").agg(F.collect_list(F.struct("start", "len")).alias("spots"))
        texts = keep_ids(docs.select(row, "text"), scratch.save(cand.select("row").distinct()), "row").distinct()
        there = texts.select("row", bench_words(F.col("text")).alias("w")).join(spots, "row")
        cuts = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.slice("w", s["start"] + 1, s["len"]).alias("words")))
        there = there.select("row", F.explode(cuts).alias("c")).select("row", "c.*")
        exact = scratch.save(there.join(bounded_bytes(windows.select("item", "words"), F.octet_length(F.array_join("words", " ")) + F.octet_length("item") + 400), "words").select("row", "start", "len", "item").distinct())
        end = F.col("start") + F.col("len")
        w = W.partitionBy("row").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
        covered = exact.select("row", "start", "len").distinct().withColumn("upto", F.coalesce(F.max(end).over(w), F.lit(0)))
        n_hit = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "upto"))).cast("bigint").alias("n_hit"))
        items = exact.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
        found = scratch.save(n_hit.join(items, "row"))
    out = counted.join(bounded_bytes(found, F.octet_length(F.array_join("items", " ")) + 8 * F.size("items") + 64), "row", "left")
    hit, names = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", *["row"] * keep_row, "n_words", hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )
