"""Writers: n-gram tables, run statistics, text reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("lexigrid")


def write_exact(counts: DataFrame, path: str, header: bool = True) -> None:
    """Sorted n-gram CSV: the rows in order over all part files, ``"ngram",frequency`` a line; the
    first part file is the header. The alphabet needs no escaping."""
    text = counts.orderBy(F.desc("frequency"), "ngram").select(F.concat(F.lit('"'), "ngram", F.lit('",'), F.col("frequency").cast("string")).alias("line"))
    if header:
        line = counts.sparkSession.createDataFrame([("ngram,frequency",)], "line string").coalesce(1)
        text = line.unionByName(text)
    text.write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """One row of statistics as ``metric,value`` lines."""
    cols = stats.columns
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
    stats.selectExpr(f"stack({len(cols)}, {pairs}) as (metric, value)").coalesce(1).write.mode("overwrite").csv(path, header=True)


def report(table: DataFrame, title: str, limit: int = 1000) -> str:
    """A fixed-width text table of a small result (at most ``limit`` rows)."""
    rows = [table.columns, *[["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in table.limit(limit).collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
    lines = ["  ".join(v.rjust(n) for v, n in zip(r, width, strict=True)) for r in rows]
    out = "\n".join([title, "=" * len(title), lines[0], "-" * len(lines[0]), *lines[1:]])
    log.info("%s", out)
    return out


# Labels and units of the text form.
TIMES = (("mean", "Mean", "s"), ("min", "Min", "s"), ("max", "Max", "s"), ("std", "Std", "s"), ("cv", "CV", "%"))
UNIQUE = (("word_bigrams", "Word Bigrams"), ("word_trigrams", "Word Trigrams"), ("char_bigrams", "Char Bigrams"), ("char_trigrams", "Char Trigrams"))


def write_stats_text(stats: DataFrame, path: str) -> None:
    """One row of run statistics as text that read_stats_txt reads; metrics
    that the row lacks are left out."""
    have = set(stats.columns)
    line = lambda label, c, unit="": F.concat(F.lit(f"{label}: "), F.col(c).cast("string"), F.lit(unit and f" {unit}"))
    parts = [line("Threads", "threads")]
    for kind, title in (("wall", "WALL-CLOCK TIME:"), ("cpu", "CPU TIME:")):
        parts += [F.lit(f"\n{title}"), *[line(f"  {label}", f"{kind}_{m}", unit) for m, label, unit in TIMES if f"{kind}_{m}" in have]]
    parts += [F.lit("\nN-GRAM STATISTICS:"), *[line(f"  {label}", c) for c, label in UNIQUE if c in have]]
    stats.select(F.concat_ws("\n", *parts).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def progress(run: int, runs: int, wall: float, cpu: float, warmup: bool) -> str:
    """The line that a finished run logs."""
    text = f"[Run {run + 1}/{runs}{' WARM-UP' if warmup else ''}] {wall:.2f}s (cpu: {cpu:.2f}s)"
    log.info("%s", text)
    return text
