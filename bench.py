"""Times the headline counts at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The tables' files are single row groups, which one task reads; the queries deal
so small a table over all cores themselves (sources.corpus.spread). Each time
is the smaller of two runs after one that compiles. mb is the text's size, and
mb_per_s_core what all_counts gets through on each core."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("word_bigrams", "word_trigrams", "char_bigrams", "char_trigrams", "all_counts", "top_word_bigrams", "normalized_text", "compare_same")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lexigrid.plans.catalog import catalog

    queries, took = catalog(), {}
    for name in HEADLINE:
        best = []
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            queries[name][0](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        took[name] = round(min(best[1:]), 3)
    from pyspark.sql import functions as F

    text = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mb = text.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    speed = round(mb / took["all_counts"] / int(CPUS), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "mb": round(mb, 1), "cores": int(CPUS), "mb_per_s_core": speed}))


if __name__ == "__main__":
    main()
