"""Golden file, edge cases, properties, round trips, streaming."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.functions.grams import grams
from lexigrid.functions.text import clean, normalize, words
from lexigrid.operators.counting import TABLES, count_all, count_ngrams, prepare, summary
from lexigrid.operators.compare import agreement, compare
from lexigrid.operators.sinks import report, write_exact, write_stats, write_stats_text
from lexigrid.plans.catalog import catalog, programs
from lexigrid.plans.job import run_job
from lexigrid.sources import corpus
from lexigrid.streaming.counts import running_counts

# The golden input and its distinct counts.
GOLDEN = """*** START OF THIS PROJECT GUTENBERG EBOOK TEST ***

This is a test book. The cat sat on the mat. The cat sat on the mat.
The dog ran in the park. The dog ran in the park.
Hello world hello world.

Some numbers: 123 456 789 (should be removed).
Some punctuation: hello, world! test.

Accented chars: café naïve résumé.

*** END OF THIS PROJECT GUTENBERG EBOOK TEST ***
"""
UNIQUE = {"word_bigrams": (34, 47), "word_trigrams": (37, 46), "char_bigrams": (91, 187), "char_trigrams": (124, 186)}


def test_golden(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book.txt").write_text(GOLDEN)
    (tmp_path / "in" / "note.md").write_text("skipped")
    got = {r.kind: (r.total_unique, r.total_count) for r in run_job(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == UNIQUE
    back = corpus.read_ngram_csv(spark, str(tmp_path / "out" / "word_bigrams.csv"))
    assert back.count() == 34 and back.where("ngram = 'hello world'").first().frequency == 3


def test_missing_corpus(spark, tmp_path):
    with pytest.raises(Exception):
        corpus.read_corpus(spark, str(tmp_path))


@pytest.mark.parametrize(
    ("text", "want"),
    [("don't", "don t"), ("don’t", "dont"), ("a—b", "ab"), ("route 66 west", "route  west"), ("abc1def", "abcdef"), ("Æther straße", "ther strae"), ("a\x0bb\x0cc", "abc"), ("İK", "k")],
)
def test_normalize(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(normalize(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("A *** START OF x\nbody *** END OF y ***", " END OF y ***"), ("hdr *** START OF x", "hdr *** START OF x"), ("h ***START OF x*** b *** END OF z", "h ***START OF x*** b "), ("x *** START OF y ***", "")],
)
def test_clean(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(clean(F.col("t"))).first()[0] == want


def test_properties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = prepare(docs).cache()
    n = p.select(F.size(words(F.col("norm"))).alias("n"))
    total = {r.kind: r.total_count for r in summary(count_all(p)).collect()}
    assert total["word_bigrams"] == n.selectExpr("sum(greatest(n - 1, 0))").first()[0]
    assert total["word_trigrams"] == n.selectExpr("sum(greatest(n - 2, 0))").first()[0]
    assert count_all(p).where(~F.col("ngram").rlike("^[a-z]+( [a-z]+)*$")).count() == 0
    array_form = p.select(F.explode(grams(words(F.col("norm")), 3)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("frequency"))
    assert compare("forms", count_ngrams(p, "word", 3), array_form).first().is_correct
    assert compare("parts", count_ngrams(p, "char", 3), count_ngrams(p.repartition(13), "char", 3)).first().is_correct


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b c", 2), ("a b", 2), ("z z", 9)], "ngram string, frequency bigint")
    write_exact(df, str(tmp_path / "t"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "t").glob("part*")))
    assert text == 'ngram,frequency\n"z z",9\n"a b",2\n"b c",2\n'
    for k in (2, 8):
        stats = spark.createDataFrame([(k, 1.5 / k, 1.0, 2.0, 3.0)], "threads int, wall_mean double, wall_min double, wall_max double, cpu_mean double")
        write_stats(stats, str(tmp_path / f"s{k}"))
        (tmp_path / "runs" / f"threads_{k}").mkdir(parents=True)
        (tmp_path / "runs" / f"threads_{k}" / "performance_stats.csv").write_text("".join(f.read_text() for f in (tmp_path / f"s{k}").glob("part*")))
    (tmp_path / "runs" / "threads_4").mkdir()
    (tmp_path / "runs" / "threads_4" / "performance_stats.txt").write_text("Threads: 4\nWall time\nMean: 0.5 s\nMin: 0.4\nMax: 0.6\nCPU\nMean: 1.1\n")
    runs = corpus.discover_runs(spark, str(tmp_path / "runs"))
    assert [(r.threads, r.wall_mean) for r in runs.collect()] == [(2, 0.75), (4, 0.5), (8, 0.1875)]
    assert re.search("threads.*wall_mean", report(runs, "Runs"))


def test_stats_text(spark, tmp_path):
    row = (6, 1.5, 1.25, 2.0, 9.5, 9.0, 10.0)
    write_stats_text(spark.createDataFrame([row], "threads int, wall_mean double, wall_min double, wall_max double, cpu_mean double, cpu_min double, cpu_max double"), str(tmp_path / "t"))
    got = corpus.read_stats_txt(spark, str(tmp_path / "t")).first()
    assert (got.threads, got.wall_mean, got.wall_min, got.wall_max, got.cpu_mean) == (6, 1.5, 1.25, 2.0, 9.5)


def test_thread_count():
    assert corpus.thread_count(" 8 ") == 8
    with pytest.raises(ValueError):
        corpus.thread_count("1001")


def test_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream, "char", 2).writeStream.outputMode("complete").format("memory").queryName("bigrams").start()
    q.processAllAvailable()
    q.stop()
    assert compare("stream", spark.table("bigrams"), count_ngrams(prepare(docs), "char", 2)).first().is_correct


def test_tables():
    assert list(TABLES) == list(UNIQUE)


@pytest.mark.parametrize("buffer", [40, 10**7])
def test_batches_against_arrays(spark, monkeypatch, buffer):
    """Counts of batches against counts of arrays, n by n, over odd texts."""
    from lexigrid.functions import batches
    from lexigrid.functions.text import chars

    texts = ["the cat the cat", "", None, "  a  b ", "a", "x" * 3000, "b a\tthe", "Ünïcode ß 12 a-b", "the cat", " "]
    p = prepare(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2))
    monkeypatch.setattr(batches, "BUFFER", buffer)
    for kind, tokens in (("word", words), ("char", chars)):
        for n in (1, 2, 3, 4, 6):
            want = p.select(F.explode(grams(tokens(F.col("norm")), n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("frequency"))
            got = compare("forms", count_ngrams(p, kind, n), want).first()
            assert got.is_correct and got.left_unique == want.count(), (kind, n)


def test_spread(spark, monkeypatch, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    parts = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    assert parts(one) == 1 and parts(corpus.spread(one)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(corpus, "SMALL", 0)
    assert parts(corpus.spread(one)) == 1


def test_benchmark_job(spark, tmp_path):
    from lexigrid.plans.job import benchmark_job

    docs = spark.createDataFrame([(1, GOLDEN)], "doc_id int, text string")
    benchmark_job(spark, docs, str(tmp_path), runs=2, warmup=1)
    got = corpus.discover_runs(spark, str(tmp_path)).first()
    assert got.threads == spark.sparkContext.defaultParallelism and got.wall_min <= got.wall_mean <= got.wall_max
    assert {k: got[k] for k in UNIQUE} == {k: v[0] for k, v in UNIQUE.items()}


def test_progress():
    from lexigrid.operators.sinks import progress

    assert progress(0, 12, 1.234, 2.0, True) == "[Run 1/12 WARM-UP] 1.23s (cpu: 2.00s)"


def test_normalize_all_ascii(spark):
    """Every ASCII character and some others, in both modes, one by one."""
    some = [chr(i) for i in range(1, 128)] + list("ÀéîÕüñÇßÆ—’İ漢😀")
    df = spark.createDataFrame([(c,) for c in some], "t string")
    for punct in ("space", "drop"):
        for r in df.select("t", normalize(F.col("t"), punct).alias("n")).collect():
            c = r.t
            fold = dict(zip("ÀéîÕüñÇ", "aeiounc", strict=True)).get(c, c)
            if fold.isascii() and fold.isalpha():
                want = fold.lower()
            elif c in " \t\n\r" or (punct == "space" and c.isascii() and c.isprintable() and not c.isalnum()):
                want = " "
            else:
                want = ""
            assert r.n == want, (punct, c)


def test_programs_on_long_texts(spark, tmp_path):
    """Token arrays take time in proportion to a text: this one took minutes
    when the tokens were computed again for each n-gram."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "cat", "é-a", "x2y", "Sat"], k=15_000)), "one two", "a", "", None]
    write = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write(texts)
    began = time.time()
    got = programs(spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    want = {r.kind: r.total_unique for r in summary(count_all(prepare(spark.read.parquet(f"{tmp_path}/documents.parquet")))).collect()}
    assert {(r.program, r.kind): r.total_unique for r in got} == {(p, k): n for p in ("array", "batch", "regex") for k, n in want.items()}
    # no n-gram at all: the rows of the SQL
    write(["", None])
    sql = catalog()["program_agreement"][1]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, agreement(programs(spark, str(tmp_path))).collect())) == sorted(con.execute(sql).fetchall())
