"""Every query with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.grams import char_grams, grams, word_grams
from lexigrid.functions.text import FOLD_FROM, FOLD_TO, char_class, chars, clean, normalize, words
from lexigrid.operators import compare as C
from lexigrid.operators import counting as K
from lexigrid.operators import sinks
from lexigrid.operators import stats as S
from lexigrid.shared import work_dir, write_file
from lexigrid.sources import corpus
from lexigrid.sources.corpus import book_ids, from_documents, spread

Query = Callable[[SparkSession, str], DataFrame]


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", *more))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return K.prepare(from_documents(docs(spark, d)))


# ---- SQL pieces -----------------------------------------------------------

NORM = (
    "lower(regexp_replace(regexp_replace(translate({t}, '" + FOLD_FROM + "', '" + FOLD_TO + "'), "
    r"'[0-9\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[^\x00-\x7F]', '', 'g'), '[^A-Za-z]', ' ', 'g'))"
)
DROP = "lower(regexp_replace(regexp_replace(translate({t}, '" + FOLD_FROM + "', '" + FOLD_TO + r"'), '[^A-Za-z \t\n\r]', '', 'g'), '[^A-Za-z]', ' ', 'g'))"
WORDS = "list_filter(string_split({n}, ' '), lambda w: w <> '')"
CHARS = "list_filter(string_split(replace({n}, ' ', ''), ''), lambda w: w <> '')"


def sql_norm(text: str = "text", form: str = NORM) -> str:
    return form.format(t=text)


def sql_grams(kind: str, n: int, source: str = "documents", more: str = "") -> str:
    """Select of (more,) ngram, one row per occurrence."""
    toks = (WORDS if kind == "word" else CHARS).format(n=sql_norm())
    key = " || ' ' || ".join(f"a[i + {k}]" if k else "a[i]" for k in range(n))
    return f"select {more} unnest(list_transform(range(1, len(a) - {n - 2}), lambda i: {key})) as ngram from (select {more} {toks} as a from {source})"


def sql_counts(kind: str, n: int, source: str = "documents") -> str:
    return f"select ngram, count(*) as frequency from ({sql_grams(kind, n, source)}) group by ngram"


SQL_ALL = " union all ".join(f"select '{k}' as kind, ngram, frequency from ({sql_counts(*v)})" for k, v in K.TABLES.items())


def counts(kind: str, n: int) -> Query:
    return lambda s, d: K.count_ngrams(prepared(s, d), kind, n)


def by_lang(s: SparkSession, d: str, english: bool) -> DataFrame:
    frame = docs(s, d, "lang")
    return K.count_ngrams(K.prepare(frame.where(F.col("lang") == "en") if english else frame.where(F.col("lang") != "en")), "word", 2)


EN, REST = (sql_counts("word", 2, f"(select * from documents where lang {op} 'en')") for op in ("=", "<>"))

# Edge cases of normalization and marker removal, as rows.
EDGES = ["don't", "don’t", "a—b", "route 66 west", "abc1def", "Æther straße", "a\x0bb\x0cc", "İK", "café naïve résumé", "Tab\tand\r\nline", ""]
MARKED = ["A *** START OF x\nbody *** END OF y ***", "hdr *** START OF x", "h ***START OF x*** b *** END OF z", "x *** START OF y ***", "p *** START OF a *** body text *** END OF a *** tail", ""]


def sql_rows(values: list[str]) -> str:
    quote = lambda v: " || ".join(["''"] + [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in v])
    return "(values " + ", ".join(f"({i}, {quote(v)})" for i, v in enumerate(values)) + ") as t(id, text)"


def rows(s: SparkSession, values: list[str]) -> DataFrame:
    return s.createDataFrame(list(enumerate(values)), "id int, text string").coalesce(1)


SQL_CLEAN = """
with a as (select *, strpos(text, '*** START OF') as s from {src}),
b as (select *, case when s > 0 and strpos(substr(text, s + 12), '***') > 0
    then s + 12 + strpos(substr(text, s + 12), '***') - 1 + 3 else 1 end as st from a),
c as (select *, strpos(substr(text, st), '*** END OF') as e from b)
select {key}, case when e > 0 then substr(text, st, e - 1) else substr(text, st) end as body from c"""

WRAP = ("head *** START OF BOOK ***", "*** END OF BOOK *** tail")

# Published mean wall seconds of the two layouts by thread count.
AOS = {1: 123.184, 2: 64.643, 4: 35.341, 8: 21.103, 12: 16.417, 16: 16.285, 32: 15.615, 40: 15.522, 50: 15.431, 60: 15.374, 70: 15.450, 80: 15.439, 90: 15.514, 100: 15.588}
SOA = {1: 124.267, 2: 65.236, 4: 35.192, 8: 20.934, 12: 16.289, 16: 16.024, 32: 15.577, 40: 15.404, 50: 15.372, 60: 15.381, 70: 15.382, 80: 15.357, 90: 15.468, 100: 15.559}
BASE = 104.93
RUNS = [(r, w, c, r < 2) for r, (w, c) in enumerate([(22.5, 160.0), (21.9, 159.5), (21.1, 158.25), (20.875, 157.5), (21.25, 158.75), (21.0, 158.0)])]


def layout(s: SparkSession, table: dict[int, float]) -> DataFrame:
    return s.createDataFrame(list(table.items()), "threads int, wall_mean double").coalesce(1)


def sql_layout(table: dict[int, float], name: str) -> str:
    return "(values " + ", ".join(f"({k}, {v}::double)" for k, v in table.items()) + f") as {name}(threads, wall_mean)"


SQL_RUNS = "(values " + ", ".join(f"({r}, {w}::double, {c}::double, {str(u).lower()})" for r, w, c, u in RUNS) + ") as r(run, wall, cpu, warmup)"
SQL_DIFF = f"select threads, a.wall_mean as a, b.wall_mean as b, (a.wall_mean - b.wall_mean) / a.wall_mean * 100 as diff_pct from {sql_layout(AOS, 'a')} join {sql_layout(SOA, 'b')} using (threads)"


def sql_compare(name: str, a: str, b: str) -> str:
    return f"""
with a as ({a}), b as ({b}),
j as (select a.frequency as l, b.frequency as r from a full outer join b on a.ngram = b.ngram),
c as (select count(l) as left_unique, count(r) as right_unique,
    cast(coalesce(sum(l), 0) as bigint) as left_total, cast(coalesce(sum(r), 0) as bigint) as right_total,
    count(*) filter (l = r) as matches, count(*) filter (l <> r) as mismatches,
    count(*) filter (r is null) as only_left, count(*) filter (l is null) as only_right from j)
select '{name}' as name, *, mismatches + only_left + only_right = 0 as is_correct,
    case when greatest(left_unique, right_unique) = 0 then 100.0::double
    else matches / greatest(left_unique, right_unique) * 100.0::double end as accuracy from c"""


def sql_compare_all(a: str, b: str) -> str:
    """A comparison for each kind of table."""
    one = sql_compare("languages", "select kind, ngram, frequency from a_", "select kind, ngram, frequency from b_")
    for old, new in (("j as (select a.frequency", "j as (select coalesce(a.kind, b.kind) as kind, a.frequency"), ("on a.ngram = b.ngram", "on a.kind = b.kind and a.ngram = b.ngram"), ("c as (select count(l)", "c as (select kind, count(l)"), ("from j)", "from j group by kind)")):
        assert old in one
        one = one.replace(old, new)
    return one.replace("with a as", f"with a_ as ({a}), b_ as ({b}), a as", 1)


def sql_all(where: str) -> str:
    return " union all ".join(f"select '{k}' as kind, ngram, frequency from ({sql_counts(*v, f'(select * from documents where {where})')})" for k, v in K.TABLES.items())


SQL_KINDS = sql_compare_all(sql_all("lang = 'en'"), sql_all("lang <> 'en'"))


def all_by_lang(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The four tables of English documents and of the others, each counted once."""
    frame = docs(s, d, "lang")
    return tuple(K.count_all(K.prepare(frame.where(c))) for c in (F.col("lang") == "en", F.col("lang") != "en"))


def programs(s: SparkSession, d: str) -> DataFrame:
    """(program, kind, total_unique) of three formulations of the four counts
    as three programs: batches of arrays, regex scans and token arrays. Each
    finds all its n-grams; a row of the one exchange is an n-gram with a bit
    for each program that found it. As in the SQL, the token arrays have no
    row of a kind without n-grams."""
    p = prepared(s, d)
    norm = F.col("norm")
    bit = {"batch": 1, "array": 2, "regex": 4}
    none = F.array().cast("array<string>")
    forms, sets = [], []
    for kind, (t, n) in K.TABLES.items():
        forms += [grams(words(norm), n).alias(f"a_{kind}"), word_grams(norm, n).alias(f"r_{kind}")] if t == "word" else [grams(chars(norm), n, "").alias(f"a_{kind}"), char_grams(norm, n).alias(f"r_{kind}")]
        a, r = F.col(f"a_{kind}"), F.col(f"r_{kind}")
        for bits, same, other in ((bit["array"] | bit["regex"], F.array_distinct(a), F.array_intersect(a, r)), (bit["array"], none, F.array_except(a, r)), (bit["regex"], none, F.array_except(r, a))):
            sets.append(F.struct(F.lit(kind).alias("kind"), F.lit(bits).alias("bits"), F.when(a == r, same).otherwise(other).alias("grams")))
    found = p.select(*forms).select(F.explode(F.array(*sets)).alias("x")).select("x.kind", F.explode("x.grams").alias("ngram"), "x.bits")
    batches = K.count_batches(p, *[(k, *v) for k, v in K.TABLES.items()])
    compact = F.when(F.col("kind").startswith("char"), F.replace("ngram", F.lit(" "), F.lit(""))).otherwise(F.col("ngram"))
    rows = found.union(batches.select("kind", compact, F.lit(bit["batch"])))
    each = rows.groupBy("kind", "ngram").agg(F.bit_or("bits").alias("bits")).groupBy("kind").agg(*[F.count_if(F.col("bits").bitwiseAND(b) > 0).alias(k) for k, b in bit.items()])
    kinds = s.range(1).select(F.explode(F.array(*map(F.lit, K.TABLES))).alias("kind"))
    total = F.explode(F.array(*[F.struct(F.lit(k).alias("program"), F.coalesce(k, F.lit(0)).alias("total_unique")) for k in bit]))
    out = kinds.join(each, "kind", "left").select("kind", total.alias("x")).select("x.program", "kind", "x.total_unique")
    return out.where("program <> 'array' or total_unique > 0")


# The four counts in two formulations: lists of n-grams, and tokens with those after them.
SQL_AGREE = "with l as (select kind, count(*) as n from ({all}) group by kind), ".format(all=SQL_ALL) + "".join(
    f"{t}_t as (select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as w from (select doc_id, {form.format(n=sql_norm())} as a from documents)), "
    f"{t}_n as (select w, lead(w) over x as w2, lead(w, 2) over x as w3 from {t}_t window x as (partition by doc_id order by i)), "
    for t, form in (("word", WORDS), ("char", CHARS))
) + "t as (" + " union all ".join(
    f"select '{k}' as kind, count(*) as n from (select distinct {', '.join(('w', 'w2', 'w3')[:n])} from {t}_n where w{n} is not null)" for k, (t, n) in K.TABLES.items()
) + """), p as (select 'array' as program, * from l union all select 'batch', * from t union all select 'regex', * from t),
f as (select kind, min_by(n, program) as first from p group by kind)
select program, bool_and(n = first) as agrees from p join f using (kind) group by program"""  # fmt: skip

# Small files as a corpus folder holds them; two are no part of it, and one is empty.
FILES = {"a.txt": "one  line\n\ttwo\r\n", "b.txt": "", "c.md": "not read", "sub/d.txt": "not read", "é.txt": "café"}


def corpus_files(s: SparkSession, d: str) -> DataFrame:
    """Files written to the shared folder, listed and read whole."""
    root = work_dir(s, "files")
    for name, text in FILES.items():
        write_file(s, f"{root}/{name}", text)
    got = corpus.read_corpus(s, root)
    return got.select(F.url_decode(F.regexp_extract("doc_id", "([^/]*)$", 1)).alias("file"), "text")


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A table written as CSV to the shared folder and read back."""
    path = work_dir(s, "table")
    sinks.write_exact(counts("word", 2)(s, d), path)
    return corpus.read_ngram_csv(s, path)


def csv_odd_lines(s: SparkSession, d: str) -> DataFrame:
    path = work_dir(s, "table")
    write_file(s, f"{path}/t.csv", 'ngram,frequency\n"a b",3\n"c d",x\n"a b",2\n"e f",12 \n"g h",\n\n"ngram",7\n')
    return corpus.read_ngram_csv(s, path).unionByName(corpus.read_ngram_csv(s, f"{path}/none"))


def stats_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Run statistics written in either form to folders of runs, found again."""
    root = work_dir(s, "runs")
    stats = S.run_stats(s.createDataFrame(RUNS, "run int, wall double, cpu double, warmup boolean"))
    for k, write in ((2, sinks.write_stats), (4, sinks.write_stats_text)):
        row = stats.withColumns({"threads": F.lit(k), **{c: F.lit(10 * k + i) for i, c in enumerate(K.TABLES)}}).select(*corpus.METRICS)
        write(row, f"{root}/threads_{k}/performance_stats.{'csv' if k == 2 else 'txt'}")
    return corpus.discover_runs(s, root).select(*[F.round(c, 9).alias(c) if c.endswith(("mean", "min", "max", "std", "cv")) else F.col(c) for c in corpus.METRICS])


def thread_counts(s: SparkSession, d: str) -> DataFrame:
    out = []
    for text in ("1", " 8 ", "1000", "0", "1001", "-3", "x", "2.5", ""):
        try:
            out.append((text, corpus.thread_count(text)))
        except ValueError:
            out.append((text, None))
    return s.createDataFrame(out, "text string, threads int").coalesce(1)


def catalog() -> dict[str, tuple[Query, str]]:
    q: dict[str, tuple[Query, str]] = {}
    for name, (kind, n) in K.TABLES.items():
        q[name] = (counts(kind, n), sql_counts(kind, n))
        q[f"top_{name}"] = (lambda s, d, k=kind, m=n: K.top_n(counts(k, m)(s, d), 20), f"{sql_counts(kind, n)} order by frequency desc, ngram limit 20")
    q["sorted_char_bigrams"] = (lambda s, d: K.all_sorted(counts("char", 2)(s, d)), f"{sql_counts('char', 2)} order by frequency desc, ngram")
    q["sorted_word_trigrams"] = (lambda s, d: K.all_sorted(counts("word", 3)(s, d)), f"{sql_counts('word', 3)} order by frequency desc, ngram")
    q["all_counts"] = (lambda s, d: K.count_all(prepared(s, d)), SQL_ALL)
    q["ngram_summary"] = (lambda s, d: K.summary(K.count_all(prepared(s, d))), f"select kind, count(*) as total_unique, cast(sum(frequency) as bigint) as total_count from ({SQL_ALL}) group by kind")
    q["first_entries"] = (lambda s, d: K.first_entries(K.count_all(prepared(s, d))), f"select kind, ngram, frequency from (select *, row_number() over (partition by kind order by frequency desc, ngram) as r from ({SQL_ALL})) where r = 1")
    q["normalized_text"] = (lambda s, d: docs(s, d).select("doc_id", normalize(F.col("text")).alias("norm")), f"select doc_id, {sql_norm()} as norm from documents")
    q["normalized_drop_punct"] = (lambda s, d: docs(s, d).select("doc_id", normalize(F.col("text"), "drop").alias("norm")), f"select doc_id, {sql_norm(form=DROP)} as norm from documents")
    q["folded_text"] = (lambda s, d: docs(s, d).select("doc_id", F.translate("text", FOLD_FROM, FOLD_TO).alias("folded")), f"select doc_id, translate(text, '{FOLD_FROM}', '{FOLD_TO}') as folded from documents")
    q["normalize_edges"] = (lambda s, d: rows(s, EDGES).select("id", normalize(F.col("text")).alias("norm")), f"select id, {sql_norm()} as norm from {sql_rows(EDGES)}")
    q["clean_edges"] = (lambda s, d: rows(s, MARKED).select("id", clean(F.col("text")).alias("body")), SQL_CLEAN.format(src=sql_rows(MARKED), key="id"))
    q["clean_text"] = (
        lambda s, d: docs(s, d).select("doc_id", clean(F.concat(F.lit(WRAP[0]), "text", F.lit(WRAP[1]))).alias("body")),
        SQL_CLEAN.format(src=f"(select doc_id, '{WRAP[0]}' || text || '{WRAP[1]}' as text from documents)", key="doc_id"),
    )
    q["word_tokens"] = (
        lambda s, d: prepared(s, d).select("doc_id", F.posexplode(words(F.col("norm"))).alias("pos", "word")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word"),
        f"select doc_id, unnest(range(0, len(a))) as pos, unnest(a) as word from (select doc_id, {WORDS.format(n=sql_norm())} as a from documents)",
    )
    q["char_tokens"] = (
        lambda s, d: prepared(s, d).select(F.explode(chars(F.col("norm"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")),
        f"select ch, count(*) as n from (select unnest({CHARS.format(n=sql_norm())}) as ch from documents) group by ch",
    )
    q["char_classes"] = (
        lambda s, d: docs(s, d).select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).where("ch <> ''").groupBy(char_class(F.col("ch")).alias("class")).agg(F.sum("n").alias("n")),
        r"""select case when regexp_matches(ch, '^[A-Za-z]$') then 'alpha' when regexp_matches(ch, '^[ \t\n\r]$') then 'space' when regexp_matches(ch, '^[0-9]$') then 'digit'
        when regexp_matches(ch, '^[!-/:-@\[-`{-~]$') then 'punct' else 'other' end as class, cast(sum(n) as bigint) as n
        from (select ch, count(*) as n from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by ch) group by 1""",
    )
    q["vocabulary"] = (lambda s, d: K.vocabulary(prepared(s, d)), f"select word, count(*) as n from (select unnest({WORDS.format(n=sql_norm())}) as word from documents) group by word")
    q["document_tokens"] = (lambda s, d: K.tokens_per_document(prepared(s, d)), f"select doc_id, len({WORDS.format(n=sql_norm())}) as n_words, length(replace({sql_norm()}, ' ', '')) as n_letters from documents")
    q["split_keys"] = (
        lambda s, d: K.split_key(counts("word", 3)(s, d)),
        f"select ngram, frequency, string_split(ngram, ' ')[1] as token_1, string_split(ngram, ' ')[2] as token_2, string_split(ngram, ' ')[3] as token_3, cast(len(string_split(ngram, ' ')) as integer) as length from ({sql_counts('word', 3)})",
    )
    q["total_count"] = (lambda s, d: counts("word", 2)(s, d).agg(F.count("*").alias("total_unique"), F.sum("frequency").alias("total_count")), f"select count(*) as total_unique, cast(sum(frequency) as bigint) as total_count from ({sql_counts('word', 2)})")
    q["compare_same"] = (lambda s, d: (lambda one: C.compare("same", one, one))(counts("word", 2)(s, d)), sql_compare("same", sql_counts("word", 2), sql_counts("word", 2)))
    q["compare_kinds"] = (lambda s, d: C.compare("languages", *all_by_lang(s, d), "kind"), SQL_KINDS)
    q["compare_languages"] = (lambda s, d: C.compare("languages", by_lang(s, d, True), by_lang(s, d, False)), sql_compare("languages", EN, REST))
    q["compare_verdict"] = (
        lambda s, d: C.verdict(C.compare("languages", *all_by_lang(s, d), "kind")),
        f"""with v as ({SQL_KINDS}),
        s as (select cast(sum(matches) as bigint) as matches, cast(sum(mismatches + only_left + only_right) as bigint) as errors, bool_and(is_correct) as is_correct from v)
        select *, case when matches + errors = 0 then 100.0::double else matches / (matches + errors) * 100.0::double end as accuracy from s""",
    )
    q["compare_examples"] = (
        lambda s, d: C.examples(by_lang(s, d, True), by_lang(s, d, False)),
        f"""with a as ({EN}), b as ({REST}), j as (select coalesce(a.ngram, b.ngram) as ngram, a.frequency as left_freq, b.frequency as right_freq from a full outer join b on a.ngram = b.ngram),
        c as (select *, case when right_freq is null then 'only_left' when left_freq is null then 'only_right' when left_freq = right_freq then 'match' else 'mismatch' end as status from j)
        select ngram, left_freq, right_freq, status, cast(rank as integer) as rank from (select *, row_number() over (partition by status order by ngram) as rank from c where status <> 'match') where rank <= 5""",
    )
    q["compare_missing"] = (lambda s, d: C.missing(by_lang(s, d, True), by_lang(s, d, False)), f"select * from ({REST}) where ngram not in (select ngram from ({EN}))")
    q["program_agreement"] = (lambda s, d: C.agreement(programs(s, d)), SQL_AGREE)
    q["run_stats"] = (
        lambda s, d: S.run_stats(s.createDataFrame(RUNS, "run int, wall double, cpu double, warmup boolean").coalesce(1)),
        "select " + ", ".join(f"avg({c}) as {c}_mean, min({c}) as {c}_min, max({c}) as {c}_max, stddev_pop({c}) as {c}_std, stddev_pop({c}) / avg({c}) * 100 as {c}_cv" for c in ("wall", "cpu")) + f" from {SQL_RUNS} where not warmup",
    )
    q["speedup"] = (
        lambda s, d: S.speedup(layout(s, AOS), s.createDataFrame([(BASE,)], "base double")),
        f"select threads, wall_mean, {BASE}::double / wall_mean as speedup, {BASE}::double / wall_mean / threads as efficiency, {BASE}::double / wall_mean / threads * 100 as scalability_pct from {sql_layout(AOS, 'a')}",
    )
    q["layout_diff"] = (lambda s, d: S.layout_diff(layout(s, AOS), layout(s, SOA)), SQL_DIFF)
    q["layout_diff_mean"] = (lambda s, d: S.layout_diff(layout(s, AOS), layout(s, SOA)).agg(F.round(F.avg("diff_pct"), 6).alias("diff_pct")), f"select round(avg(diff_pct), 6) as diff_pct from ({SQL_DIFF})")
    q["best_run"] = (lambda s, d: S.best_run(layout(s, AOS)), f"select threads, wall_mean from {sql_layout(AOS, 'a')} order by wall_mean, threads limit 1")
    few = {k: v for k, v in SOA.items() if k > 8} | {120: 15.9}
    q["common_threads"] = (lambda s, d: S.common_threads(layout(s, AOS), layout(s, few)), f"select threads from {sql_layout(AOS, 'a')} intersect select threads from {sql_layout(few, 'b')} order by threads")
    q["all_threads"] = (lambda s, d: S.all_threads(layout(s, AOS), layout(s, few)), f"select threads from {sql_layout(AOS, 'a')} union select threads from {sql_layout(few, 'b')} order by threads")
    asked, failed = [1, 2, 3, 4, 8, 120], [3, 8]
    q["sweep_summary"] = (
        lambda s, d: S.sweep_summary(s.createDataFrame([(n,) for n in asked], "threads int"), S.speedup(layout(s, AOS), s.createDataFrame([(BASE,)], "base double")), ("wall_mean", "speedup"), s.createDataFrame([(n,) for n in failed], "threads int")),
        f"""select threads, case when list_contains({failed}, threads) then 'ERROR' else coalesce(printf('%.3f', wall_mean), 'N/A') end as wall_mean,
        case when list_contains({failed}, threads) then 'ERROR' else coalesce(printf('%.3f', {BASE}::double / wall_mean), 'N/A') end as speedup
        from (select unnest({asked}) as threads) left join {sql_layout(AOS, 'a')} using (threads)""",
    )
    files = ", ".join("('{}', {})".format(k, " || ".join(["''"] + [f"chr({ord(c)})" for c in v])) for k, v in FILES.items() if v and k.endswith(".txt") and "/" not in k)
    q["corpus_files"] = (corpus_files, f"select * from (values {files}) as t(file, text)")
    q["csv_round_trip"] = (csv_round_trip, sql_counts("word", 2))
    q["csv_odd_lines"] = (csv_odd_lines, "select * from (values ('a b', 2::bigint), ('e f', 12), ('ngram', 7)) as t(ngram, frequency)")
    times = ", ".join(f"round({f}, 9) as {c}_{m}" for c in ("wall", "cpu") for m, f in (("mean", f"avg({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("std", f"stddev_pop({c})"), ("cv", f"stddev_pop({c}) / avg({c}) * 100")))
    q["stats_round_trip"] = (
        stats_round_trip,
        f"select k::bigint as threads, {times}, " + ", ".join(f"(10 * k + {i})::bigint as {c}" for i, c in enumerate(K.TABLES)) + f" from {SQL_RUNS}, (values (2), (4)) as n(k) where not warmup group by k",
    )
    q["thread_counts"] = (thread_counts, "select text, case when regexp_matches(trim(text), '^[0-9]+$') and try_cast(text as int) between 1 and 1000 then try_cast(text as int) end as threads from (values ('1'), (' 8 '), ('1000'), ('0'), ('1001'), ('-3'), ('x'), ('2.5'), ('')) as t(text)")
    q["book_ids"] = (lambda s, d: book_ids(s, [1342, 84, 11, 98, 2701], 1500), "select distinct book_id from (select unnest([1342, 84, 11, 98, 2701]) as book_id union all select unnest(range(1, 1501))) order by book_id")
    q["first_number"] = (
        lambda s, d: rows(s, ["runs: 12 of 40", "none", "a1b2 33"]).select("id", S.first_number("text").alias("number")),
        "select * from (values (0, 12::bigint), (1, null), (2, 12::bigint)) as t(id, number)",
    )
    # Extensions of ours: other lengths, counts per language.
    q["ext_word_unigrams"] = (counts("word", 1), sql_counts("word", 1))
    q["ext_word_fourgrams"] = (counts("word", 4), sql_counts("word", 4))
    q["ext_char_trigrams_by_lang"] = (
        lambda s, d: K.count_ngrams(docs(s, d, "lang").select("lang", normalize(F.col("text")).alias("norm")), "char", 3, "lang"),
        f"select lang, ngram, count(*) as frequency from ({sql_grams('char', 3, more='lang,')}) group by lang, ngram",
    )
    return q
