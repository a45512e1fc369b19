"""Queries of the operators with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import chats, decontam, embeddings, lm, mixing, quality, shards, simjoin, suffix, urls
from lexigrid.shared import work_dir

# The url rules.
RULES = [urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"), urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/")]
#: Score from which a document passes.
QUALITY = 0.3


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, d, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.by_position(mixing.mix(docs).drop("text", "source"))


def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    store = shards.ShardStore(spark, work_dir(spark, "shards"))
    store.append(table(spark, d, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.length("text").cast("bigint").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.similar_groups(table(spark, d, "documents").select("doc_id", "text"))


def op5_lm(spark: SparkSession, d: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = table(spark, d, "documents").select("doc_id", held.alias("held_out"), "text")
    model = lm.train(docs.where(~F.col("held_out")))
    out = lm.score(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


def op7_urls(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"), RULES).drop("component")


def op8_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


def op9_chats(spark: SparkSession, d: str) -> DataFrame:
    return chats.format_chats(table(spark, d, "conversations"))


def op10_suffix(spark: SparkSession, d: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))


SQL = {
    "op2_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank, count(*) over () as n, 3 * source_size as most, (sum(source_size) over ())::bigint as total from s),
w as (select *, rank % 3 + 1 as weight from r),
x as (select *, total - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_,
    sum(weight) over (order by most / weight, rank rows between current row and unbounded following) as w_left from w),
o as (select *, min(left_ * weight > most * w_left) over (order by most / weight, rank rows between unbounded preceding and current row) as stopped from x),
t as (select source, source_size, case when stopped then most::double
    else (weight * (total - coalesce(sum(most) filter (stopped) over (), 0)))::double / (sum(weight) filter (not stopped) over ())::double end as target,
    case when n > 1 then 0.8::double - 1.6::double * rank / (n - 1) else 0 end as slope from o),
j as (select doc_id, size, source_size, target, slope, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes,
    coalesce(sum(size) over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from d join t using (source)),
k as (select *, passes * size + least(size, greatest(0, round(target - passes * source_size)::bigint - before)) as taken, least(1.0::double, before / target) as y from j)
select doc_id, size, source_size, target, taken::bigint as taken,
    case when taken > 0 then case when y <= 0 then 0.0::double else 2.0::double * y / (1.0::double - slope + sqrt((1.0::double - slope) * (1.0::double - slope) + 4.0::double * slope * y)) end end as position from k
order by position, doc_id""",
    "op3_sharding": "select doc_id, length(text) as chars, sha256(text) as text_sha256 from documents",
    "op4_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r(id, c) as (select doc_id, doc_id from w union select l.b, r.c from r join l on r.id = l.a)
select w.doc_id, coalesce(n, 0) as n_shingles, m.component_id from w left join n using (doc_id) join (select id, min(c) as component_id from r group by id) m on m.id = w.doc_id""",
    "op8_embeddings": """
with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, c) as (select vec_id, vec_id from e union select l.b, r.c from r join l on r.id = l.a),
m as (select id, min(c) as component_id from r group by id),
k as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from e join m on id = vec_id left join k on a = vec_id""",
    "op6_decontamination": r"""
with b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i, w from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from bw),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n),
hit as (select doc_id, i, dw.n, item from dw join win on dw.n = win.n and array_to_string(w[i:i + dw.n - 1], ' ') = g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join it using (doc_id)""",
    "op7_urls": r"""
with p as (select page_id, url, case when url like '%://%' then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
r as (select * from (values ('com', '/', 'allow', 'com/'), ('example.com', '/en/', 'block', 'example.com/en/'), ('www.example.com', '/en/', 'allow', 'www.example.com/en/'), ('net', '/es/', 'block', 'net/es/'), ('net', '/fr/', 'block', 'net/fr/')) as t(h, q, v, rule)),
m as (select page_id, url, max_by(struct_pack(rule := rule, v := v), length(rule)) as hit from p join r on (host = h or host like '%.' || h) and starts_with(path, q) group by page_id, url)
select p.page_id, host, path, hit.rule as rule, coalesce(hit.v, 'allow') as verdict from p left join m on p.page_id = m.page_id and p.url = m.url""",
    "op9_chats": r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k, role, text from conversations),
e as (select conv_id, count(*) as n_turns, string_agg(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), '' order by k) as code,
    string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '<\|') || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || '<|im_end|>' || chr(10), '' order by k) as chat,
    min_by(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), k) as first from t group by conv_id),
x as (select e.*, exists (select 1 from e f where f.first = e.first and f.n_turns > e.n_turns and starts_with(f.code, e.code)) as pre, min(conv_id) over (partition by code) as least from e)
select conv_id, n_turns, case when pre then 'prefix' when conv_id = least then 'kept' else 'duplicate' end as status,
    case when not pre and conv_id = least then chat end as chat from x""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_quality, op2_mixing, op3_sharding, op4_jaccard, op5_lm, op6_decontamination, op7_urls, op8_embeddings, op9_chats, op10_suffix)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
