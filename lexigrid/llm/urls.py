"""URL filters: rules on hosts and paths, spread over redirect equivalence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, lower_ascii
from lexigrid.llm.graph import components


@dataclass(frozen=True)
class Rule:
    """``site`` is host and path in one, as ``example.com/en/``."""

    verdict: str
    site: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2] if "/" in self.site else ""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The
    rules are a parameter: a list of at most some hundreds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.site), r.site)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.site).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: A value of an attribute: in double quotes, in single quotes or in none.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
VALUE_GROUPS = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""


def found(text: Column, pattern: str) -> Column:
    """What the one of three groups that takes part has matched; else empty."""
    return F.concat(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of this name of a tag, quoted or not; empty
    if it has none. Names inside the values of others don't count."""
    other = rf"[\s/]*+[^\s/>=]++(?:\s*+=\s*+{VALUE})?+"
    return found(tag, rf"(?is)^<[a-z]++(?:{other})*?[\s/]*+{name}\s*+=\s*+{VALUE_GROUPS}")


def without_dots(path: Column) -> Column:
    """A path that starts with /, without its segments . and .. ."""
    parts = F.split(path, "/", -1)
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x))
    rest = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(rest, "/"), F.when(ends, "/").otherwise(""))


def resolved(url: Column, to: Column) -> Column:
    """The target ``to`` of a page, absolute; null if it has no host."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    to_path, to_rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    path = F.when(to.startswith("/"), to_path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), to_path))
    query = F.when(to.startswith("#"), F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)).otherwise("")
    same = F.concat(site, path_of(url), query, to)
    inside = F.when(to.startswith("?") | to.startswith("#"), same).otherwise(F.concat(site, without_dots(path), to_rest))
    absolute = F.when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
    other = to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.coalesce(absolute, F.when(~other & (site != ""), F.when(to.startswith("//"), F.concat(scheme, to)).otherwise(inside)))


def decoded(value: Column) -> Column:
    """An attribute's value with its ampersands decoded, the only references
    that urls need."""
    return F.regexp_replace(value, r"(?i)&(?:amp|#38|#x26);", "&")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): urls that a page's html names as its canonical url or that
    it refreshes to. Relative targets are resolved against the page's url, or
    against the html's first base."""
    tag_of = r"""(?is)(<(?:%s)\b(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>)"""
    base = F.trim(decoded(attribute(F.regexp_extract("html", tag_of % "base", 1), "href")))
    at = F.when(base == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), base), F.col("url")))
    tags = F.regexp_extract_all("html", F.lit(tag_of % "link|meta"), 1)
    rows = pages.where("url is not null and html is not null").select("url", at.alias("at"), F.explode(tags).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical"), attribute(tag, "href"))
    goes = found(attribute(tag, "content"), r"""(?is)^\s*+(?:[\d.]++\s*+[;,]?+\s*+(?:url\s*+=\s*+)?+|url\s*+=\s*+)(?:"([^"]*+)|'([^']*+)|([^"'\s]\S*+))""")
    refresh = F.when(F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh", goes)
    rows = rows.select("url", "at", F.trim(decoded(F.coalesce(canonical, refresh))).alias("to")).where("to <> ''")
    target = resolved(F.col("at"), F.col("to"))
    return rows.select(F.col("url").alias("src"), target.alias("dst")).where("dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of pages.

    A url that a rule fits gets that rule's verdict, so an explicit allow
    stands even among blocked aliases. Any other url is blocked if a url
    equivalent to it, by redirects(src, dst) and the links in html, is blocked
    by a rule; else it gets the default. Null urls have empty host and path.
    Repeated rows each get a verdict; other columns are ignored. Only urls at
    the end of an edge enter the component search (64-bit hashes of urls)."""
    url = F.col("url")
    base = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(url).alias("node"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    scratch = Scratch(pages.sparkSession, "urls")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    edges = scratch.save(edges)
    if edges.isEmpty():
        tainted = None
    else:
        comp = scratch.save(components(edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))))
        urls = edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct()
        blocked = urls.where(rule_of(host_of(url), path_of(url), rules)["verdict"] == "block").select(F.xxhash64(url).alias("node"))
        bad = comp.join(blocked.distinct(), "node", "left_semi").select("component").distinct().withColumn("bad", F.lit(True))
        tainted = comp.join(bad, "component", "left").select("node", "component", F.coalesce("bad", F.lit(False)).alias("bad"))
    if tainted is None:
        out = base.withColumn("component", F.lit(None).cast("bigint")).withColumn("bad", F.lit(False))
    else:
        out = base.join(tainted, "node", "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), "block"), F.lit(default))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "component")
