"""Edge cases of sharding, mixing, decontamination, urls, chats, quality, graph."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import chats, decontam, graph, mixing, quality, shards, urls


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=40_000, fanout=3)
    total = 0
    for k in range(7):
        store.append(spark.range(k * 100, k * 100 + 100).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", "'c' as shard").repartition(2))
        total += 100
    before = store.version()
    assert before == 6 and store.manifest().count() == 14
    after = store.compact()
    assert after > before and store.manifest().count() < 14
    assert store.read().count() == total and store.read(before).count() == total
    assert store.manifest().agg(F.sum("rows")).first()[0] == total
    with pytest.raises(shards.Conflict):
        store.commit(store.manifest(), before)
    live = store.manifest().count()
    assert store.vacuum() > 0 and store.read().count() == total and store.manifest().count() == live
    assert store.compact() == after


def test_shards_rows(spark, tmp_path):
    """Row by row over appends, compaction, vacuum and every version."""
    schema = "doc_id bigint, text string, grp int, shard string, _shard string, key double"
    rows = [(k, None if k % 7 == 0 else f"t{k}" * (k % 50), k % 3, f"s{k}", None, k / 2) for k in range(300)] + [(None, None, None, None, None, None)] * 3 + [(5, "", 1, "x", "y", 0.0)] * 2
    store, seen = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=30_000, fanout=3), []
    for lo in range(0, len(rows), 50):
        store.append(spark.createDataFrame(rows[lo : lo + 50], schema).repartition(3))
        seen.append(rows[: lo + 50])
    store.append(spark.createDataFrame([], schema))
    seen.append(rows)
    last = store.compact()
    assert store.read().columns == [c.split()[0] for c in schema.split(", ")] + ["shard_"]
    seen += [rows] * (last + 1 - len(seen))
    for v, want in enumerate(seen):
        assert sorted((tuple(r)[:-1] for r in store.read(v).collect()), key=str) == sorted(want, key=str)
    store.vacuum(versions=2)
    for v in (last - 1, last):
        assert sorted((tuple(r)[:-1] for r in store.read(v).collect()), key=str) == sorted(rows, key=str)
    assert store.vacuum() > 0 and store.read().count() == len(rows)


def test_shards_writers(spark, tmp_path, monkeypatch):
    """One writer commits, compacts and vacuums between another's write and its commit."""
    root = str(tmp_path / "s")
    one, two = shards.ShardStore(spark, root, fanout=2), shards.ShardStore(spark, root, fanout=2)
    some = lambda lo: spark.range(lo, lo + 40).selectExpr("id as doc_id").repartition(2)
    one.append(some(0))

    def late(live, base):
        monkeypatch.undo()
        one.append(some(100))
        one.compact()
        one.vacuum()
        return two.commit(live, base)

    monkeypatch.setattr(two, "commit", late)
    two.append(some(200))
    want = [*range(40), *range(100, 140), *range(200, 240)]
    assert sorted(r.doc_id for r in two.read().collect()) == want
    one.append(some(300))
    monkeypatch.setattr(two, "commit", late)  # now between a compaction's write and its commit
    two.compact()
    assert sorted({r.doc_id for r in two.read().collect()}) == [*want, *range(300, 340)]
    assert not list((tmp_path / "s" / "writing").iterdir())
    files = {f.name for f in (tmp_path / "s" / "data").rglob("*.parquet")}
    two.vacuum()
    assert {r.shard.rpartition("/")[2] for r in two.manifest().collect()} == {f.name for f in (tmp_path / "s" / "data").rglob("*.parquet")} <= files


def test_shards_failures(spark, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    assert store.vacuum() == 0
    store.append(spark.range(10))
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("no disk")))
    with pytest.raises(OSError):
        store.append(spark.range(10, 20))
    monkeypatch.undo()
    assert store.version() == 0 and store.vacuum() == 0 and store.read().count() == 10
    name = store.begin()  # a writer that dies
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/s/data/{name}")
    assert store.vacuum() == 0 and store.vacuum(abandoned=-60) == 1 and store.read().count() == 10


def test_shards_one_group_a_task(spark):
    keys = shards.ShardStore(spark, "/none").keys(64)
    parts = keys.repartition(64, "key").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"))
    assert keys.select("grp").distinct().count() == 64 and parts.agg(F.max("n")).first()[0] == 1


def test_targets(spark):
    rows = [("a", 10), ("b", 10), ("c", 1000), (None, 1), ("d", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    # weights a 1, b 2, c 3, d 1, null 2; all but c stop at three times their size
    assert got == {"a": 30.0, "b": 30.0, "d": 0.0, None: 3.0, "c": 958.0}


def test_mix_odd(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 7), (2, None, "x", 7), (3, "", None, 7), (None, "q w e r t y", None, 7), (4, "  z  z\tz\n", "y", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    seq = mixing.expand(mixed).collect()
    assert sum(r.words for r in seq) == sum(r.taken for r in got)
    assert all(len((r.text or "").split()) == r.words for r in seq)
    assert [r.position for r in seq] == sorted(r.position for r in seq) and all(0 <= r.position <= 1 for r in seq)
    assert mixing.mix(df.limit(0)).count() == 0


def plain_contamination(text, items):
    from test_pipeline import BENCH, low

    w = BENCH.findall(low(text))
    hit, names = [False] * len(w), set()
    for name, item in items:
        v = BENCH.findall(low(item))
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit[i : i + n] = [True] * n
                names.add(str(name))
    return len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit) and 20 * sum(hit) >= len(w)


def test_mix_names(spark):
    """Clashing columns: the added ones are replaced, all others stay."""
    names = ["slope", "_before", "_start", "_name", "_bucket", "weight", "rank", "aside0", "size", "stream", "copy", "words"]
    rows = [(k, "a b c d", "xy"[k % 2], *range(len(names))) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    mixed = mixing.mix(df)
    kept = [n for n in names if n not in mixing.ADDED]
    assert mixed.columns == ["doc_id", "text", "source", *kept, *mixing.ADDED]
    want = [k for k, n in enumerate(names) if n in kept]
    assert all([r[n] for n in kept] == want and r["size"] == 4 for r in mixed.collect())
    seq = mixing.expand(mixed).collect()
    assert all(r["slope"] == 0 and r["words"] <= 4 for r in seq) and sum(r["words"] for r in seq) == 24


def test_contamination(spark):
    r = random.Random(4)
    vocab = [f"v{k}" for k in range(60)] + ["Ünder", "x"]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 3, 5, 12, 13, 14, 30])))) for k in range(14)] + [(3, "x, Y"), (20, None), (21, "...")]
    texts = []
    for _ in range(60):
        parts = r.choices(vocab, k=r.randint(0, 60))
        if r.random() < 0.7:
            v = r.choice(items)[1] or ""
            w = v.split()
            a = r.randint(0, len(w))
            at = r.randint(0, len(parts))
            parts[at:at] = w[a // 3 :]
        texts.append(r.choice([" ", ", ", "\n-"]).join(parts).replace("v1", "V1"))
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (77, None), (78, ""), (79, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, len string").repartition(3)
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id bigint, text string, row string")
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(i, *plain_contamination(t, items)) for i, t in rows], key=str)
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_contamination_shared_ids(spark):
    long = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcdef"]
    items = [(1, long[0]), (1, long[1]), (1, long[4]), (None, long[2]), (None, long[3]), (None, long[5]), (2, "short one"), (2, "other pair")]
    # long[4] and long[5] are in no document
    rows = [(i, t) for i, (_, t) in enumerate(items) if t not in (long[4], long[5])] + [(20, f"x {long[0]} y {long[3]} z"), (21, " ".join(long[1].split()[3:17]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, decontam.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()))
    assert got == sorted((i, *plain_contamination(t, [("" if k is None else k, x) for k, x in items])) for i, t in rows)
    assert all(r[-1] for r in got)


RULES = [urls.Rule("allow", "com/"), urls.Rule("block", "bad.org/"), urls.Rule("allow", "ok.bad.org/")]


def page(to, kind="canonical"):
    return f'<html><head><LINK rel="canonical" href="{to}"></head>' if kind == "canonical" else f"<meta http-equiv='refresh' content='0; url={to}'>"


def test_urls(spark):
    rows = [
        (1, "http://alias.net/a", page("http://bad.org/x")),
        (2, "http://second.net/b", page("http://alias.net/a", "refresh")),
        (3, "http://fine.com/", page("http://bad.org/x")),
        (4, "http://other.net/", page("/local")),
        (5, "http://other.net/local", None),
        (6, "http://OK.BAD.org/q?x", ""),
        (7, "HTTP://Bad.Org/z#f", None),
        (8, None, page("http://bad.org/x")),
        (9, "bad.org/no-scheme", None),
        (10, "http://notbad.org/", None),
        (1, "http://alias.net/a", page("http://bad.org/x")),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id int, url string, html string, node int")
    redirects = spark.createDataFrame([("http://hop.net/", "http://second.net/b"), ("http://other.net/local", "http://hop2.net/"), (None, "http://bad.org/x")], "src string, dst string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, RULES, redirects).collect()}
    assert got[1] == ("alias.net", "/a", None, "block") and got[2][3] == "block"
    assert got[3] == ("fine.com", "/", "com/", "allow") and got[6] == ("ok.bad.org", "/q", "ok.bad.org/", "allow")
    assert got[7] == ("bad.org", "/z", "bad.org/", "block")
    assert got[4][3] == got[5][3] == "allow" and got[8] == got[9] == ("", "", None, "allow") and got[10][3] == "allow"
    assert urls.judge(df.limit(0), RULES).count() == 0



def test_url_edges(spark):
    at = "http://s.net/d/e/p.html?q=1#f"
    cases = [
        ("<link rel=canonical href=http://bad.org/x>", "http://bad.org/x"),
        ("<link rel='nofollow Canonical' href='page.html'>", "http://s.net/d/e/page.html"),
        ('<link href="../a/./b?y=../z" rel="canonical"/>', "http://s.net/d/a/b?y=../z"),
        ('<link rel="canonical" href="?id=1">', "http://s.net/d/e/p.html?id=1"),
        ('<link rel="canonical" href="../../../..">', "http://s.net/"),
        ('<link rel="canonical" href="/login?next=http://x">', "http://s.net/login?next=http://x"),
        ('<link rel="canonical" href="//o.net/k">', "http://o.net/k"),
        ('<link rel="canonical" href="/it\'s">', "http://s.net/it's"),
        ('<link title="a > href=no rel=x" data-href="no" rel="canonical" href="/t">', "http://s.net/t"),
        ("""<meta http-equiv="refresh" content="0;url='http://bad.org/y'">""", "http://bad.org/y"),
        ("""<META CONTENT='5; URL="n.html"' HTTP-EQUIV=Refresh>""", "http://s.net/d/e/n.html"),
        ("<meta http-equiv=refresh content=0;url=../m>", "http://s.net/d/m"),
        ('<meta http-equiv="refresh" content="30">', None),
        ('<link rel="canonical" href="mailto:a@b.c">', None),
        ('<link rel="canonicals" href="/no">', None),
        ('<link rel="stylesheet" title="rel=canonical" href="/no">', None),
    ]
    for k, (html, want) in enumerate(cases):
        cases[k] = (at.replace("s.net", f"s{k}.net"), html, want and want.replace("s.net", f"s{k}.net"))
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(cases)], "page_id int, url string, html string")
    got = {r.src: r.dst for r in urls.link_edges(df).collect()}
    assert got == {u: w for u, _, w in cases if w}
    blocked = {r.page_id for r in urls.judge(df, RULES).where("verdict = 'block'").collect()}
    assert blocked == {0, 9}


def test_url_base_and_entities(spark):
    rows = [
        (1, "http://a.net/d/p", '<base href="http://b.net/x/y"><link rel="canonical" href="q?a=1&amp;b=2">'),
        (2, "http://c.net/d/p", "<base href=/deep/><link rel=canonical href=z>"),
        (3, "http://e.net/d/p", '<link rel="canonical" href="/s?a=1&#38;b=2">'),
    ]
    got = {r.src: r.dst for r in urls.link_edges(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {"http://a.net/d/p": "http://b.net/x/q?a=1&b=2", "http://c.net/d/p": "http://c.net/deep/z", "http://e.net/d/p": "http://e.net/s?a=1&b=2"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_urls_brute_force(spark, seed):
    """Random graphs of redirects and links with blocked, allowed and other
    hosts: components by union-find, explicit rules first."""
    r = random.Random(seed)
    hosts = ["bad.org", "www.bad.org", "ok.bad.org", "x.com"] + [f"h{k}.net" for k in range(40)]
    all_urls = [f"http://{h}/{k}" for h in hosts for k in range(3)]
    links = {u: r.choice(all_urls) for u in r.sample(all_urls, 45)}
    moved = [(r.choice(all_urls), r.choice(all_urls)) for _ in range(12)] + [(all_urls[0], all_urls[0]), (None, all_urls[1])]
    parent = {u: u for u in all_urls}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in [*links.items(), *[m for m in moved if m[0]]]:
        parent[find(a)] = find(b)
    rule = {"bad.org": "block", "www.bad.org": "block", "ok.bad.org": "allow", "x.com": "allow"}
    host = lambda u: u.split("/")[2]
    bad = {find(u) for u in all_urls if rule.get(host(u)) == "block"}
    want = {u: rule.get(host(u)) or ("block" if find(u) in bad else "allow") for u in all_urls}
    pages = spark.createDataFrame([(k, u, page(links[u]) if u in links else None) for k, u in enumerate(all_urls)], "page_id int, url string, html string").repartition(4)
    got = {r.page_id: r.verdict for r in urls.judge(pages, RULES, spark.createDataFrame(moved, "src string, dst string")).collect()}
    assert got == {k: want[u] for k, u in enumerate(all_urls)}
    assert "block" in {want[u] for u in all_urls if host(u) not in rule}


def test_chats(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", 6: "", None: "abcx", 8: "ab"}
    rows = [(c, k, "user" if k % 2 else "assistant", t, 0) for c, s in turns.items() for k, t in enumerate(s)]
    rows += [(9, 0, None, None, 0), (9, None, "user", "<|im_end|>", 0), (10, 0, None, "", 0), (10, None, "user", "<|im_end|>", 0), (11, 1, "a", "t", 0), (11, 1, "a", "t", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, k int").repartition(3)
    got = {r.conv_id: r for r in chats.format_chats(df).collect()}
    want = {1: "prefix", 2: "prefix", 3: "prefix", 4: "kept", 5: "kept", None: "kept", 8: "prefix", 9: "kept", 10: "kept", 11: "kept"}
    assert {k: r.status for k, r in got.items()} == want
    assert got[11].n_turns == 2 and got[1].chat is None
    assert got[4].chat == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in zip(("assistant", "user", "assistant"), "abd", strict=True))
    assert got[9].chat.count("<|im_end|>") == 2
    assert chats.format_chats(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(c, 0, "u", "hi") for c in (5, 3, 7)], "conv_id bigint, turn int, role string, text string")
    assert {r.conv_id: r.status for r in chats.collapse(twins).collect()} == {3: "kept", 5: "duplicate", 7: "duplicate"}


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 300)] + [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(7, 7), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_components_few_edges(spark, monkeypatch, most):
    """The same components whether rounds or one task end the search; a small
    graph, whatever its shape, takes a handful of jobs."""
    monkeypatch.setattr(graph, "TASK_EDGES", most, raising=False)
    r = random.Random(5)
    ids = [r.randint(-(1 << 62), 1 << 62) for _ in range(300)]
    edges = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(299) if k % 100 != 99] + [(ids[7], ids[7]), (None, ids[3])], "a bigint, b bigint").repartition(4).cache()
    edges.count()
    sc, group = spark.sparkContext, f"components {most}"
    sc.setJobGroup(group, group)
    try:
        got = {x.node: x.component for x in graph.components(edges).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: min(ids[k - k % 100 : k - k % 100 + 100]) for k, i in enumerate(ids)}
    if most >= 300:
        assert jobs <= 8, jobs


def test_gradients():
    rng = np.random.default_rng(0)
    bags = np.array([1, 3, 2, 5])
    x, y = rng.normal(size=(11, 6)), np.array([0.0, 1, 1, 0])
    model = quality.fit(x, bags, y, hidden=4, gate=3, epochs=2)
    loss = lambda: -np.mean(np.log(np.where(y == 1, f := model.forward(x, bags)["y"], 1 - f)))
    grads = model.backward(model.forward(x, bags), bags, y)
    for k, g in grads.items():
        for i in list(np.ndindex(g.shape))[:4]:
            at, old = model.params[k], model.params[k][i]
            at[i] = old + 1e-5
            up = loss()
            at[i] = old - 1e-5
            down = loss()
            at[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def plain_passages(text):
    """Features of each passage of a text, word by word."""
    data = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not at:
        return [[0.0] * quality.N_FEATURES]
    word = [low[i:j] for i, j in at]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    out = []
    for lo in range(0, len(at), quality.PASSAGE):
        hi = min(lo + quality.PASSAGE, len(at))
        n, span = hi - lo, data[at[lo][0] : at[hi][0] if hi < len(at) else len(data)]
        size = [j - i for i, j in at[lo:hi]]
        mean = lambda v: sum(v) / n  # noqa: B023, E731
        head, tail = [data[i] for i, _ in at[lo:hi]], [data[j - 1] for _, j in at[lo:hi]]
        again = lambda d: mean([k >= d and word[k] == word[k - d] for k in range(lo, hi)])  # noqa: B023, E731
        count = Counter(word[lo:hi])
        spread = max(0, mean([s * s for s in size]) - mean(size) ** 2) ** 0.5
        out.append(
            [sum(b in set(c) for b in span) / len(span) for c in quality.CLASSES.values()]
            + [math.log1p(mean(size)), math.log1p(spread), math.log1p(n) / 5, again(1), again(2), mean([65 <= b <= 90 for b in head]), mean([not letter(b) for b in head])]
            + [mean([not letter(b) for b in tail]), mean([s == 1 for s in size]), mean([s > 14 for s in size]), len(count) / n, max(count.values()) / n, 1]
        )
    return out


def plain_score(text, p):
    """Encoder, gated attention and score, passage by passage."""
    codes, logits = [], []
    for x in plain_passages(text):
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, p["mean"], p["std"], strict=True)]
        h = [math.tanh(sum(a * b for a, b in zip(z, col, strict=True)) + c) for col, c in zip(p["e"].T, p["eb"], strict=True)]
        dot = lambda m: [sum(a * b for a, b in zip(h, col, strict=True)) for col in m.T]  # noqa: B023, E731
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(dot(p["v"]), dot(p["u"]), strict=True)]
        codes.append(h)
        logits.append(sum(a * b for a, b in zip(gate, p["a"], strict=True)))
    weight = [math.exp(s - max(logits)) for s in logits]
    z = [sum(w * h[k] for w, h in zip(weight, codes, strict=True)) / sum(weight) for k in range(len(codes[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["w"], strict=True)) - p["b"][0]))


def test_quality_brute_force(spark):
    """Every score against a plain forward pass of each document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \t"), (-4, "y" * 5000), (-5, "A b a B " * 300)], "doc_id bigint, text string")
    rows = docs.union(odd).withColumn("score", F.lit("own")).withColumn("label", F.lit(1))
    got = quality.score(rows, model, keep_text=True)
    assert got.columns == ["doc_id", "text", "label", "score"]
    for r in got.collect():
        assert math.isclose(r.score, plain_score(r.text, model.params), abs_tol=1e-5)


def test_quality_odd(spark):
    rows = [(1, None), (2, ""), (None, "word " * 9), (3, "\t\n"), (4, "y" * 100000), (4, "y" * 100000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, x string")
    labels = spark.createDataFrame([(2, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    long = spark.createDataFrame([(1, "a b " * 300), (2, None)], "doc_id bigint, text string")
    weights = {r.doc_id: (r.n, r.w) for r in quality.attend(long, quality.train(docs, labels)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert weights[1][0] == 5 and weights[2][0] == 1 and all(abs(w - 1) < 1e-9 for _, w in weights.values())


def test_quality_held_out(spark):
    from lexigrid.llm.queries import op1_quality

    d = "/root/testdata/sf0.01"
    got = op1_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    rank = got.score.rank()
    n1 = (got.quality == 1).sum()
    auc = (rank[got.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    assert auc > 0.95
