import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import simjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    return {(i, len(s), c) for (i, _), s, c in zip(rows, sets, comp, strict=True)}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = " ".join(r.choices(vocab, k=40))
    base = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        for _ in range(r.randint(1, 8)):
            w = t.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    chain = r.choices(vocab, k=100)
    for k in range(30):  # each links with the next, the ends don't
        chain = [*chain[2:], *r.choices(vocab, k=2)]
        out.append(" ".join(chain))
    out += [line + "\n" + t for t in base[:30]] + [base[0].upper()] * 5 + ["", "  \n", "one two", "One  TWO", "one two three", None]
    r.shuffle(out)
    ids = r.sample(range(10000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, sig string").repartition(4)
    monkeypatch.setattr(simjoin, "BUFFER", 2000)
    got = {tuple(r) for r in simjoin.similar_groups(df).collect()}
    assert got == brute(rows)


def link_counts(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    return {i: sum(near(a, b) for b in range(len(rows)) if a != b) for a, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("seed", [3, 4])
def test_links_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = simjoin.similar_groups(df, links=True).collect()
    assert {r.doc_id: r.n_links for r in got} == link_counts(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


def near_group(seed, copies, changes):
    """Near copies of a text that is not among them, so that many pairs miss
    the threshold narrowly."""
    r = random.Random(seed)
    base = [f"w{r.randrange(300)}" for _ in range(150)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(r.randint(*changes)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize(("seed", "changes", "rounds"), [(1, (0, 6), 4), (2, (2, 5), 1), (3, (3, 4), 4)])
def test_near_group(spark, seed, changes, rounds, monkeypatch):
    monkeypatch.setattr(simjoin, "ROUNDS", rounds)
    rows = near_group(seed, 80, changes) + [(1000 + i, t) for i, t in near_group(seed + 50, 40, changes)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {tuple(r) for r in simjoin.similar_groups(df).collect()} == brute(rows)


def test_sketches_never_rule_out_a_link(spark):
    """What two sets' sketches differ in is at most what the sets differ in,
    also where they are of two lengths."""
    r = random.Random(6)
    hashes = [r.getrandbits(64) - 2**63 for _ in range(5000)]
    pick = lambda pool, n: set(r.sample(hashes[:pool], min(n, pool)))
    sets = {k: pick(r.choice([20, 90, 1500, 5000]), r.choice([1, 9, 17, 65, 70, 1000])) for k in range(24)}
    segments = spark.createDataFrame([(k, len(s), list(s)) for k, s in sets.items()], "node bigint, n bigint, hs array<bigint>")
    got = simjoin.sketches(segments, segments.select("node"))
    assert {x.node: len(x.sketch) for x in got.collect()} == {k: 1 << max(0, (-(-len(s) // 8) - 1)).bit_length() for k, s in sets.items()}
    x, y = got.toDF("a", "x_sketch"), got.toDF("b", "y_sketch")
    pairs = x.join(y, F.size("x_sketch").between(F.size("y_sketch") / 2, F.size("y_sketch") * 2)).select("a", "b", simjoin.least_apart("x_sketch", "y_sketch", 80).alias("d"))
    for p in pairs.collect():
        assert p.d <= len(sets[p.a] ^ sets[p.b]) and (p.a != p.b or p.d == 0)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e F"), (4, None)]
    got = sorted(map(tuple, simjoin.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (9, 2, 3), (4, 0, 4)], key=str)


def test_empty(spark):
    assert simjoin.similar_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {tuple(r) for r in simjoin.similar_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == brute(rows)
