import hashlib
import random
from collections import defaultdict

import pytest

from lexigrid.llm import suffix


def brute(rows, length):
    starts = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - length + 1):
            starts[b[s : s + length]] += 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdefg hé") for _ in range(n))
    shared = [make(r.randint(60, 500)) for _ in range(8)]
    out = []
    for _ in range(70):
        parts = [make(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : r.randint(a, len(s))], make(r.randint(0, 90))]
        out.append("".join(parts))
    out += ["ab" * 300, "ab" * 120, "x" * 99, "x" * 100, "x" * 101, "", None, out[0], out[0], make(4000) + shared[0] * 2]
    return [(k, t) for k, t in enumerate(out)] + [(5, out[5]), (None, out[6])]


@pytest.mark.parametrize(("seed", "length", "group"), [(1, 100, 20000), (2, 61, 20000), (3, 100, 2), (4, 61, 2), (5, 100, 6), (6, 26, 3)])
def test_brute_force(spark, monkeypatch, seed, length, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row string").repartition(4)
    got = sorted(map(tuple, suffix.remove_repeats(df, length).collect()), key=str)
    assert got == sorted(brute(rows, length), key=str)


def test_repeats(spark):
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    s = make(130)
    rows = [(1, make(50) + s + make(50)), (2, make(70) + s), (3, s[10:] + make(80)), (4, make(300))]
    got = suffix.maximal_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 100).collect()
    assert {len(x.occurrences) for x in got} == {2, 3}
    text = dict(rows)
    key = {r.row: r.doc_id for r in suffix.keyed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for x in got:
        cuts = {text[key[o.row]][o.start : o.start + x.bytes] for o in x.occurrences}
        assert len(cuts) == 1 and x.bytes >= 100
    assert any(x.bytes >= 120 and {key[o.row] for o in x.occurrences} == {1, 2, 3} for x in got)



def test_maximal_repeats_of_large_groups(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    shared = " ".join(word() for _ in range(14))
    docs = spark.createDataFrame([(i, " ".join([word() for _ in range(40)] + [shared] + [word() for _ in range(40)])) for i in range(6)], "doc_id bigint, text string")
    monkeypatch.setattr(suffix, "GROUP", 3)
    got = suffix.maximal_repeats(docs, 100).collect()
    assert any(len(x.occurrences) == 6 and x.bytes >= 100 for x in got)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, suffix.remove_repeats(df).collect())) == sorted(brute(rows, 400))
