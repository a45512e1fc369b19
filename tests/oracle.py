"""Runs a query and its SQL on the same tables and compares all rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    ref = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=key)
    assert len(got) == len(ref)
    for a, b in zip(got, ref, strict=True):
        assert a == b
