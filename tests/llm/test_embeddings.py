import numpy as np

from lexigrid.llm import embeddings as E


def brute(ids, rows, least=0.95):
    x = [np.array([np.nan if c is None else c for c in r], np.float64) if r is not None else None for r in rows]
    ok = [v is not None and np.isfinite(v).all() and (v != 0).any() for v in x]
    unit = [v / np.linalg.norm(v) if o else None for v, o in zip(x, ok, strict=True)]
    n, comp = [0] * len(ids), list(ids)
    for i in range(len(ids)):
        for j in range(len(ids)):
            if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= least or rows[i] == rows[j]):
                n[i] += 1
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return {i: (k, c, c == i) for i, k, c in zip(ids, n, comp, strict=True)}


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=16) for _ in range(120)]
    for _ in range(150):
        rows.append(rows[rng.integers(120)] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.1)
    rows += [rows[3]] * 40 + [rows[7] * (1 + k / 100) for k in range(30)]
    rows = [[float(c) for c in np.float32(r)] for r in rows] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    ids = [int(i) for i in rng.permutation(len(rows)) * 3]
    df = spark.createDataFrame(list(zip(ids, rows, ["x"] * len(ids), strict=True)), "vec_id bigint, embedding array<float>, n string").repartition(5)
    want = brute(ids, rows)
    for block in (1000, 7):
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    got = E.near_duplicates(spark.createDataFrame([(None, [1.0]), (4, [1.0])], "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id is None, r.n_links, r.kept) for r in got) == [(False, 0, True), (True, 0, False)]
