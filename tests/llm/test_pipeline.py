"""The pipeline against a plain version of each stage."""

import hashlib
import re

import corpus_pipeline as P
from test_operators import plain_score
from test_simjoin import brute as near_copies

from lexigrid.llm import common, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def contaminated(text, items):
    w = BENCH.findall(low(text))
    hit = [False] * len(w)
    for item in items:
        v = BENCH.findall(low(item))
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit[i : i + n] = [True] * n
    return any(hit) and 20 * sum(hit) >= len(w)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    one = P.classify(spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in one.collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    two = P.deduplicate(spark, one, SF).cache()
    want = {i for i, _, c in near_copies([(r.doc_id, r.text) for r in one.collect()]) if i == c}
    assert {r.doc_id for r in two.collect()} == want and two.count() == len(want)
    three = P.decontaminate(spark, two, SF).cache()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not contaminated(r.text, items)}
    four = P.blend(spark, three, SF).cache()
    size = lambda t: len(WORD.findall(t or ""))
    before = {r.doc_id: r for r in three.collect()}
    taken: dict = {}
    for r in four.collect():
        assert before[r.doc_id].text.startswith(r.text) and r.source == before[r.doc_id].source
        taken.setdefault(r.source, []).append(size(r.text))
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    goal, free, total = {}, sorted(sizes), sum(sizes.values())
    weight = {s: k % 3 + 1 for k, s in enumerate(free)}
    while True:
        left = total - sum(goal.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / w > 3 * sizes[s]]
        if not over:
            break
        goal |= {s: 3 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    goal |= {s: weight[s] * left / w for s in free}
    for s in sizes:
        assert abs(sum(taken.get(s, [])) - goal[s]) <= 1
    five = P.shard(spark, four, SF)
    assert sorted((r.doc_id, r.chars) for r in five.collect()) == sorted((r.doc_id, len(r.text)) for r in four.collect())
    for df in (one, two, three, four):
        assert df.columns == cols


def plain_mix(rows):
    """(doc_id, characters) of each copy the mix takes, in training order, of
    rows (doc_id, text, source)."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    slope = {s: 0.8 - 1.6 * k / (len(names) - 1) if len(names) > 1 else 0.0 for k, s in enumerate(names)}
    goal, free = {}, names
    while True:
        left, w = sum(sizes.values()) - sum(goal.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left > 3 * sizes[s] * w]
        if not over:
            break
        goal |= {s: 3 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    goal |= {s: weight[s] * left / w for s in free}
    out = []
    for s in names:
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i, size(t), t) for i, t, z in rows if z == s)
        want, done = round(goal[s]), 0
        while done < want:
            for _, i, n, t in own:
                take = min(n, want - done)
                if take:
                    y = min(1.0, done / goal[s])
                    a = 1 - slope[s]
                    at = 0.0 if y <= 0 else 2 * y / (a + (a * a + 4 * slope[s] * y) ** 0.5)
                    out.append((at, i, len(t) if take == n else [m.end() for m in WORD.finditer(t)][take - 1]))
                done += take
    return sorted((i, n) for _, i, n in sorted(out))


def test_run_brute_force(spark):
    """All rows of the whole run against plain versions of all stages."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = [plain_score(t, model.params) for _, t, _ in docs]
    assert min(abs(s - P.QUALITY) for s in scores) > 1e-4  # none so near that rounding decides
    one = [r for r, s in zip(docs, scores, strict=True) if s >= P.QUALITY]
    best = {i for i, _, c in near_copies([r[:2] for r in one]) if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = [r for r in one if r[0] in best and not contaminated(r[1], items)]
    before = len(common.MADE)
    got = sorted((r.doc_id, r.chars) for r in P.run(spark, SF).collect())
    assert got == plain_mix(three)
    assert len(common.MADE) == before  # no scratch table stays


def test_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, clashing extra columns."""
    t = "one two three four five six seven eight"
    rows = [(1, t, "en", "a", 9, 1.0), (1, t, "en", "a", 9, 1.0), (2, t, None, None, None, None), (None, t, "en", "b", 1, 0.0), (3, None, "en", "a", 0, 0.0), (4, "", "en", None, 0, 0.0), (5, "x " * 30000, "en", "b", 60000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    two = P.deduplicate(spark, docs, SF)
    assert sorted((r.doc_id for r in two.collect()), key=str) == sorted([1, None, 3, 4, 5], key=str)
    assert P.decontaminate(spark, docs, SF).count() == len(rows)
    four = P.blend(spark, docs, SF)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {1, 2, None, 5}
    assert P.shard(spark, docs, SF).count() == len(rows)
    assert P.classify(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_clashing_names(spark):
    """Extra columns of every name that a stage uses itself pass through."""
    names = ["slope", "copy", "_before", "_start", "size", "position", "words", "taken", "score", "_score", "_row", "row", "grp", "_shard", "shard", "key", "h", "label", "n", "target", "aside0", "stream", "sig", "n_words"]
    t = "the old harbour town keeps its market on the first day of every month"
    rows = [(k, f"{t} {k} {t}", "en", "ab"[k % 2], 1000 + k, *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name == "sharding":
            assert out.columns == ["doc_id", "chars", "shard"] and out.count() == 6
            continue
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], name
