import math
import re
from collections import Counter

import numpy as np

from lexigrid.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


ROWS = [(1, "The cat sat on the mat"), (2, "the cat SAT on a Mat éÉ"), (3, None), (4, ""), (5, "x" * 5000 + " the"), (6, "   \t\n "), (7, "the cat sat on the mat"), (None, "a cat"), (8, "unseen words only")]


def brute(train):
    c = Counter(t for _, x in train for t in toks(x))
    n, v = sum(c.values()), len(c)
    return c, n, v, lambda x: sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks(x))


def test_base_score(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    c, n, v, base = brute([r for r in ROWS if r[0] is None or r[0] < 8])
    for limit in (10**6, 0):
        model = lm.train(docs.where("doc_id is null or doc_id < 8"), vocab_limit=limit)
        assert (model.n, model.v) == (n, v) and (model.filter is None) == (limit == 0)
        got = {r.doc_id: r for r in lm.score(docs, model).collect()}
        assert len(got) == len(ROWS)
        for i, x in ROWS:
            assert got[i].n_tokens == len(toks(x)) and got[i].n_known == sum(c[t] > 0 for t in toks(x))
            assert math.isclose(got[i].base_score, base(x), abs_tol=1e-6)
            assert got[i].score < 0
    assert got[1].score / got[1].n_tokens > got[8].score / got[8].n_tokens


def test_filter_counts():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    c = rng.integers(1, 200, len(h))
    regions, bits = 4, 1 << 16
    of = lm.region_of(h, regions)
    f = lm.Filter(np.concatenate([lm.build_region(lm.key_of(h, regions)[of == r], c[of == r], bits) for r in range(regions)]), np.full(regions, bits))
    got = f.of(h)
    assert (got >= lm.levels(c)).all() and (got == lm.levels(c)).mean() > 0.97
    other = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.of(other) > 0).mean() < 0.03


def test_levels():
    c = np.arange(1, 100_000)
    m = lm.level_count(lm.levels(c))
    assert (m / c <= 1.5).all() and (c / m <= 4 / 3).all() and lm.level_count(np.array([0]))[0] == 0


def test_region_holds_all():
    h, c = np.arange(1000, dtype=np.uint64), np.repeat([1, 9], 500)
    bits = lm.bits_for(c)
    assert bits >= lm.levels(c).sum() * lm.BITS_PER_ENTRY
    f = lm.Filter(lm.build_region(h, c, bits), np.array([bits]))
    assert (f.levels(h, np.zeros(1000, np.int64)) >= lm.levels(c)).all()


def model_of(texts):
    """score() from dictionaries: log10 P of a text, and P(w | u)."""
    one, two = Counter(), Counter()
    for x in texts:
        t = toks(x)
        one.update(t)
        two.update(zip([None, *t[:-1]], t, strict=True))
    m = lambda c: float(lm.level_count(lm.levels(np.array([c])))[0]) if c else 0.0
    after = Counter()
    for (u, _), c in two.items():
        after[u] += m(c)
    mass = sum(map(m, one.values())) + len(one) + 1

    def p(w, u):
        return (m(two[u, w]) + lm.KAPPA * (m(one[w]) + 1) / mass) / (after[u] + lm.KAPPA)

    return one, p, lambda x: sum(math.log10(p(w, u)) for u, w in zip([None, *toks(x)[:-1]], toks(x), strict=True))


def zipf_rows(n):
    rng = np.random.default_rng(5)
    return [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 300) % 5000)) for i in range(n)] + [(100, None), (101, ""), (102, "unseen words only"), (103, " W1 w1\tw1 ")]


def test_score_brute_force(spark):
    rows = zipf_rows(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _, _, want = model_of([x for i, x in rows if i < 50])
    for limit in (10**6, 0):
        model = lm.train(docs.where("doc_id < 50"), vocab_limit=limit, entry_bits=200)
        got = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
        for i, x in rows:
            assert math.isclose(got[i], want(x), rel_tol=1e-7)


def test_probabilities_sum_to_one(spark):
    """After any word, unseen words being one."""
    rows = zipf_rows(60)
    one, p, _ = model_of([x for _, x in rows])
    for u in [*one, "never seen"]:
        mass = sum(p(w, u) for w in [*one, "in no text"])
        assert math.isclose(mass, 1)


def test_clashing_names(spark):
    rows = [(1, "a b a", 5, 6, "x", 7), (2, None, 5, 6, "y", 7), (2, None, 5, 6, "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int, n_tokens int, row string, _row int")
    for limit in (10, 0):
        got = lm.score(docs, lm.train(docs, vocab_limit=limit))
        assert got.columns == ["doc_id", "row", "_row", "n_tokens", "n_known", "base_score", "score"]
        assert sorted((r.doc_id, r.row, r._row, r.n_tokens) for r in got.collect()) == [(1, "x", 7, 4), (2, "y", 7, 1), (2, "y", 7, 1)]


def test_better_than_base(spark):
    from lexigrid.llm.queries import op5_lm

    got = op5_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    model = lm.train(docs)
    assert lm.score(docs, model).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lm.score(one, model).first().n_tokens == 3


def test_no_ngram_left_out(spark):
    """A filter too large to broadcast is joined; the scores stay the same."""
    rows = zipf_rows(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    train = docs.where("doc_id < 50")
    want = {r.doc_id: r for r in lm.score(docs, lm.train(train, 1 << 24, 16)).collect()}
    model = lm.train(train, 1 << 13, 16)
    assert model.filter is None
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.n_tokens, g.n_known) == (w.n_tokens, w.n_known)
        assert math.isclose(g.base_score, w.base_score, abs_tol=1e-6)
    # a filter of 8 bits an entry may take an unseen n-gram for a seen one (2 %
    # at most), but misses none
    apart = sum(abs(got[i].score - w.score) for i, w in want.items())
    assert apart <= 0.01 * sum(w.n_tokens for w in want.values())
    assert lm.score(docs.limit(0), model).count() == 0


def test_joined_scores_in_small_pieces(spark, monkeypatch):
    """Chunks, look-ups and Arrow batches are bounded, and workers give freed
    memory back; none of it changes a score."""
    rows = [(str(i), x) for i, x in zipf_rows(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    _, _, want = model_of([x for _, x in rows])
    monkeypatch.setattr(lm, "CHUNK", 1000)
    model = lm.train(docs, filter_bits=0, entry_bits=200)
    scored = lm.score(docs, model)
    # no list of a chunk's answers is gathered inside the JVM
    assert "collect_list" not in scored._jdf.queryExecution().toString()
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= 4 << 20
    got = {r.doc_id: r.score for r in scored.collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        assert math.isclose(got[i], want(x), rel_tol=1e-7)


def test_blocks():
    cut = lambda size, limit: [(b.start, b.stop) for b in lm.blocks(np.array(size, np.int64), limit)]
    assert cut([], 5) == []
    assert cut([2, 2, 2, 9, 0, 5], 5) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_worker_gives_memory_back():
    """Freed memory leaves the process."""
    import psutil

    own = psutil.Process()
    held = [bytes(100_000) + bytes([i % 256]) for i in range(2000)]
    last = bytes(1000)  # stands above, so that the heap can't shrink by itself
    full = own.memory_info().rss
    del held
    lm.give_back()
    assert last and own.memory_info().rss < full - 150_000_000
