"""Near duplicates of embeddings by p-stable hashing for Euclidean distance.

A projection of a normalised vector on a random normal direction, shifted and
cut into steps of ``STEP``, is equal for two vectors with a probability that
falls with their distance (Datar, Immorlica, Indyk, Mirrokni 2004). ``k`` such
numbers make a bucket; ``tables`` of them are searched, and every pair that
shares a bucket is checked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, bounded
from lexigrid.llm.graph import components
from lexigrid.llm.spans import mix

STEP = 1.0
#: Vectors of a bucket compared in one piece; larger buckets are cut into
#: blocks, and every two blocks meet.
BLOCK = 1000
#: Share of pairs just at the threshold that some table must catch.
RECALL = 0.98
#: Pairs whose products are in memory at once.
PAIRS = 400_000
BROADCAST_BUCKETS = 500_000


def equal_step(distance: float, step: float = STEP) -> float:
    """Probability that two points so far apart fall into the same step."""
    r = step / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(k, tables): k so large that unrelated vectors, at right angles, meet
    about once a table; tables so many that pairs at the threshold are found."""
    near, far = equal_step(math.sqrt(2 - 2 * least)), equal_step(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def buckets_of(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket of each row in each table, 64 bits. Depends on nothing but the
    vector, k and tables."""
    rng = np.random.default_rng([20, unit.shape[1]])
    planes = rng.normal(size=(unit.shape[1], k * tables))
    shift = rng.uniform(0, STEP, k * tables)
    steps = np.floor((unit @ planes + shift) / STEP).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(unit.shape[1] + 1), steps.shape[:2]).copy()
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, i])
    return h.astype(np.int64)


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Normalised rows, in doubles, of packed vectors of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def same_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by length of its vectors."""
    size = np.array([len(v) for v in batch.column("v").to_pylist()])
    for s in np.unique(size):
        yield batch.filter(pa.array(size == s))


def links(group: np.ndarray, side: np.ndarray, whole: np.ndarray, ids: np.ndarray, n: np.ndarray, v: np.ndarray, table: np.ndarray, least: float, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): row pairs of equal group (rows are sorted by it) with cosine of
    at least ``least``. In a group that joins two blocks only rows of different
    sides meet. A pair that an earlier table brings together is left to it."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    ahead = np.repeat(start + size, size) - np.arange(len(group)) - 1  # rows after each in its group
    out_i, out_j = [], []
    cum = np.append(0, np.cumsum(ahead))
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + PAIRS, "right")) - 1)
        reps = ahead[at:to]
        i = np.repeat(np.arange(at, to), reps)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        ok = (whole[i] | (side[i] != side[j])) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        if len(i):
            near = np.einsum("ij,ij->i", v[i], v[j]) >= least
            i, j = i[near], j[near]
            if len(i):
                used, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
                keys = buckets_of(v[used], k, tables)
                first = np.argmax(keys[inv[: len(i)]] == keys[inv[len(i) :]], axis=1)
                ok = first == table[i]
                out_i.append(i[ok])
                out_j.append(j[ok])
        at = to
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def summed(ids: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(id, to, links): links of each id among these pairs, and an id of its
    component among them, instead of the pairs themselves."""
    a, b = ids[i], ids[j]
    u, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    total = np.bincount(x, weights=n[j], minlength=len(u)) + np.bincount(y, weights=n[i], minlength=len(u)) if len(u) else np.zeros(0)
    label = np.arange(len(u))
    while len(u):
        old = label.copy()
        np.minimum.at(label, x, old[y])
        np.minimum.at(label, y, old[x])
        label = label[label]
        if np.array_equal(label, old):
            break
    return pa.RecordBatch.from_pydict({"id": pa.array(u, pa.int64()), "to": pa.array(u[label] if len(u) else u, pa.int64()), "links": pa.array(total.astype(np.int64))})


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two vectors link if their cosine, in doubles, is at least ``least`` and
    some table puts them into one bucket. Equal vectors are one class that is
    compared once and counts as often as it has rows. Vectors that are null,
    zero, of another length, or hold null or non-finite components link with
    nothing; nor do rows with a null vec_id (their component is null). The
    number of tables follows from the number of vectors, so that the work a
    vector grows slowly with it; buckets are never cut short: large ones are
    compared block by block in separate tasks."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    e = F.col("embedding")
    sound = F.coalesce(e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    h = [F.when(F.col("sound"), f).alias(c) for c, f in (("h1", F.xxhash64(e)), ("h2", F.xxhash64(F.lit(1), e, F.size(e))))]
    rows = vectors.select("vec_id", "embedding", (sound & F.col("vec_id").isNotNull()).alias("sound"))
    keyed = scratch.save(rows.select("vec_id", *h))
    classes = rows.where("sound").select("vec_id", "embedding", *h).groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("s"), F.count("*").alias("n"))
    classes = scratch.save(classes.select("h1", "h2", F.col("s.vec_id").alias("id"), "n", F.col("s.embedding").alias("embedding")))
    k, tables = plan_tables(classes.count(), least)
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(x, kind).tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n": b.column("n"), "v": pa.array(rows, pa.binary())})

    units = scratch.save(classes.select("id", "n", "embedding").mapInArrow(packed, "id bigint, n bigint, v binary"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in same_width(whole):
                got = buckets_of(matrix(b.column("v"), kind), k, tables)
                take = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), *[b.column(c).take(take) for c in ("id", "n", "v")]], ["bucket", "t", "id", "n", "v"])

    found = units.mapInArrow(hashed, "bucket bigint, t int, id bigint, n bigint, v binary")
    large = scratch.save(found.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    found = found.join(bounded(large, BROADCAST_BUCKETS), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    found = found.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("g")
    found = found.select(group, "t", "side", (F.col("side") == F.col("other")).alias("same"), "id", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in table.combine_chunks().to_batches():
                for s in same_width(b):
                    g, t, side, ids, n = (s.column(c).to_numpy() for c in ("g", "t", "side", "id", "n"))
                    whole = s.column("same").to_numpy(zero_copy_only=False)
                    i, j = links(g, side, whole, ids, n, matrix(s.column("v"), kind), t, least, k, tables)
                    if len(i):
                        yield summed(ids, n, i, j)

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from run(pa.Table.from_batches([*rest, b.slice(0, cut)]))
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield from run(pa.Table.from_batches(rest))

    met = scratch.save(found.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "id bigint, to bigint, links bigint"))
    comp = scratch.save(components(met.select(F.col("id").alias("a"), F.col("to").alias("b")))).toDF("id", "component")
    total = met.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "id", "n").join(comp, "id", "left").join(total, "id", "left")
    out = keyed.join(known, ["h1", "h2"], "left")
    n_links = F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("bigint")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
