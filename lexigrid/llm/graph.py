"""Connected components by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch

#: Edges that one task may join, 16 bytes each. More are contracted first.
TASK_EDGES = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, m): every end of all edges(a, b) and the smallest node of its
    component, by union-find."""
    ends = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not ends:
        return
    node, at = np.unique(np.concatenate([x for two in zip(*ends, strict=True) for x in two]), return_inverse=True)
    up = list(range(len(node)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    a, b = at.reshape(2, -1).tolist()
    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_pydict({"v": pa.array(node), "m": pa.array(node[[top(x) for x in range(len(up))]])})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node of each component of edges(a, b).

    Each round every node points to the neighbour of least random priority (or
    to itself) and the graph is contracted along these pointers, which removes
    a constant share of the nodes in expectation whatever the graph's shape.
    Minima are aggregated map-side, so a hub with a third of all edges sends
    one row per task. Once at most TASK_EDGES edges are left, one task joins
    them: rounds over few edges cost jobs and tasks, which the driver keeps
    account of, rather than work. Edges with a null end, and loops, link
    nothing."""
    scratch = Scratch(edges.sparkSession, "components")
    live = scratch.save(edges.select("a", "b").where("a <> b").distinct())
    kind = dict(live.dtypes)["a"]
    nodes = None
    step = 0
    while left := live.count():
        if left <= TASK_EDGES:
            to = scratch.save(live.coalesce(1).mapInArrow(joined, f"v {kind}, m {kind}"))
        else:
            both = live.union(live.select("b", "a"))
            rank = lambda c: F.xxhash64(F.col(c), F.lit(step))
            best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("u"), F.min(rank("b")).alias("p"))
            to = scratch.save(best.select(F.col("a").alias("v"), F.when(F.col("p") < rank("a"), F.col("u")).otherwise(F.col("a")).alias("m")))
        # composed lazily from the rounds' tables, in one job at the end
        nodes = to.toDF("node", "cur") if nodes is None else nodes.join(to.toDF("cur", "m"), "cur", "left").select("node", F.coalesce("m", "cur").alias("cur"))
        if left <= TASK_EDGES:
            break
        live = scratch.save(
            live.join(to.toDF("a", "ma"), "a").join(to.toDF("b", "mb"), "b").where("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        )
        step += 1
    if step == 0:  # of no edges, or all joined by one task
        return (live if nodes is None else nodes).toDF("node", "component")
    nodes = scratch.save(nodes)
    low = nodes.groupBy("cur").agg(F.min("node").alias("component"))
    return nodes.join(low, "cur").select("node", "component")
