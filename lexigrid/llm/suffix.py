"""Repeated byte strings from an enhanced suffix array, distributed by anchors.

Every window of ``length`` bytes picks as its anchor the K-byte string of
smallest hash that it holds. Equal windows pick equal anchors, so repeats meet
in the group of their anchor, and only about two positions in 377 are anchors.
Anchors whose neighbourhood occurs once drop out by counting. For the others a
context is cut out that holds every window they can anchor.

In a group the contexts' right parts, from the anchor on, are sorted: a sparse
suffix array with its common-prefix lengths. A stack scan visits the
common-prefix intervals bottom-up. In an interval of depth d the members' left
parts are compared: where neighbours in left order agree on at least
length - d bytes they are one repeat, which is maximal to the right since the
interval ends at d, and to the left since it reaches to where the left
extensions differ. All members of the interval take part, not just neighbours
in the array.

An anchor with very many contexts is no group of one task: its windows are
taken in runs of near offsets, and contexts meet by the core that all windows
of a run hold. Such a group needs only the few bytes around the core, in which
the same tree is scanned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import BROADCAST_IDS, Scratch, bounded, bounded_bytes, free_shuffles, keep_ids
from lexigrid.llm.spans import U64, flat, mix, prefix_sums, ranges_hash, slices

#: Bytes of an anchor.
K = 24
#: Contexts of an anchor, or of a core, that one task takes. Larger anchors are
#: split by cores; the windows of larger cores are counted by hash, spread over
#: all tasks.
GROUP = 20_000


def sliding(x: np.ndarray, w: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of x[i : i + w] for each i (``fill`` beyond the end)."""
    n = len(x)
    size = -(-(n + w) // w) * w
    pad = np.full(size, fill, x.dtype)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    head = ufunc.accumulate(blocks, axis=1).ravel()
    tail = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, tuple]:
    """(positions of anchors, sums for hashing). All positions that tie count."""
    n, w = len(data), length - K + 1
    sums = prefix_sums(data)
    if n < length:
        return np.zeros(0, np.int64), sums
    at = np.arange(n - K + 1)
    g = np.full(n, 0xFFFFFFFF, np.uint32)
    s, p = sums
    top = len(p) - 1
    g[: n - K + 1] = np.minimum(mix((s[at + K] - s[at]) * p[top - at] * U64(pow(pow(int(p[1]), -1, 1 << 64), top, 1 << 64))) >> U64(32), U64(0xFFFFFFFE)).astype(np.uint32) + np.uint32(1)
    low = sliding(g, w, np.minimum, 0xFFFFFFFF)
    size = np.diff(off)
    # a window may start where its whole length is inside the row
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, off[:-1][size >= length], 1)
    np.add.at(valid, (off[1:] - length + 1)[size >= length], -1)
    low[np.cumsum(valid)[:n] == 0] = 0
    # best window start in [p - w + 1, p]
    back = sliding(low[::-1].copy(), w, np.maximum, 0)[::-1]
    return np.flatnonzero(back == g), sums


def anchor_rows(length: int):
    """Maps (row, text) to (row, pos, right, left): each anchor with hashes of
    what any of its windows must hold, the right half or the left one."""
    half = (length - K) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = flat(b.column(b.schema.get_field_index("text")))
                at, sums = anchors(data, off, length)
                doc = np.searchsorted(off, at, "right") - 1
                # a window starts at p - l; l <= half: it covers [p, p + length - half)
                right_end, left_start = at + length - half, at - half
                right_ok, left_ok = right_end <= off[doc + 1], left_start >= off[doc]
                right = ranges_hash(data, at, np.where(right_ok, right_end, at), sums).astype(np.int64)
                left = (ranges_hash(data, np.where(left_ok, left_start, at), at + K, sums) ^ U64(0xA5A5)).astype(np.int64)
                row = b.column(b.schema.get_field_index("row")).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((at - off[doc]).astype(np.int64)), pa.array(right, mask=~right_ok), pa.array(left, mask=~left_ok)], ["row", "pos", "right", "left"])

    return run


SPOT = "anchor bigint, ch bigint, row bigint, pos bigint, side int, size int"
CONTEXT = "anchor bigint, ch bigint, side int, ctx binary, copies bigint"


class Around:
    """Contexts of the anchors at given positions of a batch's rows."""

    def __init__(self, b: pa.RecordBatch, pos: np.ndarray, doc: np.ndarray, length: int):
        self.data, off = flat(b.column(b.schema.get_field_index("text")))
        at, sums = pos + off[doc], prefix_sums(self.data)
        self.start, self.end = np.maximum(off[doc], at - (length - K)), np.minimum(off[doc + 1], at + length)
        self.side = (at - self.start).astype(np.int32)
        anchor = ranges_hash(self.data, at, at + K, sums)
        self.anchor = anchor.astype(np.int64)
        self.ch = mix(ranges_hash(self.data, self.start, self.end, sums) + self.side.astype(U64) * U64(0x9E3779B97F4A7C15)).astype(np.int64)


def listed(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(items of the column ``at``, row of each)."""
    lists = b.column(b.schema.get_field_index("at"))
    return lists.flatten(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())


def spot_rows(length: int):
    """Maps (row, text, at: positions) to SPOT: each anchor with a hash of its
    context, the bytes before it and the context's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                items, doc = listed(b)
                pos = items.to_numpy()
                c = Around(b, pos, doc, length)
                row = b.column(b.schema.get_field_index("row")).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.anchor, c.ch, row, pos, c.side, (c.end - c.start).astype(np.int32))], [x.split()[0] for x in SPOT.split(", ")])

    return run


def context_rows(length: int):
    """Maps (row, text, at: (pos, copies)) to CONTEXT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                items, doc = listed(b)
                c = Around(b, items.field("pos").to_numpy(), doc, length)
                text = c.data.tobytes()
                for lo in range(0, len(doc), 5000):
                    part = slice(lo, lo + 5000)
                    ctx = pa.array([text[i:j] for i, j in zip(c.start[part], c.end[part], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c.anchor[part]), pa.array(c.ch[part]), pa.array(c.side[part]), ctx, items.field("copies").slice(lo, 5000)], [x.split()[0] for x in CONTEXT.split(", ")])

    return run


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows, ``most`` at most."""
    differ = a != b
    first = differ.argmax(1)
    first[~differ[np.arange(len(a)), first]] = a.shape[1]
    return np.minimum(first, most)


def padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    return out, np.array([len(p) for p in parts], np.int64)


def scan(lcp: np.ndarray, lcl: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, members, left) of each common-prefix interval, bottom-up: for
    members (places in the suffix array) in left order, left[i] is what members
    i and i + 1 have in common to the left. lcp[i], lcl[i]: of places (left
    ranks) i - 1 and i."""
    for d, first, last in intervals(lcp[1:].tolist()):
        ranks = rank[first:last]
        order = np.argsort(ranks)
        ranks = ranks[order]
        left = np.minimum.reduceat(lcl, ranks[:-1] + 1)
        left[-1] = lcl[ranks[-2] + 1 : ranks[-1] + 1].min()  # its segment would run on to the end
        yield d, first + order, left


def repeats_in_group(ctx: list[bytes], side: np.ndarray, length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the maximal repeats of at least ``length`` bytes
    around an anchor that these contexts share; a repeat reaches ``left`` bytes
    before the anchor and ``right`` from it on. members: all that hold it."""
    order, lcp, lcl, rank = suffix_array(ctx, side, length)
    for d, members, left in scan(lcp, lcl, rank):
        for ext, i, j in intervals([int(x) for x in left]):
            part = np.sort(members[i:j])
            # all of them deeper than d: a repeat of an inner interval
            if ext + d >= length and lcp[part[0] + 1 : part[-1] + 1].min() == d:
                yield ext, d, sorted(order[p] for p in part)


def intervals(gaps: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, i, j): runs of items i to j - 1 that have ``depth`` in common
    and that no neighbour shares, gaps[k] being common to items k and k + 1.
    Bottom-up by a stack."""
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*gaps, -1]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, k + 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def suffix_array(ctx: list[bytes], side: np.ndarray, length: int):
    """(order, lcp, lcl, rank) of the contexts of one anchor."""
    rights = [c[s:] for c, s in zip(ctx, side, strict=True)]
    lefts = [c[:s][::-1] for c, s in zip(ctx, side, strict=True)]
    order = sorted(range(len(ctx)), key=rights.__getitem__)
    by_left = sorted(range(len(ctx)), key=lambda i: lefts[order[i]])
    right, rn = padded([rights[i] for i in order], length)
    left, ln = padded([lefts[order[i]] for i in by_left], length)
    lcp = np.append(0, common(right[1:], right[:-1], np.minimum(rn[1:], rn[:-1])))
    lcl = np.append(0, common(left[1:], left[:-1], np.minimum(ln[1:], ln[:-1])))
    rank = np.empty(len(ctx), np.int64)
    rank[by_left] = np.arange(len(ctx))
    return order, lcp, lcl, rank


def cover_group(ctx: list[bytes], side: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before the anchor, and from it on, that repeats cover in each
    context; -1 and -1 where none does. copies: occurrences of each context."""
    total = np.array([len(c) for c in ctx], np.int64)
    twin = (copies > 1) & (total >= length)
    before, after = np.where(twin, side, -1), np.where(twin, total - side, -1)
    if len(ctx) == 1 or twin.all():
        return before, after
    if not length:
        return side * 0, side * 0
    order, lcp, lcl, rank = suffix_array(ctx, side, length)
    order = np.array(order)
    for d, members, left in scan(lcp, lcl, rank):
        best = np.zeros(len(members), np.int64)
        best[:-1] = left
        best[1:] = np.maximum(best[1:], left)
        hit = best + d >= length
        at = order[members[hit]]
        before[at] = np.maximum(before[at], best[hit])
        after[at] = np.maximum(after[at], d)
    return before, after


COVER = "anchor bigint, ch bigint, before bigint, after bigint"


def by_group(key: str, groups):
    """Maps batches sorted by ``key`` through groups(table), which gets tables
    that hold whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy()
            first = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if first:
                yield groups(pa.Table.from_batches([*rest, b.slice(0, first)]))
                rest = []
            rest.append(b.slice(first))
        if rest:
            yield groups(pa.Table.from_batches(rest))

    return run


def bounds(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return zip(cut, np.append(cut[1:], len(key)), strict=True)


def covers(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "ch", "before", "after"])


def cover_rows(length: int):
    """Maps contexts sorted by anchor to COVER, a group at a time."""

    def groups(table: pa.Table) -> pa.RecordBatch:
        anchor, ch, copies = (table.column(c).to_numpy() for c in ("anchor", "ch", "copies"))
        side, ctx = table.column("side").to_numpy().astype(np.int64), table.column("ctx").to_pylist()
        before, after = np.full(len(anchor), -1), np.full(len(anchor), -1)
        for i, j in bounds(anchor):
            if j - i > 1 or copies[i] > 1:
                before[i:j], after[i:j] = cover_group(ctx[i:j], side[i:j], copies[i:j], length)
        hit = after >= 0
        return covers(anchor[hit], ch[hit], before[hit], after[hit])

    return by_group("anchor", groups)


def runs_of(length: int) -> list[tuple[int, int]]:
    """(first, last) offsets of the runs in which an anchor's windows are
    taken; an offset is the number of bytes from the window to the anchor."""
    n = length - K + 1
    each = -(-n // 8)
    return [(k, min(k + each, n) - 1) for k in range(0, n, each)]


CORE = "h bigint, anchor bigint, ch bigint, run int, copies bigint"
RING = "h bigint, anchor bigint, ch bigint, run int, copies bigint, head binary, tail binary"
WINDOW = "h bigint, anchor bigint, ch bigint, off bigint, copies bigint"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Parts:
    """A few contexts as one array of bytes."""

    def __init__(self, b: pa.RecordBatch):
        self.parts = b.column(b.schema.get_field_index("ctx")).to_pylist()
        self.base = np.append(0, np.cumsum([len(p) for p in self.parts]))
        self.data = np.frombuffer(b"".join(self.parts), np.uint8)
        self.side, self.size = b.column(b.schema.get_field_index("side")).to_numpy().astype(np.int64), np.diff(self.base)

    def hashes(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        h = ranges_hash(self.data, self.base[doc] + start, self.base[doc] + end) ^ mix(salt.astype(U64))
        return h.astype(np.int64)


def core_rows(length: int):
    """Maps CONTEXT to CORE: of each context and run of windows a hash of the
    core, which is what all windows of the run hold."""
    first, last = (np.array(x) for x in zip(*runs_of(length), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                c = Parts(s)
                doc, k = np.divmod(np.arange(s.num_rows * len(first)), len(first))
                start, end = c.side[doc] - first[k], c.side[doc] - last[k] + length
                ok = (start >= 0) & (end <= c.size[doc])
                doc, k, start, end = doc[ok], k[ok], start[ok], end[ok]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(c.hashes(doc, start, end, k)), s.column("anchor").take(take), s.column("ch").take(take), pa.array(k.astype(np.int32)), s.column("copies").take(take)], names(CORE))

    return run


def ring_rows(length: int):
    """Maps contexts with ``runs`` (structs of h and run) to RING: what windows
    of the run hold before the core and after it."""
    runs = runs_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                c, lists = Parts(s), s.column(s.schema.get_field_index("runs"))
                flat_, doc = lists.flatten(), np.repeat(np.arange(s.num_rows), lists.value_lengths().to_numpy())
                head, tail = [], []
                for i, k in zip(doc.tolist(), flat_.field("run").to_pylist(), strict=True):
                    text, side, (first, last) = c.parts[i], int(c.side[i]), runs[k]
                    head.append(text[max(0, side - last) : side - first])
                    tail.append(text[side - last + length : side - first + length])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([flat_.field("h"), s.column("anchor").take(take), s.column("ch").take(take), flat_.field("run"), s.column("copies").take(take), pa.array(head, pa.binary()), pa.array(tail, pa.binary())], names(RING))

    return run


def ring_cover_rows(length: int):
    """Maps RING sorted by h to COVER. Members of a group have its core in
    common; what they need of a window's other bytes is compared as around an
    anchor."""
    runs = runs_of(length)

    def groups(table: pa.Table) -> pa.RecordBatch:
        h, anchor, ch, run, copies = (table.column(c).to_numpy() for c in ("h", "anchor", "ch", "run", "copies"))
        heads, tails = table.column("head").to_pylist(), table.column("tail").to_pylist()
        before, after = np.full(len(h), -1), np.full(len(h), -1)
        for i, j in bounds(h):
            first, last = runs[run[i]]
            side = np.array([len(x) for x in heads[i:j]], np.int64)
            got = cover_group([x + y for x, y in zip(heads[i:j], tails[i:j], strict=True)], side, copies[i:j], last - first)
            hit = got[1] >= 0
            before[i:j][hit], after[i:j][hit] = got[0][hit] + first, got[1][hit] + length - last
        hit = after >= 0
        return covers(anchor[hit], ch[hit], before[hit], after[hit])

    return by_group("h", groups)


def window_rows(length: int):
    """Maps contexts with ``runs`` to WINDOW: each window of these runs."""
    first, last = (np.array(x) for x in zip(*runs_of(length), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                s = b.slice(lo, 200)
                c, lists = Parts(s), s.column(s.schema.get_field_index("runs"))
                k = lists.flatten().field("run").to_numpy()
                doc, n = np.repeat(np.arange(s.num_rows), lists.value_lengths().to_numpy()), last[k] - first[k] + 1
                off = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc, n)
                start, end = c.side[doc] - off, c.side[doc] - off + length
                ok = (start >= 0) & (end <= c.size[doc])
                doc, off, start, end = doc[ok], off[ok], start[ok], end[ok]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(c.hashes(doc, start, end, off)), s.column("anchor").take(take), s.column("ch").take(take), pa.array(off), s.column("copies").take(take)], names(WINDOW))

    return run


def cover_by_cores(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """COVER of contexts whose anchors have too many of them for one task. Of
    runs of windows, first the cores are counted: where the core occurs once,
    so do the windows. The others meet in groups by their core. The windows of
    a core that is still in over GROUP contexts are counted by hash."""
    contexts = scratch.save(contexts)
    cores = scratch.save(contexts.mapInArrow(core_rows(length), CORE))
    known = scratch.save(cores.groupBy("h").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).where("c > 1").select("h", (F.col("n") > GROUP).alias("large")))
    met = cores.join(bounded(known, BROADCAST_IDS), "h").groupBy("anchor", "ch", "large").agg(F.collect_list(F.struct("h", "run")).alias("runs"))
    met = scratch.save(contexts.join(scratch.save(met), ["anchor", "ch"]))
    rings = met.where("not large").mapInArrow(ring_rows(length), RING)
    out = rings.repartition("h").sortWithinPartitions("h").mapInArrow(ring_cover_rows(length), COVER)
    if not known.where("large").isEmpty():
        windows = scratch.save(met.where("large").mapInArrow(window_rows(length), WINDOW))
        twice = scratch.save(windows.groupBy("h").agg(F.sum("copies").alias("c")).where("c > 1").select("h"))
        hit = windows.join(bounded(twice, BROADCAST_IDS), "h", "left_semi")
        out = out.union(hit.select("anchor", "ch", F.col("off").alias("before"), (F.lit(length) - F.col("off")).alias("after")))
    # all covers of a context hold its anchor, so together they are one
    return out.groupBy("anchor", "ch").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def strip_rows():
    """Maps (doc_id, text, spans) to the query's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = flat(b.column(b.schema.get_field_index("text")))
                text = data.tobytes()
                spans = b.column(b.schema.get_field_index("spans"))
                removed, runs, sums = [], [], []
                for i in range(b.num_rows):
                    own, kept, at, gone, n = text[off[i] : off[i + 1]], hashlib.sha256(), 0, 0, 0
                    for s, e in ((x["s"], x["e"]) for x in spans[i].as_py() or []):
                        kept.update(own[at:s])
                        at, gone, n = e, gone + e - s, n + 1
                    kept.update(own[at:])
                    removed.append(gone)
                    runs.append(n)
                    sums.append(kept.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps (row, spans) to the same with spans merged."""
    for b in batches:
        spans = [[{"s": s, "e": e} for s, e in merged(x)] for x in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, b.column("spans").type)], ["row", "spans"])


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted maximal runs of (s, e); spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: a hash of both. Repeated rows share it, and each is
    an occurrence of its own."""
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull().cast("int"), "doc_id", "text").alias("row"))


def at_rows(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(row, text, at) of the rows in at(row, at: array), a written table. The
    lists are shuffled to their texts at every size."""
    return keep_ids(docs.select("row", "text"), at.select("row"), "row").join(at.hint("merge"), "row")


def spots_of(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """SPOT of the anchors that may lie in a repeat, of keyed documents."""
    found = scratch.save(docs.select("row", "text").mapInArrow(anchor_rows(length), "row bigint, pos bigint, right bigint, left bigint"))
    keys = found.select(F.col("right").alias("h")).union(found.select("left")).where("h is not null")
    twice = scratch.save(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    right = found.join(twice.withColumnRenamed("h", "right"), "right", "left_semi").select("row", "pos")
    left = found.join(twice.withColumnRenamed("h", "left"), "left", "left_semi").select("row", "pos")
    at = scratch.save(right.union(left).groupBy("row").agg(F.collect_set("pos").alias("at")))
    scratch.drop(found, twice)
    free_shuffles(docs.sparkSession)
    spots = scratch.save(at_rows(docs, at).mapInArrow(spot_rows(length), SPOT))
    scratch.drop(at)
    free_shuffles(docs.sparkSession)
    return spots


def distinct_contexts(spots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(anchor, ch, copies, side, size, row and pos of one copy) and (anchor,
    n: how many different contexts it has) of anchors with several. Only light
    rows are shuffled; copies shrink map-side."""
    one = spots.groupBy("anchor", "ch").agg(F.count("*").alias("copies"), F.max("side").alias("side"), F.max("size").alias("size"), F.min("row").alias("row"), F.min_by("pos", "row").alias("pos"))
    one = scratch.save(one)
    return one, scratch.save(one.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))


def cut_contexts(docs: DataFrame, chosen: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """CONTEXT of chosen distinct contexts, each cut from its one copy."""
    at = scratch.save(chosen.groupBy("row").agg(F.collect_list(F.struct("pos", "copies")).alias("at")))
    # equal rows would give a context twice
    return at_rows(docs, at).dropDuplicates(["row"]).mapInArrow(context_rows(length), CONTEXT) if repeated(docs) else at_rows(docs, at).mapInArrow(context_rows(length), CONTEXT)


def repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def covered_spans(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(row, s, e): for each anchor in a repeat, the bytes that repeats of at
    least ``length`` around it cover."""
    docs = keyed(docs).where(F.octet_length("text") >= length)
    spots = spots_of(docs, length, scratch)
    one, counts = distinct_contexts(spots, scratch)
    hot = scratch.save(counts.where(F.col("n") > GROUP).select("anchor"))
    large = not hot.isEmpty()
    # rows of hot anchors are kept out of the join by anchor
    cool = one.join(bounded(hot, BROADCAST_IDS), "anchor", "left_anti") if large else one
    known = scratch.save(cool.join(counts.where(F.col("n") <= GROUP).hint("merge"), "anchor", "left"))
    # the only context of its anchor is covered if it has copies
    alone = known.where((F.col("copies") > 1) & F.col("n").isNull() & (F.col("size") >= length))
    cover = alone.select("anchor", "ch", F.col("side").cast("bigint").alias("before"), (F.col("size") - F.col("side")).cast("bigint").alias("after"))
    some = cut_contexts(docs, known.where("n is not null"), length, scratch)
    cover = cover.union(some.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(cover_rows(length), COVER))
    if large:
        cover = cover.union(cover_by_cores(cut_contexts(docs, one.join(bounded(hot, BROADCAST_IDS), "anchor", "left_semi"), length, scratch), length, scratch))
    cover = scratch.save(cover)
    scratch.drop(one, counts, known)
    free_shuffles(docs.sparkSession)
    hit = spots.select("anchor", "ch", "row", "pos").join(cover.hint("merge"), ["anchor", "ch"])
    return hit.select("row", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + F.col("after")).alias("e"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Removes every byte covered by a string of ``length`` bytes (more than K)
    that starts somewhere else too, in the same text or another; all copies go.
    Null texts are empty. Repeated rows are occurrences of their own. Matches
    never cross documents. Columns but doc_id and text are not looked at, so
    their names can't clash. Anchors and contexts are grouped by 64-bit hashes;
    what is compared inside a group are the bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = covered_spans(docs, length, scratch).groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = scratch.save(spans.mapInArrow(merge_rows, spans.schema))
    free_shuffles(docs.sparkSession)
    rows = keyed(docs).join(bounded_bytes(spans, F.size("spans") * 16 + 48), "row", "left")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "spans").mapInArrow(strip_rows(), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def maximal_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(repeat, bytes, occurrences: array of (row, start)): maximal repeats
    around each anchor with all their occurrences. row is keyed()'s. A repeat
    longer than a context shows as one entry for each of its anchors, cut at
    the context. An anchor's distinct contexts are one task's, however many."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = keyed(docs).where(F.octet_length("text") >= length)
    spots = spots_of(docs, length, scratch)
    one, counts = distinct_contexts(spots, scratch)
    small = cut_contexts(docs, one.join(counts, "anchor", "left").where("n > 1 or copies > 1"), length, scratch)

    def report(table: pa.Table) -> pa.Table:
        ch, side, ctx = table.column("ch").to_pylist(), table.column("side").to_numpy().astype(np.int64), table.column("ctx").to_pylist()
        out: dict[str, list] = {"repeat": [], "bytes": [], "before": [], "ch": []}
        found = list(repeats_in_group(ctx, side, length)) if len(ctx) > 1 else []
        found += [(int(s), len(c) - int(s), [i]) for i, (c, s, n) in enumerate(zip(ctx, side, table.column("copies").to_pylist(), strict=True)) if n > 1 and len(c) >= length]
        for left, right, members in found:
            i = members[0]
            name = hashlib.sha256(ctx[i][side[i] - left : side[i] + right]).hexdigest()
            for m in members:
                for k, v in (("repeat", name), ("bytes", left + right), ("before", left), ("ch", ch[m])):
                    out[k].append(v)
        return pa.table(out, schema=pa.schema([("repeat", pa.string()), ("bytes", pa.int64()), ("before", pa.int64()), ("ch", pa.int64())])).append_column("anchor", pa.array([table.column("anchor")[0].as_py()] * len(out["ch"]), pa.int64()))

    named = small.groupBy("anchor").applyInArrow(report, "repeat string, bytes bigint, before bigint, ch bigint, anchor bigint")
    hits = named.join(spots, ["anchor", "ch"]).select("repeat", "bytes", "row", (F.col("pos") - F.col("before")).alias("start")).distinct()
    return hits.groupBy("repeat", "bytes").agg(F.collect_list(F.struct("row", "start")).alias("occurrences"))
