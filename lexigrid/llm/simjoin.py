"""N-gram Jaccard join by vertical partitioning.

Documents are sets of distinct word shingles; the unit of work is the distinct
set (its 64-bit signature), so exact copies are one unit from the start.

Counting. The space of shingle hashes is cut into fragments. Map tasks send
each fragment its part of every set as packed bytes (5 bytes a shingle); what
a task itself sees in two sets is settled there and sent once, so a shingle of
a third of all documents costs a row a task. A fragment tells how many of a
set's shingles other sets have too; the partial counts are summed. A set of
which less than 80 % is shared can link with nothing and is done.

Joining. What is left is ordered by rarity and the global order is cut into
fragments again: each holds a segment of every set. Pairs that share a token
of their prefixes and pass the length and positional bounds are candidates;
their overlap is counted fragment by fragment and summed per pair.

Candidates that a sketch proves apart are left out: the parities of the sets'
counts in hash buckets differ in no more buckets than the sets do in shingles.

Where only components are asked for, a prefix token's documents are first
joined with one of them alone, drawn anew for every token, then those that this
left apart with another, and so on while links appear (each round is linear in
the group). Then pairs still in different components are joined, each exactly
as before. No pair that can link is skipped unless its ends are connected
already. With ``links`` every pair is joined and counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, free_shuffles, input_bytes, keep_ids, pieces
from lexigrid.llm.graph import components
from lexigrid.llm.spans import U64, Words, flat, mix, shingles, slices

#: Shingles of one buffer of a map task.
BUFFER = 800_000
#: Bytes of input to a fragment, which is what a task counts at once.
FRAGMENT_BYTES = 8 << 20
#: Shingles to a word of 64 parities of a set's sketch.
SKETCH = 8
#: Rounds with one document to a token before all pairs are joined.
ROUNDS = 4
UNIT = "kind int, frag int, doc_id bigint, sig bigint, n bigint, buf bigint, cnt bigint, sigs binary, counts binary, keys binary, more binary, twice binary, twice_more binary"
COUNTED = "kind int, doc_id bigint, sig bigint, n bigint, buf bigint, cnt bigint"


def sets_of(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, size of each row's set, signature): distinct shingles of
    each row, sorted."""
    row, h = shingles(Words(data, off), words)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
    row, h = row[new], h[new]
    rows = len(off) - 1
    total = np.append(U64(0), np.cumsum(mix(h ^ U64(0x5EED))))
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    return row, h, n, mix(total[first[1:]] - total[first[:-1]] + n.astype(U64))


def pack(h: np.ndarray) -> tuple[bytes, bytes]:
    """The low 40 bits of hashes, as 4 bytes and 1."""
    return (h & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (h >> U64(32) & U64(0xFF)).astype(np.uint8).tobytes()


def unpack(keys: list[bytes], more: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint32).astype(U64) | np.frombuffer(b"".join(more), np.uint8).astype(U64) << U64(32)


def emit(words: int, fragments: int):
    shift, most = U64(64 - (fragments.bit_length() - 1)), BUFFER
    schema = pa.schema([("kind", pa.int32()), ("frag", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "sig", "n", "buf", "cnt")], *[(c, pa.binary()) for c in ("sigs", "counts", "keys", "more", "twice", "twice_more")]])

    def table(**cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

    def flush(parts: list[tuple], buf: int) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *[len(p[2]) for p in parts]])
        row = np.concatenate([p[0] + b for p, b in zip(parts, base[:-1], strict=True)])
        h, n, sig = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        ids = pa.concat_arrays([p[4] for p in parts])
        signed = sig.astype(np.int64)
        spot = (sig & U64(fragments - 1)).astype(np.int32)
        yield table(kind=np.zeros(len(n), np.int32), frag=spot, doc_id=ids, sig=signed, n=n.astype(np.int64))
        _, first = np.unique(sig, return_index=True)
        unit = np.zeros(len(n), bool)
        unit[first] = n[first] > 0
        live = unit[row]
        row, h = row[live], h[live]
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        new = np.append(True, sorted_h[1:] != sorted_h[:-1])[: len(h)]
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        twice = np.empty(len(h), bool)
        twice[order] = np.repeat(runs > 1, runs)
        cnt = np.bincount(row[twice], minlength=len(n))
        u = np.flatnonzero(unit)
        yield table(kind=np.full(len(u), 2, np.int32), frag=spot[u], sig=signed[u], n=n[u].astype(np.int64), buf=np.full(len(u), buf), cnt=cnt[u].astype(np.int64))
        both = sorted_h[new][runs > 1]  # sorted, so fragments are runs
        row, h = row[~twice], h[~twice]
        frag = (h >> shift).astype(np.int64) if fragments > 1 else np.zeros(len(h), np.int64)
        order = np.argsort(frag << 32 | row, kind="stable")
        row, h, frag = row[order], h[order], frag[order]
        cut = np.searchsorted(frag, np.arange(fragments + 1))
        both_cut = np.searchsorted(both >> shift if fragments > 1 else np.zeros(len(both)), np.arange(fragments + 1))
        out: dict[str, list] = {c: [] for c in ("frag", "sigs", "counts", "keys", "more", "twice", "twice_more")}
        for f in range(fragments):
            i, j, a, b = cut[f], cut[f + 1], both_cut[f], both_cut[f + 1]
            if i < j or a < b:
                r = row[i:j]
                start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))[: len(r)]
                keys, more = pack(h[i:j])
                t, tm = pack(both[a:b])
                for c, v in (("frag", f), ("sigs", sig[r[start]].tobytes()), ("counts", np.diff(np.append(start, len(r))).astype(np.uint32).tobytes()), ("keys", keys), ("more", more), ("twice", t), ("twice_more", tm)):
                    out[c].append(v)
        size = len(out["frag"])
        yield table(kind=np.ones(size, np.int32), buf=np.full(size, buf), **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                got = sets_of(*flat(b.column(b.schema.get_field_index("text"))), words)
                parts.append((*got, b.column(b.schema.get_field_index("doc_id"))))
                size += len(got[0])
                if size >= most:
                    yield from flush(parts, buf)
                    buf, parts, size = buf + 1, [], 0
        if parts:
            yield from flush(parts, buf)

    return run


def count_fragment(table: pa.Table) -> pa.Table:
    """Of one fragment: how many shingles of each set others have too. Rows of
    documents and a task's own counts pass through."""
    kind = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kind != 1)).select([c.split()[0] for c in COUNTED.split(", ")])
    rows = table.filter(pa.array(kind == 1))
    col = lambda c: rows.column(c).to_pylist()
    sigs = np.frombuffer(b"".join(col("sigs")), U64)
    counts = np.frombuffer(b"".join(col("counts")), np.uint32)
    if not len(sigs):
        return passed
    bufs = np.repeat(rows.column("buf").to_numpy(), [len(x) // 8 for x in col("sigs")])
    keys = unpack(col("keys"), col("more"))
    twice = np.unique(unpack(col("twice"), col("twice_more")))
    unit = np.repeat(np.arange(len(sigs)), counts)
    order = np.lexsort((sigs[unit], keys))
    k, s = keys[order], sigs[unit[order]]
    new = np.append(True, k[1:] != k[:-1])
    other = np.append(True, new[1:] | (s[1:] != s[:-1]))
    start = np.flatnonzero(new)
    df = np.add.reduceat(other.astype(np.int64), start)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, k[start]), len(twice) - 1)
        df += 2 * (twice[at] == k[start])
    shared = np.empty(len(k), bool)
    shared[order] = np.repeat(df > 1, np.diff(np.append(start, len(k))))
    total = np.bincount(unit[shared], minlength=len(sigs))
    u = np.flatnonzero(total)
    own = pa.table({"kind": pa.array(np.full(len(u), 1, np.int32)), "doc_id": pa.nulls(len(u), pa.int64()), "sig": pa.array(sigs[u].astype(np.int64)), "n": pa.nulls(len(u), pa.int64()), "buf": pa.array(bufs[u]), "cnt": pa.array(total[u])})
    return pa.concat_tables([passed, own.cast(passed.schema)])


def set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                row, h, n, sig = sets_of(*flat(b.column(b.schema.get_field_index("text"))), words)
                yield pa.RecordBatch.from_pydict({"node": pa.array(sig[row].astype(np.int64)), "n": pa.array(n[row].astype(np.int64)), "h": pa.array(h.astype(np.int64))})

    return run


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text);
    with ``links`` also n_links, the number of other documents it links with.

    A set holds the distinct shingles of ``words`` words, A-Z lower-cased; of
    fewer words the whole sequence; null or blank texts have none and link
    with nothing. Two documents link if 100 * intersection >= percent * union,
    and component_id is the smallest doc_id that links reach. Rows with a null
    doc_id are counted but link with nothing (null component, no links).
    Repeated rows are copies. Other columns are not looked at. Shingles and
    sets are known by 64-bit hashes. Links can be as many as the square of a
    group of near copies: ask for them where that is affordable."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simjoin")
    fragments = pieces(input_bytes(docs), FRAGMENT_BYTES)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sent = docs.mapInArrow(emit(words, fragments), UNIT)
    counted = scratch.save(sent.groupBy("frag").applyInArrow(count_fragment, COUNTED))
    free_shuffles(spark)
    units = counted.where("kind = 0").select("doc_id", "sig", "n")
    # a task's buffer knows all of its own sets' shingles, so of several
    # buffers with one set each has the whole count
    shared = counted.where("kind > 0").groupBy("sig", "buf").agg(F.sum("cnt").alias("cnt"), F.max("n").alias("n")).groupBy("sig").agg(F.max("cnt").alias("cnt"), F.max("n").alias("n"))
    alive = shared.where(F.col("cnt") * 100 >= F.col("n") * percent).select("sig")
    classes = scratch.save(units.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = scratch.save(classes.join(alive, "sig", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    texts = keep_ids(docs, reps, "doc_id").dropDuplicates(["doc_id", "text"])
    pairs = join_sets(scratch, texts.mapInArrow(set_rows(words), "node bigint, n bigint, h bigint"), percent, links)
    comp = scratch.save(components(pairs)).withColumnRenamed("node", "sig")
    named = classes.join(comp, "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "c")
    if links:
        size = classes.select(F.col("sig").alias("b"), F.col("copies").alias("others"))
        total = pairs.union(pairs.select("b", "a")).join(size, "b").groupBy(F.col("a").alias("sig")).agg(F.sum("others").alias("others"))
        named = named.join(total, "sig", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    counts = ["n_links"] * links
    named = scratch.save(named.select("sig", "n", "component_id", *counts))
    out = units.join(named, ["sig", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    known = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in counts]
    return out.select("doc_id", F.col("n").alias("n_shingles"), *known, component.alias("component_id"))


def sketches(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sketch): parities of how many of the shingles that others have
    too fall into each hash bucket, 64 to a word; the larger the set, the more
    words. A power of two of them, so that a sketch folds to a shorter one."""
    words = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(SKETCH)) / SKETCH))).cast("int")
    hs = segments.join(nodes, "node", "left_semi").select("node", words.alias("words"), F.explode("hs").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(63)).cast("int"))
    at = F.col("h").bitwiseAND(F.col("words") - 1).cast("int")
    parts = hs.groupBy("node", "words", at.alias("at")).agg(F.bit_xor(bit).alias("bits"))
    maps = parts.groupBy("node", "words").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("bigint")))
    return maps.select("node", each.alias("sketch"))


def least_apart(x: str, y: str, percent: int) -> Column:
    """In how many shingles two sets differ at least, by their sketches."""
    n = F.least(F.size(x), F.size(y))

    def folded(c: Column) -> Column:
        for _ in range((-(-100 // percent) - 1).bit_length()):  # sizes of sets that can link differ by so many halvings
            half = F.floor(F.size(c) / 2).cast("int")
            halves = F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda a, b: a.bitwiseXOR(b))
            c = F.when(F.size(c) > n, halves).otherwise(c)
        return c

    differ = F.zip_with(folded(F.col(x)), folded(F.col(y)), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differ, F.lit(0), lambda total, v: total + v)


def join_sets(scratch: Scratch, rows: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """links(a, b) among rows(node, n, h): all of them, or enough to connect
    all that are connected. Nodes of equal id are one set."""
    rows = scratch.save(rows)
    df = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.floor(F.log2("df")).cast("int")
    # fragments are ranges of the global order (log2 of the frequency, hash)
    frag = (rare * 4 + F.shiftright("h", 62) + 2).cast("int")
    segments = rows.join(df, "h").groupBy("node", "n", frag.alias("frag")).agg(F.sort_array(F.collect_set("h")).alias("hs"))
    segments = scratch.save(segments)
    whole = segments.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("frag", "hs"))).alias("s"), F.sum(F.size("hs")).alias("m"))
    need = F.floor((F.col("n") * percent + 99) / 100).cast("bigint")
    alone = F.col("n") - F.col("m")  # shingles of no other set stand first in the order
    length = (F.col("n") - need + 1 - alone).cast("int")
    tokens = F.slice(F.flatten(F.transform("s", lambda x: x["hs"])), F.lit(1), length)
    prefix = whole.where(F.col("m") >= need).select("node", "n", alone.alias("alone"), F.posexplode(tokens).alias("i", "h"))
    prefix = scratch.save(prefix.select("node", "n", (F.col("n") - F.col("alone")).alias("m"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "h"))

    def bound(x: str, y: str):
        """Length and positional bounds: the overlap that is left from here on."""
        size = F.col(f"{x}n") + F.col(f"{y}n")
        return F.least(f"{x}rest", f"{y}rest") * (100 + percent) >= size * percent

    def renamed(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "h" else p + c) for c in df.columns])

    def ordered(df: DataFrame) -> DataFrame:
        low = F.col("x_node") < F.col("y_node")
        pick = lambda k, first: F.when(low == F.lit(first), F.col(f"x_{k}")).otherwise(F.col(f"y_{k}"))
        return df.select(*[pick(k, c == "a").alias(t + c) for k, t in (("node", ""), ("n", "n"), ("m", "m")) for c in "ab"]).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """Overlaps by fragment, summed per pair."""
        left = pairs.join(segments.select(F.col("node").alias("a"), "frag", F.col("hs").alias("ha")), "a")
        both = left.join(segments.select(F.col("node").alias("b"), "frag", F.col("hs").alias("hb")), ["b", "frag"])
        part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("part"))
        total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
        return scratch.save(total.where(F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"))

    def close(m, n, x: str, y: str):
        """The overlap that the sketches leave possible."""
        return (m - least_apart(x, y, percent)) * (100 + percent) >= n * 2 * percent

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(drawn.toDF("a", "sa"), "a").join(drawn.toDF("b", "sb"), "b")
        return both.where(close(F.col("ma") + F.col("mb"), F.col("na") + F.col("nb"), "sa", "sb")).drop("sa", "sb", "ma", "mb")

    drawn = scratch.save(sketches(segments, prefix.select("node").distinct()))
    meet = bound("x_", "y_") & close(F.col("x_m") + F.col("y_m"), F.col("x_n") + F.col("y_n"), "x_sketch", "y_sketch")
    if every:
        told = prefix.join(drawn, "node")
        return verify(scratch.save(ordered(renamed(told, "x_").join(renamed(told, "y_"), "h").where((F.col("x_node") < F.col("y_node")) & meet)).drop("ma", "mb")))

    held = prefix.withColumn("c", F.col("node")).withColumn("main", F.lit(None).cast("bigint"))
    links, tried = None, None
    for k in range(ROUNDS):
        # each token's documents outside its largest component with one of all
        hubs = held.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(k), "node", "h").alias("order"), "node", "n", "m", "rest", "c")).alias("y"))
        hubs = hubs.select("h", *[F.col(f"y.{c}").alias(f"y_{c}") for c in ("node", "n", "m", "rest", "c")])
        left = renamed(held.where("main is null or c <> main"), "x_")
        pairs = scratch.save(near(ordered(left.join(hubs, "h").where((F.col("x_c") != F.col("y_c")) & bound("x_", "y_")))))
        found = verify(pairs)
        if links is not None and found.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        comp = scratch.save(components(links))
        held = prefix.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        sizes = held.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        held = scratch.save(held.join(sizes.select("h", "main"), "h"))
    # then pairs whose ends are still apart; a token's largest component need not meet itself
    apart = scratch.save(held.join(drawn, "node"))
    x, y = renamed(apart.where("c <> main").drop("main"), "x_"), renamed(apart, "y_")
    once = (F.col("y_c") == F.col("y_main")) | (F.col("x_node") < F.col("y_node"))
    rest = ordered(x.join(y, "h").where((F.col("x_c") != F.col("y_c")) & once & meet)).drop("ma", "mb")
    more = verify(scratch.save(rest.join(tried, ["a", "b", "na", "nb"], "left_anti")))
    return links.union(more)
