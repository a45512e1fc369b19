"""Language-model scoring with a log-frequency Bloom filter.

Counts are quantised, q(c) = 1 + floor(log2 c), and an n-gram enters the
filter q times, together with 1, 2, .., q; it is read back by probing 1, 2, ..
until one is missing (Talbot and Osborne 2007). The filter is cut into regions
by the n-gram's hash, so each reducer builds its own region, sized by its
entries. Where all of them together fit FILTER_BITS the filter is broadcast;
else the regions stay written tables and are probed by a join.

With m(x) the middle of x's level, 0 for n-grams that were not seen:

    P(w | u) = (m(u w) + kappa * P(w)) / (M(u) + kappa)
    P(w) = (m(w) + 1) / M,  M = sum of m + V + 1

M(u) is the sum of m(u w) over all w that followed u, kept next to u's exact
count. So the probabilities after any u sum to 1, unseen words being one."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Scratch, bound_bytes, free_shuffles, give_back, input_bytes, pieces
from lexigrid.llm.spans import POLY, U64, Words, flat, mix, slices

#: Size of a filter that is broadcast: 64 MB. A larger one is joined.
FILTER_BITS = 1 << 29
#: Bits an entry needs at least, and hash functions.
BITS_PER_ENTRY, HASHES = 8, 6
#: Bytes of input to a region, which one task builds.
REGION_BYTES = 8 << 20
#: Words whose exact counts and sums may be broadcast (20 bytes each); beyond
#: it they are joined.
BROADCAST_VOCAB = 4_000_000
#: Tokens counted in one buffer before they are sent.
BUFFER = 1_000_000
#: Tokens of a chunk of documents that is scored by a join, and n-grams that
#: a region looks up at once.
CHUNK = 250_000
#: Weight of the unigram estimate against a context's count; most bigrams of a
#: new text are unseen, so it is large.
KAPPA = 100.0
END = mix(np.array([0xE0D], U64))[0]
#: Bits of an n-gram's key: the region's number and 40 more.
LOW_BITS = U64(40)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, row): word hashes, each row followed by its end."""
    w = Words(data, off)
    rows = len(off) - 1
    tok = np.empty(len(w) + rows, U64)
    row = np.empty(len(tok), np.int64)
    tok[np.arange(len(w)) + w.doc] = w.hash
    row[np.arange(len(w)) + w.doc] = w.doc
    ends = w.first[1:] + np.arange(rows)
    tok[ends], row[ends] = END, np.arange(rows)
    return tok, row


def bigrams(tok: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a row's first follows an end."""
    return mix(np.append(END, tok[:-1])[: len(tok)] * POLY + tok)


def region_of(h: np.ndarray, regions: int) -> np.ndarray:
    return (h >> U64(64 - (regions.bit_length() - 1))).astype(np.int64) if regions > 1 else np.zeros(len(h), np.int64)


def levels(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1


def level_count(q: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level; 0 for level 0."""
    return np.where(q > 0, (2.0 ** np.maximum(q - 1, 0) + 2.0**q - 1) / 2, 0.0)


def positions(key: np.ndarray, level: int, bits: int | np.ndarray) -> Iterator[np.ndarray]:
    """Bit of each key inside its region of so many bits, for each hash function."""
    last = U64(bits - 1) if isinstance(bits, int) else (bits - 1).astype(U64)
    a = mix(key * POLY + U64(level))
    b = mix(a) | U64(1)
    for _ in range(HASHES):
        yield (a & last).astype(np.int64)
        a = a + b


def key_of(h: np.ndarray, regions: int) -> np.ndarray:
    """What the filter knows of an n-gram: its region and 40 bits."""
    return region_of(h, regions).astype(U64) << LOW_BITS | h & U64((1 << 40) - 1)


def bits_for(count: np.ndarray, each: int = BITS_PER_ENTRY) -> int:
    """Bits of a region for all entries of these counts, a power of two: at
    least ``each`` to an entry."""
    return max(64, 1 << (int(levels(count).sum()) * each - 1).bit_length())


def build_region(key: np.ndarray, count: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a region that holds all n-grams of these keys and counts."""
    q = levels(count)
    out = np.zeros(bits, bool)
    level = 1
    while len(key):
        for at in positions(key, level, bits):
            out[at] = True
        level += 1
        key, q = key[q >= level], q[q >= level]
    return np.packbits(out, bitorder="little")


class Filter:
    """Regions of ``sizes`` bits (0: no n-gram), one after the other."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes, self.base = bits, sizes, np.cumsum(sizes) - sizes

    def of(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram hash."""
        return self.levels(key_of(h, len(self.sizes)), region_of(h, len(self.sizes)))

    def levels(self, key: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Level of each key in its region, by repeated probes."""
        size, base = self.sizes[region], self.base[region]
        q = np.zeros(len(key), np.int64)
        live = np.flatnonzero(size)
        level = 1
        while len(live):
            sub = live
            keep = np.arange(len(live))
            for at in positions(key[live], level, size[live]):
                at = at[keep] + base[sub]
                hit = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                keep, sub = keep[hit], sub[hit]
                if not len(sub):
                    break
            q[sub] = level
            live = sub
            level += 1
        return q


@dataclass
class Model:
    filter: Broadcast | None  # bits and sizes of the regions; None if these or the words are too many
    regions: int
    tables: DataFrame | None  # if so, (region, bits, h, c, m): regions with counts and sums of their words
    n: int  # tokens in training
    v: int  # distinct ones
    mass: float  # M
    words: DataFrame  # (h, c, m) of all words


def count_rows(regions: int):
    """Maps texts to rows (region, kind, keys, more, counts, first): what a
    buffer of tokens holds of each region. kind 0: words (whole hashes); 1:
    bigrams (the low 40 bits, as 4 bytes and 1), with the hashes of their first
    words."""

    def send(buffer: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tok = np.concatenate(buffer)
        before = np.append(END, tok[:-1])
        out: dict[str, list] = {"region": [], "kind": [], "keys": [], "more": [], "counts": [], "first": []}
        for kind, h in enumerate((tok, bigrams(tok))):
            u, at, c = np.unique(h, return_index=True, return_counts=True)  # sorted, so regions are runs
            cut = np.searchsorted(region_of(u, regions), np.arange(regions + 1))
            low = (u & U64(0xFFFFFFFF)).astype(np.uint32)
            mid = (u >> U64(32) & U64(0xFF)).astype(np.uint8)
            first = before[at]
            for r in np.flatnonzero(np.diff(cut)):
                part = slice(cut[r], cut[r + 1])
                for k, v in (("region", int(r)), ("kind", kind), ("keys", (low if kind else u)[part].tobytes()), ("more", mid[part].tobytes() if kind else b""), ("counts", c[part].astype(np.uint32).tobytes()), ("first", first[part].tobytes() if kind else b"")):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("region", pa.int32()), ("kind", pa.int32()), *[(k, pa.binary()) for k in ("keys", "more", "counts", "first")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, size = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                tok, _ = tokens(*flat(b.column(b.schema.get_field_index("text"))))
                buffer.append(tok)  # ends with an end, so buffers join without a false bigram
                size += len(tok)
                if size >= BUFFER:
                    yield from send(buffer)
                    buffer, size = [], 0
                    give_back()
        if buffer:
            yield from send(buffer)
        give_back()

    return run


def train(docs: DataFrame, filter_bits: int = FILTER_BITS, regions: int | None = None, vocab_limit: int = BROADCAST_VOCAB, entry_bits: int = BITS_PER_ENTRY) -> Model:
    """Counts all words and bigrams of docs(text) and builds the filter. Every
    n-gram is in it, whatever its size; it is broadcast, with the words, if it
    has at most ``filter_bits`` and there are at most ``vocab_limit`` words.
    Null and empty texts are an end each; repeated rows count as often as they
    stand there; other columns are not looked at; no rows make an empty model."""
    spark = docs.sparkSession
    if regions is None:
        regions = pieces(input_bytes(docs), REGION_BYTES)
    scratch = Scratch(spark, "lm")

    def merge(table: pa.Table) -> pa.Table:
        give_back()  # what the region before took
        region = table.column("region")[0].as_py()
        keys, counts = [], []
        out = {k: np.zeros(0, t) for k, t in (("h", U64), ("c", np.int64), ("u", U64), ("m", np.float64))}
        for kind in (0, 1):
            rows = table.filter(pa.array(table.column("kind").to_numpy() == kind))
            read = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)  # noqa: B023, E731
            h, c = read("keys", np.uint32 if kind else U64).astype(U64), read("counts", np.uint32)
            if not len(h):
                continue
            if kind:
                h = h | read("more", np.uint8).astype(U64) << U64(32)
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order].astype(np.int64)
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, c = h[start], np.add.reduceat(c, start)
            if kind:
                first = read("first", U64)[order][start]
                out["u"], inv = np.unique(first, return_inverse=True)
                out["m"] = np.bincount(inv, weights=level_count(levels(c)))
            else:
                out["h"], out["c"] = h, c
            keys.append(U64(region) << LOW_BITS | h & U64((1 << 40) - 1))
            counts.append(c)
        count = np.concatenate(counts)
        data, mass = build_region(np.concatenate(keys), count, bits_for(count, entry_bits)), level_count(levels(out["c"])).sum()
        lists = {k: pa.array([v.astype(np.int64) if v.dtype == U64 else v], pa.list_(pa.float64() if k == "m" else pa.int64())) for k, v in out.items()}
        return pa.table({"region": pa.array([region], pa.int32()), "mass": pa.array([mass], pa.float64()), "bits": pa.array([data.tobytes()], pa.binary()), **lists})

    sent = docs.select("text").mapInArrow(count_rows(regions), "region int, kind int, keys binary, more binary, counts binary, first binary")
    merged = scratch.save(sent.groupBy("region").applyInArrow(merge, "region int, mass double, bits binary, h array<bigint>, c array<bigint>, u array<bigint>, m array<double>"))
    free_shuffles(spark)
    # a word's followers are spread over the regions; every word has some, an
    # end at least
    sums = merged.select(F.explode(F.arrays_zip("u", "m")).alias("x")).groupBy(F.col("x.u").alias("h")).agg(F.sum("x.m").alias("m"))
    words = merged.select("region", F.explode(F.arrays_zip("h", "c")).alias("x")).select("region", "x.h", "x.c")
    words = scratch.save(words.join(sums, "h").select("region", "h", "c", "m"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size, mass = merged.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
    shared = tables = None
    if 8 * size <= filter_bits and v <= vocab_limit:
        sizes, parts = np.zeros(regions, np.int64), {}
        for r in merged.select("region", "bits").toLocalIterator():
            sizes[r.region], parts[r.region] = 8 * len(r.bits), r.bits
        shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.uint8), sizes))
        del parts
        scratch.drop(merged)
    else:
        # lists of a region's words, by hash
        lists = words.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("h", "c", "m"))).alias("s"))
        tables = merged.select("region", "bits").join(lists, "region", "left").select("region", "bits", *[F.col(f"s.{k}").alias(k) for k in ("h", "c", "m")])
    free_shuffles(spark)
    return Model(shared, regions, tables, n, v, mass + v + 1, words.select("h", "c", "m"))


def log_probs(two: np.ndarray, one: np.ndarray, after: np.ndarray, kappa: float, mass: float) -> np.ndarray:
    """log10 of each token's probability: from the levels of the pair and of
    the token, and the sum M(u) after the token before."""
    return np.log10((level_count(two) + kappa * (level_count(one) + 1) / mass) / (after + kappa))


ADDED = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, kappa: float = KAPPA) -> DataFrame:
    """docs (its other columns, without text) with n_tokens, n_known,
    base_score and score. A null text is empty and has the end alone. Repeated
    rows are scored alike. Columns of docs that have an added name are replaced."""
    docs = docs.drop(*ADDED)
    if model.filter is None:
        return score_by_regions(docs, model, kappa)
    total, mass, filter_ = model.n + model.v + 1.0, model.mass, model.filter
    kept = [c for c in docs.columns if c != "text"]
    # sorted and narrowed there, so that the driver holds one small copy
    count = "int" if model.n < 1 << 31 else "bigint"
    got = model.words.select("h", F.col("c").cast(count), F.col("m").cast("float")).orderBy("h").toArrow()
    columns = []
    while got.num_columns:
        columns.append(got.column(0).to_numpy())
        got = got.remove_column(0)
    shared = docs.sparkSession.sparkContext.broadcast(columns)
    del columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, sums = shared.value
        lm = Filter(*filter_.value)

        def exact(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(count, sum of what follows) of words."""
            signed = h.astype(np.int64)
            at = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
            known = words[at] == signed if len(words) else np.zeros(len(h), bool)
            return (np.where(known, x[at].astype(np.float64), 0.0) if len(words) else np.zeros(len(h)) for x in (counts, sums))

        for whole in batches:
            for b in slices(whole, "text"):
                tok, row = tokens(*flat(b.column(b.schema.get_field_index("text"))))
                sum_of = lambda w: np.bincount(row, weights=w, minlength=b.num_rows)  # noqa: B023, E731
                u, inv = np.unique(tok, return_inverse=True)
                pair, pair_inv = np.unique(bigrams(tok), return_inverse=True)
                one, two = lm.of(u)[inv], lm.of(pair)[pair_inv]
                c, m = (x[inv] for x in exact(u))
                after = np.append([*exact(np.array([END]))][1], m[:-1])  # a row's first token follows an end
                n_tokens = np.bincount(row, minlength=b.num_rows).astype(np.int64)
                added = [pa.array(n_tokens), pa.array(sum_of(c > 0).astype(np.int64)), pa.array(sum_of(np.log10((c + 1) / total))), pa.array(sum_of(log_probs(two, one, after, kappa, mass)))]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in kept], *added], [*kept, *ADDED])

    return docs.mapInArrow(run, schema_of(docs))


def schema_of(docs: DataFrame) -> str:
    return "".join(f"`{k}` {t}, " for k, t in docs.drop("text").dtypes) + "n_tokens bigint, n_known bigint, base_score double, score double"


def chunk_rows():
    """Maps texts to rows (chunk, rows): about CHUNK tokens of documents, as an
    Arrow stream, under a random number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, parts[0].schema) as w:
                for b in parts:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        parts, size = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                parts.append(b)
                size += len(Words(*flat(b.column(b.schema.get_field_index("text"))))) + b.num_rows
                if size >= CHUNK:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)

    return run


def chunk_tokens(rows: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(documents, tokens, row of each token) of a chunk."""
    table = pa.ipc.open_stream(rows).read_all()
    toks, row, done = [], [], 0
    for b in table.to_batches():
        t, r = tokens(*flat(b.column(b.schema.get_field_index("text"))))
        toks.append(t)
        row.append(r + done)
        done += b.num_rows
    return table, np.concatenate(toks), np.concatenate(row)


def ask_rows(regions: int):
    """Maps chunks to rows (chunk, region, kind, keys): the distinct words (0)
    and bigrams (1) of a chunk that belong to a region, by rising hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, tok, _ = chunk_tokens(rows.as_py())
                out: dict[str, list] = {"chunk": [], "region": [], "kind": [], "keys": [], "more": []}
                for kind, h in enumerate((tok, bigrams(tok))):
                    u = np.unique(h)
                    cut = np.searchsorted(region_of(u, regions), np.arange(regions + 1))
                    low, mid = (u & U64(0xFFFFFFFF)).astype(np.uint32), (u >> U64(32) & U64(0xFF)).astype(np.uint8)
                    for r in np.flatnonzero(np.diff(cut)):
                        at = slice(cut[r], cut[r + 1])
                        for k, v in (("chunk", chunk), ("region", int(r)), ("kind", kind), ("keys", (low if kind else u)[at].tobytes()), ("more", mid[at].tobytes() if kind else b"")):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("region", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())]))
                give_back()

    return run


def blocks(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of rows of about ``limit`` keys in all (a larger row stands alone)."""
    total, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, "right")))
        yield slice(start, end)
        start = end


def score_by_regions(docs: DataFrame, model: Model, kappa: float) -> DataFrame:
    """score() where the filter or the words are too many to broadcast. Chunks
    of documents send their distinct n-grams to the regions and get back the
    levels, and of words the exact counts and sums, in the order they were
    sent. Nothing of the size of the corpus passes through the driver."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    regions, total, mass = model.regions, model.n + model.v + 1.0, model.mass
    kept = [c for c in docs.columns if c != "text"]
    exact = {"c": np.int64, "m": np.float64}

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        give_back()
        out: dict[str, list] = {k: [] for k in ("chunk", "region", "kind", "level", *exact)}
        bits = np.frombuffer(own.column("bits")[0].as_py() if own.num_rows else b"", np.uint8)  # a region of no training n-gram has no row
        lm = Filter(bits, np.array([8 * len(bits)]))
        listed = own.num_rows > 0 and own.column("h")[0].as_py() is not None
        words = own.column("h")[0].values.to_numpy() if listed else np.zeros(0, np.int64)
        for kind in (0, 1):
            rows = asked.filter(pa.array(asked.column("kind").to_numpy() == kind))
            width = 4 if kind else 8
            size = np.array([len(x.as_py()) // width for x in rows.column("keys")], np.int64)
            for part in blocks(size, CHUNK):  # many chunks' keys at once
                some = rows.slice(part.start, part.stop - part.start)
                read = lambda c, t: np.frombuffer(b"".join(some.column(c).to_pylist()), t)  # noqa: B023, E731
                h = read("keys", np.uint32 if kind else U64).astype(U64)
                if kind:
                    h |= read("more", np.uint8).astype(U64) << U64(32)
                region = some.column("region")[0].as_py()
                got = {"level": lm.levels(U64(region) << LOW_BITS | h & U64((1 << 40) - 1), np.zeros(len(h), np.int64)).astype(np.uint8)}
                if not kind:
                    signed = h.astype(np.int64)
                    at = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
                    known = words[at] == signed if len(words) else None
                    got |= {k: np.where(known, own.column(k)[0].values.to_numpy()[at], 0).astype(t) if len(words) else np.zeros(len(h), t) for k, t in exact.items()}
                cut = np.append(0, np.cumsum(size[part]))
                for k in exact.keys() | {"level"}:
                    out[k] += [got[k][i:j].tobytes() if k in got else b"" for i, j in zip(cut, cut[1:], strict=False)]
                for k in ("chunk", "region", "kind"):
                    out[k] += some.column(k).to_pylist()
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("region", pa.int32()), ("kind", pa.int32()), *[(k, pa.binary()) for k in ("level", "c", "m")]]))

    def result(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        table, tok, row = chunk_tokens(chunk.column("rows")[0].as_py())
        answers = answers.sort_by([("kind", "ascending"), ("region", "ascending")])  # the order of the hashes
        of = answers.column("kind").to_numpy()
        read = lambda k, c, t: np.frombuffer(b"".join(answers.column(c).filter(pa.array(of == k)).to_pylist()), t)
        u, inv = np.unique(tok, return_inverse=True)
        two = read(1, "level", np.uint8)[np.unique(bigrams(tok), return_inverse=True)[1]].astype(np.int64)
        one = read(0, "level", np.uint8)[inv].astype(np.int64)
        c, m = read(0, "c", np.int64).astype(np.float64)[inv], read(0, "m", np.float64)
        after = np.append(m[np.searchsorted(u, END)], m[inv][:-1])
        sums = lambda w: np.bincount(row, weights=w, minlength=table.num_rows)
        n_tokens = np.bincount(row, minlength=table.num_rows).astype(np.int64)
        more = [pa.array(n_tokens), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(np.log10((c + 1) / total))), pa.array(sums(log_probs(two, one, after, kappa, mass)))]
        return pa.Table.from_arrays([*[table.column(k) for k in kept], *more], names=[*kept, *ADDED])

    bound_bytes(spark)
    chunks = scratch.save(docs.mapInArrow(chunk_rows(), "chunk bigint, rows binary"))
    asked = chunks.mapInArrow(ask_rows(regions), "chunk bigint, region int, kind int, keys binary, more binary")
    answers = asked.groupBy("region").cogroup(model.tables.groupBy("region")).applyInArrow(answer, "chunk bigint, region int, kind int, level binary, c binary, m binary")
    answers = scratch.save(answers)
    free_shuffles(spark)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(result, schema_of(docs))
