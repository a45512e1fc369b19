"""Vectorised words and hashes over the bytes of an Arrow text column.

Everything here works on one flat byte array that holds many documents, so a
batch costs a few numpy passes instead of a Python loop over words. A word
never crosses a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the temporary arrays of a worker.
SLICE_BYTES = 2_000_000
POLY = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random 64-bit value per byte value, from the finaliser.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * POLY)
#: Words are runs of any bytes but space and tab, LF, VT, FF, CR.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8).copy()
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text at most (one
    longer document stands alone)."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of many documents: ``start`` and ``end`` (byte positions), ``doc``
    (row of each word), ``hash`` (64 bits a word, lower-cased A-Z), ``first``
    (word index at which each row begins, with the total at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        n = len(data)
        inside = ~space[data]
        edge = np.zeros(n + 1, bool)
        if n:
            edge[1:n] = inside[1:] != inside[:-1]
            edge[0], edge[n] = inside[0], inside[-1]
        # a border between two rows ends a word and starts one
        cut = off[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        joined = cut[inside[cut] & inside[cut - 1]] if n else cut
        pos = np.flatnonzero(edge)
        if len(joined):
            pos = np.sort(np.concatenate([pos, joined, joined]))
        self.start, self.end = pos[0::2], pos[1::2]
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off)
        low = LOWER[data] if lower else data
        self.hash = ranges_hash(low, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, POLY, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, powers) for ranges_hash: sums[i] is the polynomial of the first i bytes."""
    p = powers(len(data))
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * p[:-1], out=s[1:])
    return s, p


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges anywhere hash alike."""
    s, p = sums if sums is not None else prefix_sums(data)
    top = len(p) - 1
    h = (s[end] - s[start]) * p[top - start]  # every range as if it ended at the same power
    return mix(h * inverse_power(top) + (end - start).astype(U64))


def inverse_power(n: int) -> np.uint64:
    """POLY to the power -n modulo 2**64 (POLY is odd), so that hashes don't
    depend on the array's length."""
    return U64(pow(pow(int(POLY), -1, 1 << 64), n, 1 << 64))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words of a row; a row of fewer words, but
    not none, gives its whole sequence as one."""
    count = np.diff(w.first)
    rows, hashes = [], []
    if len(w) >= n:
        at = np.flatnonzero(w.doc[: len(w) - n + 1] == w.doc[n - 1 :])
        h = np.zeros(len(at), U64)
        for k in range(n):
            h = mix(h * POLY + w.hash[at + k])
        rows.append(w.doc[at])
        hashes.append(h)
    for r in np.flatnonzero((count > 0) & (count < n)):
        h = np.zeros(1, U64)
        for x in w.hash[w.first[r] : w.first[r + 1]]:
            h = mix(h * POLY + x)
        rows.append(np.array([r]))
        hashes.append(mix(h + U64(count[r])))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows), np.concatenate(hashes)
