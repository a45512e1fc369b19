"""N-gram counts of Arrow batches of normalized text.

Array lambdas and regex scans make a row of every occurrence. Here a batch's
words become numbers once, n-grams are numbers made of them, and only distinct
n-grams with their counts leave a task's buffer, so that the shuffle and the
aggregation behind it carry those alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text counted in one buffer; bounds a task's memory.
BUFFER = 8_000_000
#: Letters of the alphabet.
ALPHABET = 26
SPACE = 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def spans(total: np.ndarray, n: int) -> np.ndarray:
    """Places at which n tokens in a row belong to one text, ``total`` being
    the number of tokens before each text, with all of them at the end."""
    text = np.repeat(np.arange(len(total) - 1), np.diff(total))
    return np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)


class Words:
    """Words of texts, as numbers into ``names``. Texts hold a-z and spaces."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        letter = data != SPACE
        before = np.append(False, letter[:-1])[: len(data)]
        before[off[:-1][off[:-1] < len(data)]] = False  # a word ends with its text
        start = np.flatnonzero(letter & ~before)
        end = np.append(0, np.cumsum(letter))  # letters before each byte
        size = np.append(end[start], end[-1]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(data[letter]))
        coded = words.dictionary_encode()
        self.ids, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.total = np.searchsorted(start, off)

    def grams(self, n: int) -> tuple[pa.Array, np.ndarray]:
        """(distinct n-grams, counts)."""
        at = spans(self.total, n)
        code, parts = self.ids[at], [np.arange(len(self.names))]
        for k in range(1, n):
            pairs = pa.array(code * len(self.names) + self.ids[at + k]).dictionary_encode()
            code, seen = pairs.indices.to_numpy().astype(np.int64), pairs.dictionary.to_numpy()
            head, tail = np.divmod(seen, max(len(self.names), 1))
            parts = [*[p[head] for p in parts], tail]
        count = np.bincount(code, minlength=len(parts[0]))
        text = pc.binary_join_element_wise(*[self.names.take(pa.array(p)) for p in parts], pa.scalar(" ", pa.large_string())) if n > 1 else self.names
        return text, count


def letter_grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of letters as numbers to the base of the alphabet,
    counts); words don't bound them."""
    letter = data != SPACE
    at = spans(np.append(0, np.cumsum(letter))[off], n)
    codes = data[letter].astype(np.int64) - ord("a")
    total = np.zeros(len(at), np.int64)
    for k in range(n):
        total = total * ALPHABET + codes[at + k]
    if n <= 4:
        count = np.bincount(total, minlength=ALPHABET**n)
        return np.flatnonzero(count), count[count > 0]
    got = pa.array(total).value_counts()
    return got.field("values").to_numpy(), got.field("counts").to_numpy()


def spelled(codes: np.ndarray, n: int) -> pa.Array:
    """The n-grams of these numbers, spaced."""
    out = np.full((len(codes), 2 * n - 1), SPACE, np.uint8)
    for k in range(n):
        out[:, 2 * (n - 1 - k)] = codes // ALPHABET**k % ALPHABET + ord("a")
    return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int64) * (2 * n - 1)), pa.py_buffer(out))


def pieces(b: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The batch in runs of rows of at most ``limit`` bytes of text (a longer
    text stands alone), each with its bytes."""
    size = np.cumsum(pc.binary_length(b.column("norm")).fill_null(0).to_numpy())
    start = 0
    while start < b.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
        yield b.slice(start, end - start), int(size[end - 1] - done)
        start = end


def counter(kinds: Sequence[tuple[str, str, int]]):
    """For mapInArrow: maps (norm) to (kind, ngram, frequency), the counts of
    each buffer for kinds of (name, word or char, n)."""
    limit = BUFFER

    def flush(buffer: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, off = flat(pa.Table.from_batches(buffer).column("norm").combine_chunks())
        words = Words(data, off) if any(t == "word" for _, t, _ in kinds) else None
        for name, token, n in kinds:
            if token == "word":
                text, count = words.grams(n)
            else:
                codes, count = letter_grams(data, off, n)
                text = spelled(codes, n)
            for lo in range(0, len(text), 100_000):
                part = text.slice(lo, 100_000).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), part, pa.array(count[lo : lo + 100_000].astype(np.int64))], ["kind", "ngram", "frequency"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, size = [], 0
        for whole in batches:
            for b, n in pieces(whole, limit):
                buffer.append(b)
                size += n
                if size >= limit:
                    yield from flush(buffer)
                    buffer, size = [], 0
        if buffer:
            yield from flush(buffer)

    return run
