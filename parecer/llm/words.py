"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word hash is a sum of byte values times powers of an odd number modulo 2**64, taken from
running sums, so a whole block of texts costs a few passes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once, unless a single text is longer.
BLOCK_BYTES = 1 << 19

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_random = np.random.default_rng(7)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words that end at white space.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of lower-case letters, digits and everything beyond ASCII.
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[48:58] = PLAIN_WORDS[97:123] = PLAIN_WORDS[128:] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        for i, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw, at


def blocks(at: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``size`` bytes together, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of consecutive texts: byte ranges, hashes, and the word range of each text."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, is_word: np.ndarray, lower: bool):
        data = raw[at[0]:at[-1]]
        self.data = _LOWER[data] if lower else data
        self.at = at - at[0]
        n = len(self.data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = is_word[self.data]
        first = inside[:n].copy()
        first[1:] &= ~inside[:n - 1]
        last = inside[:n] & ~inside[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.of_text = np.searchsorted(self.starts, self.at)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words, by where they start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n] * _STEPS[0]
    for k in range(1, size):
        total += words[k:n + k] * _STEPS[k]
    return mix(total)


def batches_of(table_batch: pa.RecordBatch, column: str = "text"):
    """The bytes and text limits of a batch's text column."""
    return text_bytes(table_batch.column(table_batch.schema.get_field_index(column)))
