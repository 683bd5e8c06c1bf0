"""Words and prefix hashes of whole blocks of texts, as numpy arrays.

A block is a slice of an Arrow column: its texts lie one after another as UTF-8 bytes. The
separators of words are ASCII bytes, which never occur inside a longer UTF-8 character, so
splitting bytes splits characters as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that are worked on at once, longer only where one text alone is longer.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices ``[first, last)`` of a column with about ``block_bytes`` of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    totals = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < len(sizes):
        before = totals[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(totals, before + block_bytes, "right")))
        yield first, last
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(
    data: np.ndarray, starts: np.ndarray, cuts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text number of every word; words also end before each byte of ``cuts``."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    if cuts is not None:
        edge[cuts] = True
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(starts, begins, "right") - 1


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(size, _BASE), np.full(size, _INVERSE)
    power[:1] = inverse[:1] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse)


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of any substring of a block, from its prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        size = 1 << max(20, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.inverse[begins])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes (a bijection on 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` neighbours; the caller drops runs across texts."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(3) + hashes[k : k + size])
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0, np.int64)]
        for first, last in blocks(texts):
            data, starts = flat(texts.slice(first, last - first))
            space = _SPACE[data]
            begins = ~space
            begins[1:] &= space[:-1]
            # the first character of a text begins a word whatever the text before ends with
            firsts = starts[:-1][starts[:-1] < starts[1:]]
            begins[firsts] = ~space[firsts]
            totals = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
            parts.append(totals[starts[1:]] - totals[starts[:-1]])
        return pa.array(np.concatenate(parts))

    return count(text)


def count_per_text(numbers: np.ndarray, n_texts: int) -> np.ndarray:
    return np.bincount(numbers, minlength=n_texts).astype(np.int64)
