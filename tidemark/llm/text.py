"""Words and hashes of Arrow string columns, computed on whole arrays.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Hashes are 64 bits wide and
depend on nothing but the bytes, so every task and every run names a word alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text that one round of array work handles; a longer text makes a round of its own.
ROUND_BYTES = 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class Texts:
    """Consecutive texts as one byte array; ``offsets`` has one entry more than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def as_texts(column: pa.Array) -> Texts:
    """Nulls become empty texts."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[at[0] : at[-1]], at - at[0])


def rounds(batch: pa.RecordBatch, column: str, most: int = ROUND_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batch with at most ``most`` bytes of text, or one row."""
    index = batch.schema.get_field_index(column)
    sizes = as_texts(batch.column(index)).offsets
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = batch.slice(start, stop - start)
        yield part, as_texts(part.column(index))
        start = stop


class Words:
    """Words of texts: byte ranges, hash, and the index of the first word of each text."""

    def __init__(self, texts: Texts, lower: bool = False):
        data = LOWER[texts.data] if lower else texts.data
        offsets = texts.offsets
        solid = ~SPACE[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        if len(solid):
            before[1:], after[:-1] = solid[:-1], solid[1:]
            inner = offsets[(offsets > 0) & (offsets < len(solid))]
            before[inner], after[inner - 1] = False, False
        self.data = data
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        #: first[i]: index of the first word of text i; the last entry is the number of words.
        self.first = np.searchsorted(self.starts, offsets)
        self._solid = solid

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        heads = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=heads[1:])
        solid = self.data[self._solid]
        place = np.arange(len(solid)) - np.repeat(heads, lengths)
        summed = np.add.reduceat(_BYTE[solid] * powers(_STEP, int(lengths.max()))[place], heads)
        return mix(summed + lengths.astype(np.uint64) * _GRAM)


def grams(hashes: np.ndarray, n: int, base: np.uint64 = _GRAM) -> np.ndarray:
    """Hash of each run of n consecutive words; run i starts at word i and may cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i, power in enumerate(powers(base, n)):
        total += hashes[i : len(hashes) - n + 1 + i] * power
    return mix(total)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Of the runs that ``grams`` hashes, those that lie in one text: a mask."""
    words = int(first[-1])
    if words < n:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(words - n + 1) + n <= ends[: words - n + 1]


def least(value: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each ``span`` consecutive values, the first of equals."""
    place, width = np.arange(len(value)), 1
    while width < span:
        step = min(width, span - width)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(value[right] < value[left], right, left)
        width += step
    return place

