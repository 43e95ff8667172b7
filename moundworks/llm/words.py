"""Words of many texts at once, in numpy, with 64-bit keys of words and word windows.

A ``Split`` holds the words of one slice of a batch as byte ranges. Keys are
polynomial sums over random values, modulo 2^64; ``mixed`` spreads them over all bits.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE, _WINDOW_BASES = np.uint64(0x9E3779B97F4A7C15 | 1), (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))

#: Bytes of text whose word keys are computed in one go.
_STEP = 1 << 20


def separators(pattern_bytes: bytes) -> np.ndarray:
    """Table of the bytes that part words."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Words are runs of anything but these bytes: white space, or all ASCII but digits and small letters.
SPACE = separators(b" \t\n\x0b\x0c\r")
NOT_ALNUM = separators(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), from a table that grows with the largest ``n`` asked for."""
    table = _TABLES.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        _TABLES[int(base)] = table = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """sum of values[i] * base^i up to each place, modulo 2^64."""
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return total


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """sum of values[start + i] * base^i over each range, from the prefix sums."""
    return (total[end] - total[start]) * _powers(_inverse(base), len(total))[start]


@dataclass
class Split:
    """Words of the rows of a slice: byte ranges in ``data``; row r has words first[r] to first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def keys(self) -> np.ndarray:
        """64-bit key of each word."""
        return self.keys_of([self.end])[0]

    def prefix_keys(self, length: int) -> np.ndarray:
        """Key of the first ``length`` bytes of each word; of the whole word if it is shorter."""
        return self.keys_of([np.minimum(self.end, self.start + length)])[0]

    def keys_of(self, ends: list[np.ndarray]) -> list[np.ndarray]:
        """Keys of the ranges from each word's start to each array of ends."""
        out = [np.empty(len(self.start), dtype=np.uint64) for _ in ends]
        at = 0
        while at < len(self.start):
            low = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, low + _STEP, side="right")))
            part = _BYTE_VALUES[self.data[low:self.end[stop - 1]]]
            total = prefix_sums(part, _BASE)
            for keys, end in zip(out, ends):
                keys[at:stop] = between(total, self.start[at:stop] - low, end[at:stop] - low, _BASE)
            at = stop
        return [mixed(keys + (end - self.start).astype(np.uint64)) for keys, end in zip(out, ends)]


def key_of(word: bytes) -> np.uint64:
    """The key that ``Split.keys`` gives this word."""
    data = np.frombuffer(word, dtype=np.uint8)
    return Split(data, np.array([0]), np.array([len(data)]), np.array([0, 1])).keys()[0]


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def split(column: pa.Array, parts: np.ndarray = SPACE, lower: bool = False) -> Split:
    """Words of each row of a string column; a null row has none."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    ends = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~parts[data]
    starts = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cut = ends[1:-1]  # a word never spans two rows
    here = cut[(cut > 0) & (cut < len(data))]
    starts[here] = inside[here + 1]
    stops[here - 1] = inside[here]
    start, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return Split(data, start, end, np.searchsorted(start, ends))


def window_keys(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Key of the window of ``width`` words that starts at each word; the last width - 1 starts are missing."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    base = _WINDOW_BASES[second]
    return mixed(between(prefix_sums(words, base), at, at + width, base))


def window_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Word positions at which a whole window of its own row starts."""
    lengths = np.maximum(np.diff(first) - width + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(lengths.sum()) + skip
