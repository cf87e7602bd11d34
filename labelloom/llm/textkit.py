"""Vectorised tokenising and hashing of Arrow string columns.

All helpers work on whole texts. A batch is cut into slices of whole documents, so that the working
arrays stay small; a document longer than the slice is a slice of its own. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Odd multiplier of the polynomial hash of windows.
WORD_BASE = 0xD6E8FEB86659FD93
#: What tells the two lanes of word hashes apart.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACES = 48


def byte_table(*members: tuple[int, int]) -> np.ndarray:
    """256 booleans, true in the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in members:
        table[low : high + 1] = True
    return table


#: Bytes of a word: anything but a space and 0x09 to 0x0D.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits, and everything beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive slices of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, whole[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the runs of bytes in ``inside``."""
    member = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:-1]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


WORD_POWERS = Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _placed(place: np.ndarray, byte: np.ndarray, lane: int) -> np.ndarray:
    """A 64-bit number for a byte at a place of its word; lanes are independent of each other."""
    return mix(mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(1)) + np.uint64(LANES[lane]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each word: the sum over its bytes of numbers drawn for (place in the word, byte).

    The places don't follow a formula that texts could cancel out, unlike powers modulo 2**64. Two lanes together
    are a hash of 128 bits.
    """
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    byte = data[place + np.repeat(starts, sizes)]
    near = place < PLACES
    if near.all():
        values = PLACE_TABLES[lane][place, byte]
    else:
        values = np.empty(len(place), np.uint64)
        values[near] = PLACE_TABLES[lane][place[near], byte[near]]
        values[~near] = _placed(place[~near], byte[~near], lane)
    return mix(np.add.reduceat(values, first) + mix(sizes.astype(np.uint64)))


#: Numbers of the first places of a word; later ones are computed.
PLACE_TABLES = [_placed(np.arange(PLACES)[:, None], np.arange(256, dtype=np.uint64)[None, :], lane) for lane in range(2)]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` consecutive words (ends of documents are not looked at)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = WORD_POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:count])


def counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, counts) of a sorted array."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[first], np.diff(np.concatenate((first, [len(sorted_keys)])))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their values)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; empty segments give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def range_count(partitions: int) -> int:
    """A power of two, at least the number of shuffle partitions: the ranges that 64-bit keys are dealt to."""
    return 1 << max(3, (max(1, partitions) - 1).bit_length())


def range_cuts(sorted_keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of sorted 64-bit keys begins, and the total."""
    width = 64 - (ranges.bit_length() - 1)
    edges = np.arange(ranges, dtype=np.uint64) << np.uint64(width)
    return np.append(np.searchsorted(sorted_keys, edges), len(sorted_keys))


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def gathered(column: pa.Array, dtype) -> list[np.ndarray]:
    """The packed arrays of a binary column."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]
