"""Arithmetic over whole batches of texts in numpy: byte buffers, words, hashes of spans, a hash index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier.
_P = 0x9E3779B97F4A7C15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most `most` bytes of text each, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def span_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums from which span_hashes() reads the hashes of spans that begin at `starts` and hold no other start.

    Each value is mixed with its place in its span before it is summed, so no structure of a text, however regular, makes
    sums of different spans agree; two spans share a hash only by the chance of 64-bit numbers.
    """
    # A value's place: its own index less that of the last start before it, times an odd number; then two rounds of mixing.
    x = np.zeros(len(values), np.uint64)
    x[starts] = starts
    np.maximum.accumulate(x, out=x)
    np.subtract(np.arange(len(values), dtype=np.uint64), x, out=x)
    x *= np.uint64(_P)
    x += values.astype(np.uint64)
    x += np.uint64(1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(29)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' contents, independent of where they stand."""
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't breaks, none across rows; and the index of each row's first word."""
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums_by_row(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Sums over values[pointers[i] : pointers[i + 1]]."""
    out = np.zeros(len(pointers) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(pointers[1:] > pointers[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, pointers[full], dtype=out.dtype)
    return out


class HashIndex:
    """Finds the places of 64-bit keys, many at a time: open addressing, linear probing, at most two thirds full."""

    def __init__(self, keys: np.ndarray, room: int = 0):
        """keys: distinct; room: how many keys there shall be space for, if more."""
        bits = max(4, int(1.5 * max(len(keys), room)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)
        self.last = np.int64((1 << bits) - 1)
        self.n = 0
        self._put(keys, np.arange(len(keys), dtype=np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_P)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        self.n += len(keys)
        slot = self._home(keys)
        while len(keys):
            free = self.places[slot] < 0
            at = slot[free]
            self.places[at] = places[free]
            self.slots[at] = keys[free]
            lost = ~(free & (self.places[slot] == places))
            keys, places, slot = keys[lost], places[lost], (slot[lost] + 1) & self.last

    def add(self, keys: np.ndarray) -> bool:
        """Add distinct new keys, whose places follow the others'; False if there is no room."""
        if 3 * (self.n + len(keys)) > len(self.slots) * 2:
            return False
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        return True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._home(keys)
        out = self.places[slot]
        wrong = np.flatnonzero((self.slots[slot] != keys) & (out >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.last
            got = self.places[slot]
            out[wrong] = got
            more = (self.slots[slot] != keys[wrong]) & (got >= 0)
            wrong, slot = wrong[more], slot[more]
        return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often they occur (or the sums of counts)."""
    if counts is None:
        keys = np.sort(keys)
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[firsts], np.diff(np.append(firsts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(counts, firsts) if len(keys) else counts
