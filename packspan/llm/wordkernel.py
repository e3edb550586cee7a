"""Vectorised words and word shingles of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z were lower-cased. Words become 64-bit
polynomial hashes through one running sum over the text buffer, so that no Python object is made for a word. Two sets
are equal, and overlap as much as their strings do, but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches, after which the worker gives the memory it used back; workers live on between stages."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return apply


#: Texts are taken in runs of about so many bytes, which bounds the memory of a task whatever the batch; one longer
#: text is a run of its own.
RUN_BYTES = 1 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_MULT), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, RUN_BYTES + (RUN_BYTES >> 2))
        for name, base in (("p", _MULT), ("i", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    p, i = _powers["p"], _powers["i"]
    if len(p) > 16 * RUN_BYTES:  # made for one giant text: not kept
        _powers.clear()
    return p, i


@dataclass
class Run:
    """Rows lo..hi of a batch; bytes of row k are data[offsets[k - lo]:offsets[k - lo + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """starts, ends and hashes of all words of a run; words of row k are first[k]..first[k + 1]."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def runs(column: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The column's bytes without a copy, in runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    _, off, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + run_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Run(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def words(run: Run, lower: bool = True, space_table: np.ndarray = SPACE) -> Words:
    """The words of a run; ``space_table`` says which bytes part words.

    A run of more than ``RUN_BYTES`` (one long text) is gone through in slices that end between words.
    """
    n = len(run.data)
    low = LOWER[run.data] if lower else run.data
    if n <= 2 * RUN_BYTES:
        starts, ends, hashes = _words(low, run.offsets, space_table)
    else:
        parts, lo = [], 0
        while lo < n:
            hi = min(lo + RUN_BYTES, n)
            while hi < n and not space_table[low[hi : hi + 4096]].any():
                hi = min(hi + 4096, n)
            hi = hi if hi == n else hi + int(space_table[low[hi : hi + 4096]].argmax())
            inner = run.offsets[(run.offsets >= lo) & (run.offsets <= hi)] - lo
            s, e, h = _words(low[lo:hi], np.unique(np.concatenate([[0], inner, [hi - lo]])), space_table)
            parts.append((s + lo, e + lo, h))
            lo = hi
        starts, ends, hashes = (np.concatenate([x[i] for x in parts]) for i in range(3))
    return Words(low, starts, ends, hashes, np.searchsorted(starts, run.offsets))


def _words(low: np.ndarray, offsets: np.ndarray, space_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(low)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    space = space_table[low]
    inner = offsets[:-1]
    inner = inner[inner < n]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    last = inner[inner > 0] - 1
    after[last] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, segment_hashes(low, starts, ends)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the segments data[starts[k]:ends[k]]."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in order, and where each row's begin. A row of 1..k-1 words has one: its whole sequence."""
    count = np.diff(w.first)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    if total == 0:
        return np.zeros(0, np.uint64), first
    at = np.arange(total) - np.repeat(first[:-1], per) + np.repeat(w.first[:-1], per)
    have = np.repeat(np.minimum(count, k), per)
    h = np.zeros(total, np.uint64)
    for j in range(k):
        step = w.hashes[np.minimum(at + j, len(w.hashes) - 1)]
        h = np.where(j < have, mix(h * _MULT + step + _U(j + 1)), h)
    return h, first


def distinct_by_row(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, and where each row's begin."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(first)))


_SPREAD = _U(0x9E3779B97F4A7C15)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """Keys (distinct, not negative) to values (not negative) by open addressing, asked for many at once; -1 is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(mask + 1, -1, np.int64), np.full(mask + 1, -1, np.int32)
        slot, todo = slots(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask, slot = (1 << self.bits) - 1, slots(keys, self.bits)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & mask
            there = self.keys[slot[more]]
            same = there == keys[more]
            out[more[same]] = self.values[slot[more[same]]]
            more = more[~same & (there >= 0)]
        return out
