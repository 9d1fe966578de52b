"""Words of many texts at once: places, 64-bit hashes and hashes of word runs, all in numpy.

A word is a run of bytes other than space and tab to carriage return, so words of one text never join those of the
next. A word's hash takes its bytes by eights: every group is mixed, multiplied by a number of its own place and only
then added, so no pattern of repeated letters cancels out, whatever the seed. Hashes of runs are put together by halves
in the same way. Two hashes with unlike seeds serve where equality is decided by hash alone. Temporary arrays are bounded
by CHUNK bytes of text (or one longer word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 17
SLICE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = (20260101, 77003311, 5151771)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=16)
def _factors(seed: int, size: int) -> np.ndarray:
    """An odd number of its own for each place."""
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(_SEEDS[seed])) | np.uint64(1)


#: Masks of the first 0 to 8 bytes of a group.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def fresh_name(name: str, taken: list[str]) -> str:
    """The name, made longer until no column has it, in capitals or not."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    place = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[place[0]:place[-1]], place - place[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `size` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        first, done = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(first, last - first)
            first, done = last, int(ends[last - 1])


@dataclass
class Words:
    """Words in text order. `row`: the text of a word; `first`: the first word of each text, and the number of words."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    """Words between the bytes that `separator` marks."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(offsets), np.int64))
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside
    ends[:-1] = inside[:-1] & (~inside[1:] | edge[1:n])
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, first)


def hashes(data: np.ndarray, words: Words, lower: bool = True, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each word."""
    start, end = words.start, words.end
    out = np.empty(len(start), np.uint64)
    salt = np.uint64(_SEEDS[seed] * 0xD1342543DE82EF95 % (1 << 64))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK)))
        a, b = int(start[i]), int(end[j - 1])
        part = np.zeros(b - a + 8, np.uint8)
        part[:b - a] = _LOWER[data[a:b]] if lower else data[a:b]
        groups = np.ndarray(b - a + 1, "<u8", part, strides=(1,))
        size = end[i:j] - start[i:j]
        held = (size + 7) >> 3
        last = np.cumsum(held)
        first = last - held
        place = np.arange(last[-1]) - np.repeat(first, held)
        at = np.repeat(start[i:j] - a, held) + 8 * place
        value = groups[at] & _HEAD[np.minimum(np.repeat(end[i:j] - a, held) - at, 8)]
        factor = _factors(seed, 1 << max(6, int(held.max()).bit_length()))
        out[i:j] = np.add.reduceat(mix(value ^ salt) * factor[place], first) + size.astype(np.uint64)
        i = j
    return mix(out)


def runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of the n words from each place on; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    one, two = _factors(seed, 64)[:2]
    # Runs of doubling length; those of the set bits of n are joined.
    part, out, size, done = h, None, 1, 0
    while True:
        if n & size:
            if out is None:
                out = mix(part * one)
            else:
                m = min(len(out), len(part) - done)
                out = mix(out[:m] * one + mix(part[done:done + m] * two))
            done += size
        size <<= 1
        if size > n:
            return out
        half = size >> 1
        part = mix(part[:len(part) - half] * one + mix(part[half:] * two))


def whole(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from a place on belong to one text."""
    m = len(row) - n + 1
    return row[:m] == row[n - 1:] if m > 0 else np.zeros(0, bool)


def shingles(data: np.ndarray, words: Words, n: int, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words; a text with fewer words gives its whole sequence, one without words none."""
    h = hashes(data, words, lower, seed)
    inside = whole(words.row, n)
    row, value = words.row[:len(inside)][inside], runs(h, n, seed)[inside]
    counts = words.counts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            first = words.first[short]
            part = np.zeros(len(short), np.uint64)
            for j in range(k):
                part = mix(part * _factors(seed, 64)[2] + h[first + j] + np.uint64(k))
            row, value = np.concatenate([row, short]), np.concatenate([value, part])
    return row, value


def by_row(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by row and then by value, and the first place of each row with the end."""
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    value = value.copy()
    first = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            value[a:b].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(keep)])[first]
