"""Short test items found inside long documents: MinHash containment, partitioned by size, then exact.

The MinHash signature of an item is its k least shingle hashes. Items are partitioned by size in powers of two, and k
follows the largest size of the partition: one more than the shingles that a document may lack. So a document that holds
enough of an item holds part of its signature however long it is, and how much it holds bounds the containment from
above. Documents keep every hash at most as large as a signature needs, so no signature of a long document is cut short.
Candidates are counted exactly, by comparing words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import words

BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_PAIR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared_shingles", pa.int64())])
_PAIR_SQL = "doc_id long, item_id long, item_shingles long, shared_shingles long"


@dataclass
class Index:
    """Items of one block. Signature entries are sorted by hash; entry i belongs to items owner[begin[i]:begin[i+1]]."""

    ids: list
    short: list[int]
    sets: list[frozenset]
    hashed: list[np.ndarray]
    need: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    quick: np.ndarray


def _low(text: bytes) -> list[bytes]:
    return text.translate(words._LOWER.tobytes()).split()


def lacking(n: int, percent: int) -> int:
    """Shingles of n that may be missing."""
    return n + (-percent * n) // 100


def build(items: list[tuple], size: int, percent: int) -> Index | None:
    ids, short, sets, hashed, need, sig_hash, sig_item = [], [], [], [], [], [], []
    for item_id, text in items:
        parts = _low((text or "").encode())
        if not parts:
            continue
        width = min(size, len(parts))
        shingles = frozenset(b" ".join(parts[i:i + width]) for i in range(len(parts) - width + 1))
        data = np.frombuffer(b" ".join(parts), np.uint8)
        split = words.split(data, np.array([0, len(data)]))
        value = np.unique(words.runs(words.hashes(data, split), width))
        n = len(value)
        top = (1 << (n - 1).bit_length()) if n > 1 else 1
        k = min(n, lacking(top, percent) + 1)
        sig_hash.append(value[:k])
        sig_item += [len(ids)] * k
        need.append(k - lacking(n, percent))
        ids.append(item_id)
        short.append(width)
        sets.append(shingles)
        hashed.append(value)
    if not ids:
        return None
    h, item = np.concatenate(sig_hash), np.array(sig_item)
    order = np.argsort(h, kind="stable")
    h, item = h[order], item[order]
    key, begin = np.unique(h, return_index=True)
    quick = np.zeros(1 << _FILTER_BITS, bool)
    quick[key >> np.uint64(64 - _FILTER_BITS)] = True
    return Index(ids, short, sets, hashed, np.maximum(1, need), key, np.append(begin, len(h)), item, quick)


def _search(percent: int, index_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_cast.value
        widths = sorted(set(index.short))
        for batch in words.slices(batches):
            data, offsets = words.buffer_of(batch.column(1))
            w = words.split(data, offsets)
            h = words.hashes(data, w)
            runs, rows, entries = {}, [], []
            for width in widths:
                value = words.runs(h, width)
                runs[width] = value
                at = np.flatnonzero(index.quick[value >> np.uint64(64 - _FILTER_BITS)] & words.whole(w.row, width))
                entry = np.minimum(np.searchsorted(index.key, value[at]), len(index.key) - 1)
                hit = index.key[entry] == value[at]
                rows.append(w.row[at[hit]])
                entries.append(entry[hit])
            row, entry = np.concatenate(rows), np.concatenate(entries)
            if not len(row):
                continue
            pair = np.unique(row * len(index.key) + entry)
            row, entry = pair // len(index.key), pair % len(index.key)
            held = np.diff(index.begin)[entry]
            row = np.repeat(row, held)
            at = np.repeat(index.begin[entry], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            pair, hits = np.unique(row * len(index.ids) + index.owner[at], return_counts=True)
            item = pair % len(index.ids)
            enough = hits >= index.need[item]
            out = []
            for d, i in zip((pair // len(index.ids))[enough].tolist(), item[enough].tolist()):
                width, first, last = index.short[i], int(w.first[d]), int(w.first[d + 1])
                part = runs[width][first:max(first, last - width + 1)]
                found = set()
                for j in (first + np.flatnonzero(np.isin(part, index.hashed[i]))).tolist():
                    found.add(b" ".join(_low(data[w.start[j]:w.end[j + width - 1]].tobytes())))
                shared = len(found & index.sets[i])
                if 100 * shared >= percent * len(index.sets[i]):
                    out.append((d, i, len(index.sets[i]), shared))
            if out:
                d, i, n, shared = zip(*out)
                yield pa.record_batch([batch.column(0).take(pa.array(d, pa.int64())), pa.array([index.ids[x] for x in i], pa.int64()),
                                       pa.array(n, pa.int64()), pa.array(shared, pa.int64())], schema=_PAIR)
    return run


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles): items of which a document holds at least `percent` % of the shingles.

    `docs` has doc_id and text, `items` item_id and text. Words are runs of anything but space and tab to carriage return,
    A-Z lower-cased. An item's shingles are its distinct runs of `size` words; an item of fewer words is one shingle.

    Items without words match nothing; null texts are empty. Rows that repeat an id are reported each for itself, null
    ids stay null. Empty tables give no rows; other columns are dropped. Items are taken in blocks of at most BLOCK_BYTES
    of text (or one longer item), each broadcast on its own and searched in a pass of its own, so a large test set costs
    passes and no more memory.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    asked = items.select("item_id", "text")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    whole = asked.agg(F.sum(weight)).first()[0] or 0
    count = max(1, -(-2 * whole // BLOCK_BYTES)) if whole > BLOCK_BYTES else 1
    out = None
    for block in range(count):
        part = asked if count == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        index = build([tuple(r) for r in part.toLocalIterator()], size, percent)
        if index is not None:
            found = source.mapInArrow(_search(percent, spark.sparkContext.broadcast(index)), _PAIR_SQL)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], _PAIR_SQL) if out is None else out
