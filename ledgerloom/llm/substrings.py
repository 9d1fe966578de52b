"""Removal of passages that repeat across or within documents, behind a count-min prefilter.

First pass: each task counts, in a sketch, one anchor for every window of `width` words: the run of `GRAM` words with the
least hash inside it (leftmost on ties). Equal windows have equal anchors at unlike places, so an anchor's estimated
count is never below the count of any of its windows, while about one place in seven is an anchor. Second pass: only
windows whose estimate is 2 or more are grouped, exactly, by a 128-bit fingerprint of their words. Inside one slice of a
task only the first of equal windows needs the shuffle, so one passage in a third of all rows sends a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import sketch, words
from ledgerloom.llm.scratch import Scratch

GRAM = 8
DEPTH = 2
CUT_SLICE = 2 << 20
BYTES_PER_WORD = 6.5
NO_ID = -(1 << 63)
_HIT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("run", pa.int32())])
_HIT_SQL = "h1 long, h2 long, doc_id long, row long, start int, run int"


def anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """For each place, the leftmost place of the least value among the `span` values from there on."""
    n = len(gram) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, reach = np.arange(len(gram)), 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(gram[b] < gram[a], b, a)
        reach += step
    return best[:n]


class _Slice:
    """Windows of one slice, by (doc_id, row, place)."""

    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.lexsort((keys, ids))
        if (order[1:] < order[:-1]).any():
            batch, ids, keys = batch.take(pa.array(order)), ids[order], keys[order]
        self.ids, self.keys, self.width = ids, keys, width
        self.data, offsets = words.buffer_of(batch.column(1))
        self.words = words.split(self.data, offsets)
        self.hash = words.hashes(self.data, self.words, lower=False)
        gram = min(GRAM, width)
        grams = words.runs(self.hash, gram)
        self.at = np.flatnonzero(words.whole(self.words.row, width))
        self.anchor = grams[anchors(grams, width - gram + 1)[self.at]] if len(self.at) else np.zeros(0, np.uint64)
        self.place = anchors(grams, width - gram + 1)[self.at] if len(self.at) else np.zeros(0, np.int64)


def _count(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sketch.Collector(bits, DEPTH)
        for batch in words.slices(batches):
            part = _Slice(batch, width)
            fresh = np.ones(len(part.place), bool)
            fresh[1:] = part.place[1:] != part.place[:-1]
            if held.add(part.anchor[fresh]):
                yield held.rows()
        yield held.rows()
    return run


def _intervals(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of sorted (row, start)."""
    if not len(row):
        return row, start, start
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
    return row[cut], start[cut], np.diff(np.append(cut, len(row)))


def _find(width: int, bits: int, maps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        for batch in words.slices(batches):
            part = _Slice(batch, width)
            keep = sketch.reaches(known, part.anchor, bits)
            at = part.at[keep]
            if not len(at):
                continue
            h1 = words.runs(part.hash, width)[at]
            h2 = words.runs(words.hashes(part.data, part.words, False, 1), width, 1)[at]
            row = part.words.row[at]
            doc, key, start = part.ids[row], part.keys[row], at - part.words.first[row]
            order = np.argsort(h1, kind="stable")
            a, b = order[1:], order[:-1]
            same = (h1[a] == h1[b]) & (h2[a] == h2[b])
            # Rows that share doc_id and key are one document, with equal windows at equal places.
            later = np.zeros(len(at), bool)
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(at)), 0))
            lead = order[lead]
            later[order] = (doc[order] != doc[lead]) | (key[order] != key[lead]) | (start[order] != start[lead])
            one = ~later
            r, s, n = _intervals(row[later], start[later])
            d, k = part.ids[r], part.keys[r]
            pseudo = words.mix(words.mix(d.astype(np.uint64)) ^ k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64)).view(np.int64)
            yield pa.record_batch([
                pa.array(np.concatenate([h1[one].view(np.int64), pseudo])),
                pa.array(np.concatenate([h2[one].view(np.int64), pseudo])),
                pa.array(np.concatenate([doc[one], d])),
                pa.array(np.concatenate([key[one], k])),
                pa.array(np.concatenate([start[one], s]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(one.sum(), np.int32), n]).astype(np.int32))], schema=_HIT)
    return run


def _cut(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, size=CUT_SLICE):
            texts, covers = batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(0).to_pylist()
            kept, n_words, n_removed = [], [], []
            for text, cover in zip(texts, covers):
                parts = text.encode().split() if text else []
                n_words.append(len(parts))
                if cover:
                    step = np.zeros(len(parts) + 1, np.int64)
                    pairs = np.array([(c["start"], max(1, c["run"])) for c in cover], np.int64)
                    np.add.at(step, pairs[:, 0], 1)
                    np.add.at(step, np.minimum(pairs.sum(1) + width - 1, len(parts)), -1)
                    parts = [parts[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(parts))
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:1 + len(names)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64())], names=[*names, "kept", "n_words", "n_removed"])
    return run


def remove_repeats(docs: DataFrame, width: int = 20, most_bits: int = 26, carry: list[str] | None = None,
                   key: str | None = None) -> DataFrame:
    """Drop each word that lies in a window of `width` words which also starts earlier.

    `docs` has doc_id and text; `key` names a column of longs, one of its own for each row and the same in every reading.
    Earlier means a smaller (doc_id, key, start); windows are judged on the input. Words are runs of anything but space and tab to carriage return, unchanged. Returns doc_id, the
    columns named in `carry`, kept (words joined by one space), n_words and n_removed.

    Null and empty texts have no words and kept is empty. A null doc_id counts as the smallest. Rows that share or
    lack a doc_id are documents of their own. Without `key` a hash of the text stands for it: rows that share doc_id and
    text are then one document, whose windows at the same place are not earlier than each other. Texts shorter than `width` words stay whole. Empty tables give no rows. Other columns are
    dropped unless carried. `most_bits` bounds the sketch (2 x 2^most_bits bits are broadcast); a fuller sketch only
    sends more windows to the exact grouping.
    """
    spark, carry = docs.sparkSession, list(carry or [])
    scratch = Scratch(spark, "substrings")
    row = F.xxhash64("text") if key is None else F.col(key).cast("long")
    source = docs.select("doc_id", "text", row.alias("row"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(size / BYTES_PER_WORD / 7, most_bits)
    counted = scratch.keep(source.mapInArrow(_count(width, bits), sketch.SCHEMA), "sketch")
    maps = spark.sparkContext.broadcast(sketch.merge(counted, bits, DEPTH))
    scratch.drop(counted)
    hits = source.mapInArrow(_find(width, bits, maps), _HIT_SQL)
    place = F.struct("doc_id", "row", "start")
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    later = hits.withColumn("_first", first).where((F.col("run") > 0) | (place > F.col("_first")))
    # Names of our own that no column of the caller has.
    cover, key_of, held = (words.fresh_name(n, docs.columns) for n in ("cover", "row", "covers"))
    covers = later.groupBy(F.col("doc_id").alias(cover), F.col("row").alias(key_of)).agg(F.collect_list(F.struct("start", "run")).alias(held))
    own = (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col(cover)) & (row == F.col(key_of))
    names = ["doc_id", *carry]
    joined = docs.join(covers, own, "left").select(held, *names, *([] if "text" in carry else ["text"]))
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return joined.mapInArrow(_cut(width, names), f"{kinds}, kept string, n_words long, n_removed long")
