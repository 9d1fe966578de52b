"""Packing along a space-filling curve: documents that are near each other share sequences.

A document's words are hashed to signs and places, projected to three dimensions and put on a Hilbert curve. Documents
are range-sorted by curve key; the ids along the curve are one stream, cut at every multiple of the sequence length, so
only the last sequence has room to spare. What is sorted are rows of three numbers; ids are shuffled once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import tokens, words
from ledgerloom.llm.scratch import Scratch

BITS, BUCKETS = 16, 256
_AXES = np.random.default_rng(20260202).normal(size=(BUCKETS, 3)).astype(np.float32)


def hilbert(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2^bits; rows are points."""
    x = [point[:, i].astype(np.uint64) for i in range(point.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        side = one << np.uint64(level)
        low = side - one
        for i in range(len(x)):
            inside = (x[i] & side) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(point), np.uint64)
    for level in range(bits - 1, 0, -1):
        side = one << np.uint64(level)
        flip = np.where((x[-1] & side) != 0, flip ^ (side - one), flip)
    key = np.zeros(len(point), np.uint64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ flip) >> np.uint64(level)) & one)
    return key.view(np.int64)


def curve_keys(column: pa.Array) -> np.ndarray:
    """Curve key of each text; texts without words lie at the centre."""
    data, offsets = words.buffer_of(column)
    w = words.split(data, offsets)
    h = words.hashes(data, w)
    sign = np.where(h >> np.uint64(63), np.float32(1), np.float32(-1))
    sums = np.zeros((len(h) + 1, 3))
    np.cumsum(_AXES[(h & np.uint64(BUCKETS - 1)).astype(np.int64)] * sign[:, None], axis=0, dtype=np.float64, out=sums[1:])
    n = w.counts
    mean = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(n, 1)[:, None]
    place = np.clip((np.arctan(mean * 4) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(place.astype(np.int64))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each document inside its range."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))],
                                         names=["row", "n_tokens", "before", "part"])
        total = int(ends[-1]) if len(ends) else total


def _pieces(length: int, kind: np.dtype):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, size, crc = [], [], [], []
            before = batch.column(1).to_numpy(zero_copy_only=False)
            for i, (offset, packed) in enumerate(zip(before.tolist(), batch.column(2).to_pylist())):
                ids = tokens.unpack_bytes(packed, kind).astype("<u4")
                cuts = [0, *range(length - offset % length, len(ids), length), len(ids)]
                raw = memoryview(ids.tobytes())
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a:4 * b]))
            at, start = np.array(at, np.int64), np.array(start, np.int64)
            place = before[at] + start if len(at) else start
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                 batch.column(3).take(pa.array(at)), pa.array(place // length), pa.array(place % length)], names=names)
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    `docs` has doc_id and text. A text becomes its ids and then `end_id`. Pieces fill sequences without a gap; all but
    the last sequence hold `length` ids. Null and empty texts are one id. Rows that share or lack a doc_id are documents
    of their own. Equal curve keys are in order of doc_id and then of text. An empty table gives no rows; other columns
    are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokens.tokenizer_path(tokenizer)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    folder = scratch.path("staged")
    (rows.mapInArrow(tokens.staged(path, end_id, curve_keys), f"{tokens.STAGED_SQL}, place long")
     .write.option("compression", "uncompressed").parquet(folder))
    staged = spark.read.parquet(folder)
    ordered = staged.select("place", "doc_id", "row", "n_tokens").repartitionByRange("place", "doc_id", "row").sortWithinPartitions("place", "doc_id", "row")
    stream = scratch.keep(ordered.select("row", "n_tokens").mapInArrow(_stream, "row long, n_tokens long, before long, part int"), "stream")
    base, bases = 0, []
    # One short row for each range.
    for part, total in sorted(tuple(r) for r in stream.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases.append((part, base))
        base += total
    known = spark.createDataFrame(bases, "part int, base long")
    offsets = stream.join(known, "part").select("row", (F.col("base") + F.col("before")).alias("before"))
    joined = staged.join(offsets, "row").select("doc_id", "before", "packed", "n_tokens")
    return joined.mapInArrow(_pieces(length, tokens.id_kind(path)),
                             "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
