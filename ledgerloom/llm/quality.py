"""Text quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are runs of one and two words, and runs of one to three word shapes (a shape writes upper case,
lower case and digits as A, a and 9, and repeats once), hashed into 2^BITS buckets. Each kind of run is scaled by the
square root of the number of words, so a score is a few sparse dot products. Training takes a bounded sample of labelled
rows, dealt over SHARDS tasks; each runs FTRL-proximal over its rows, and what it changed in a bucket is averaged with the
others that changed it after every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import words
from ledgerloom.llm.scratch import Scratch

BITS = 18
SHARDS = 8
SLICE = 1 << 20
ROUNDS = 2
MOST_ROWS = 16_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 57, 97


def _shapes(data: np.ndarray, w: words.Words) -> np.ndarray:
    """A hash of the shape of each word."""
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.start] = True
    at = np.append(0, np.cumsum(keep))
    return words.hashes(shape[keep], words.Words(at[w.start], at[w.end], w.row, w.first), lower=False, seed=1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every run of every text, by row; values of repeated buckets add up."""
    data, offsets = words.buffer_of(column)
    w = words.split(data, offsets)
    plain = words.hashes(data, w)
    shape = _shapes(data, w) if len(w.start) else plain
    scale = 1 / np.sqrt(np.maximum(w.counts, 1))
    row, bucket = [], []
    for kind, (h, n) in enumerate(((plain, 1), (plain, 2), (shape, 1), (shape, 2), (shape, 3))):
        inside = words.whole(w.row, n)
        at = w.row[:len(inside)][inside]
        row.append(at)
        bucket.append(words.mix(words.runs(h, n)[inside] + np.uint64(kind)) >> np.uint64(64 - BITS))
    row, bucket = np.concatenate(row), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], scale[row[order]]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def learn(column: pa.Array, label: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One FTRL-proximal update of the state for each text, in order; the last entry is the bias."""
    row, bucket, value = features(column)
    first = np.searchsorted(row, np.arange(len(label) + 1))
    for i in range(len(label)):
        at, back = np.unique(np.append(bucket[first[i]:first[i + 1]], 1 << BITS), return_inverse=True)
        x = np.bincount(back, np.append(value[first[i]:first[i + 1]], 1.0))
        w = weights(z[at], n[at])
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label[i]) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def scores(column: pa.Array, w: np.ndarray) -> np.ndarray:
    row, bucket, value = features(column)
    total = np.bincount(row, w[bucket] * value, len(column)) + w[1 << BITS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _train(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (x.copy() for x in state.value)
        seen = 0
        for batch in batches:
            for part in words.slices(iter([batch]), size=SLICE):
                learn(part.column(1), part.column(2).to_numpy(zero_copy_only=False), z, n)
                seen += part.num_rows
        moved = np.flatnonzero((n != state.value[1]) | (z != state.value[0]))
        size = len(moved)
        yield pa.RecordBatch.from_arrays(
            [pa.array(moved, pa.int64()), pa.array((z - state.value[0])[moved] * seen), pa.array((n - state.value[1])[moved] * seen),
             pa.array(np.full(size, seen, np.int64))], names=["bucket", "z", "n", "seen"])
    return run


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from docs (doc_id, text) and labels (doc_id, quality of 0 or 1).

    At most about `most_rows` labelled rows are used, chosen by a hash of their id. Rows without an id, a text or a label
    of 0 or 1 are left out; without any rows, all weights are 0 (a score of 0.5).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    total = known.join(docs.select("doc_id").where(F.col("text").isNotNull()), "doc_id", "left_semi").count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    chosen = share < min(1_000_000, int(1e6 * most_rows / max(total, 1)))
    sample = scratch.keep(docs.select("doc_id", "text").where(F.col("text").isNotNull() & chosen).join(known.where(chosen), "doc_id")
                          .select("doc_id", "text", "label").repartition(SHARDS, F.xxhash64("doc_id", F.lit(29))).sortWithinPartitions(F.xxhash64("doc_id")), "sample")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        dealt = sample.repartition(SHARDS, F.xxhash64("doc_id", F.lit(29))).sortWithinPartitions(F.xxhash64("doc_id"))
        moved = (dealt.mapInArrow(_train(state), "bucket long, z double, n double, seen long").groupBy("bucket")
                 .agg((F.sum("z") / F.sum("seen")).alias("z"), (F.sum("n") / F.sum("seen")).alias("n")))
        # A row a bucket, so at most 2^BITS + 1, however many tasks there are.
        parts = moved.toArrow()
        state.unpersist()
        at = parts["bucket"].to_numpy()
        z[at] += parts["z"].to_numpy()
        n[at] += parts["n"].to_numpy()
    return weights(z, n)


def score(docs: DataFrame, w: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """docs' doc_id and `carry` columns with a score of 0 to 1 for every whole text; null is scored as empty.

    Every row comes back, also those that share or lack a doc_id; an empty table gives no rows. A carried column named
    score gives way to the score.
    """
    known = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    names = ["doc_id", *(c for c in carry or [] if c.lower() != "score")]
    read = names if "text" in names else [*names, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word has five features of four numbers, so slices are small.
        for batch in words.slices(batches, size=SLICE):
            found = pa.array(scores(batch.column(read.index("text")), known.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], found], names=[*names, "score"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return docs.select(*read).mapInArrow(run, f"{kinds}, score double")
