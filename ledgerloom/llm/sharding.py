"""Shards of near equal bytes by sampled splitters.

Keys are hashes of the text, so equal texts are neighbours. A size-weighted sample of keys gives quantiles; they cut the
key space into many small ranges, whose exact sizes are then counted. Ranges that came out overfull are subdivided: by a
second hash of the key, and a key that alone is larger than a shard's share by doc_id. Whole ranges are dealt to shards,
largest first, each to the emptiest shard, so equal texts stay together unless they alone exceed a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import words
from ledgerloom.llm.scratch import Scratch

RANGES = 64
SAMPLE = 32
ROWS_PER_RANGE = 200_000


def splitters(keys: np.ndarray, count: int) -> np.ndarray:
    """Boundaries between `count` ranges of about equal sampled weight, without repeats."""
    keys = np.sort(keys)
    return np.unique(keys[(np.arange(1, count) * len(keys)) // count]) if len(keys) else keys


def deal(sizes: dict[tuple, int], shards: int) -> dict[tuple, int]:
    """Shard of each range: largest first to the shard with the least so far; ties by name and number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def _ranges(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = bounds.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(cut, key, side="right").astype(np.int64))],
                                             names=[*batch.schema.names, "range"])
    return run


def shard(docs: DataFrame, shards: int, ranges: int = RANGES, sample: int = SAMPLE, key: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; size is the text's UTF-8 bytes and 1.

    slot counts from 0 in each shard without gaps. `docs` has doc_id and text. A null text is as an empty one. Rows that
    share or lack a doc_id are rows of their own. Equal texts share a shard unless together they exceed one shard's
    share; then they are spread by doc_id. An empty table gives no rows; other columns are dropped. About
    `shards * ranges * sample` keys are sampled; there are about `shards * ranges` ranges, more only so that no range
    has more than about ROWS_PER_RANGE rows, and they are what the driver deals out. `key` names a column of longs, one of
    its own for each row, which is then added to the result as `row`.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("key"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"), (F.monotonically_increasing_id() if key is None else F.col(key)).alias("row"))
    kept = scratch.keep(keyed, "keys")
    total, rows = kept.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    count = max(shards * ranges, -(-rows // ROWS_PER_RANGE))
    # A row is drawn as often as its size asks for, by a hash that a rerun repeats.
    want = F.col("size") * F.lit(count * sample / max(total, 1))
    draw = F.pmod(F.xxhash64("row", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(want) + (draw < want - F.floor(want)).cast("long")).cast("int")
    drawn = kept.select("key", times.alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    found = drawn.toArrow()
    keys = np.repeat(found["key"].to_numpy().astype(np.int64), found["times"].to_numpy().astype(np.int64))
    bounds = spark.sparkContext.broadcast(splitters(keys, count))
    ranged = kept.mapInArrow(_ranges(bounds), "key long, doc_id long, size long, text_crc32 long, row long, range long")
    ranged = scratch.keep(ranged, "ranged")

    share = total / shards
    goal = max(1.0, total / count)
    # Keys that alone exceed a shard's share: fewer than `shards`.
    giant = [r.key for r in ranged.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > share).select("key").collect()]
    full = {r["range"]: int(r["size"] // goal) for r in ranged.where(~F.col("key").isin(giant) if giant else F.lit(True))
            .groupBy("range").agg(F.sum("size").alias("size")).where(F.col("size") > 2 * goal).collect()}
    cuts = spark.createDataFrame([(int(r), n) for r, n in full.items()], "range long, cuts int")
    spread = max(1, ranges)
    part = (F.when(F.col("key").isin(giant), F.pmod(F.xxhash64("row", F.lit(5)), F.lit(spread)) + (1 << 20)) if giant else F.when(F.lit(False), F.lit(0)))
    placed = ranged.join(cuts, "range", "left").withColumn(
        "part", part.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("key", F.lit(7)), F.col("cuts"))).otherwise(F.lit(0)).cast("long"))
    placed = scratch.keep(placed.select("range", "part", "doc_id", "row", "size", "text_crc32", "key"), "placed")
    sizes = {(r["range"], r["part"]): (r["size"], r["n"]) for r in placed.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    dealt = deal({k: v[0] for k, v in sizes.items()}, shards)
    before, plan = [0] * shards, []
    for name in sorted(sizes):
        plan.append((*name, dealt[name], before[dealt[name]]))
        before[dealt[name]] += sizes[name][1]
    known = spark.createDataFrame(plan, "range long, part long, shard int, before long")
    place = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "row")) - 1
    return (placed.withColumn("place", place).join(known, ["range", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"), *([] if key is None else ["row"])))


def write_shards(docs: DataFrame, folder: str, shards: int) -> None:
    """Write every row of `docs` once below `folder`, a directory for each shard; rows may share or lack a doc_id.

    The added columns shard and slot take a longer name (`shard_`) where `docs` has a column of that name.
    """
    row, shard_, slot = (words.fresh_name(n, docs.columns) for n in ("row", "shard", "slot"))
    rows = Scratch(docs.sparkSession, "shards").keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    placed = shard(rows, shards, key=row).select(F.col("row").alias(row), F.col("shard").alias(shard_), F.col("slot").alias(slot))
    rows.join(placed, row).drop(row).write.partitionBy(shard_).parquet(folder)
