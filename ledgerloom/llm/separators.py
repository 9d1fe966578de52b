"""Token counts of documents in flat token files that have no index: a scan for end-of-document ids.

Files are runs of ids and nothing else. Every block of a file is searched by itself, in parallel; a prefix scan over the
blocks' sums (ends so far, ids since the last end) numbers the documents and stitches those that cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm import files, tokens, words
from ledgerloom.llm.scratch import Scratch

BLOCK_IDS = 1 << 20
# Blocks a task searches: some eight million ids.
BLOCKS_A_TASK = 8
_FOUND_SQL = "file string, block long, ends array<long>, size long"


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ordinal = None, 0
        out = held = None
        for batch in words.slices(batches, size=tokens.SLICE):
            if name is None:
                name = files.new_name(folder, f"part-{TaskContext.get().partitionId():06d}", "ids")
                held = files.writing(name)
                out = held.__enter__()
            ids, _ = tokens.ids_of(path, batch.column(1), end_id)
            out.write(ids.tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)],
                                             names=["file", "ordinal", "doc_id"])
            ordinal += n
        if held is not None:
            held.__exit__(None, None, None)
    return run


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, scratch: Scratch) -> DataFrame:
    """Write ids of every text, each ended by `end_id`, to flat files; returns (file, ordinal, doc_id), written.

    One file for each partition of `docs`, in its order; the files themselves hold no lengths. `end_id` must be an id
    that no text encodes to.
    """
    path = tokens.tokenizer_path(tokenizer)
    rows = docs.select("doc_id", "text").mapInArrow(_write(folder, path, end_id), "file string, ordinal long, doc_id long")
    return scratch.keep(rows, "ordinals")


def _sizes(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([files.size(x) // kind.itemsize for x in names], pa.int64())], names=["file", "ids"])
    return run


def _scan(kind: np.dtype, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.reading(name) as source:
                    source.seek(k * block * kind.itemsize)
                    ids = np.frombuffer(source.read(block * kind.itemsize), kind)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([np.flatnonzero(ids == end_id)], pa.list_(pa.int64())),
                                                  pa.array([len(ids)], pa.int64())], names=["file", "block", "ends", "size"])
    return run


def scan_documents(spark: SparkSession, names: DataFrame, scratch: Scratch, kind: np.dtype, end_id: int, block: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document of the files named in column `file`.

    `n_tokens` counts the end id; ids behind the last end of a file are a document of their own without an end. Empty
    files have none. Documents may cross any number of blocks.
    """
    sizes = names.select("file").distinct().mapInArrow(_sizes(kind), "file string, ids long").where("ids > 0")
    blocks = sizes.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / block))).alias("block"))
    # The rows are a few bytes long and stand for megabytes, so the number of tasks follows the ids and not their bytes.
    count = sizes.agg(F.sum(F.ceil(F.col("ids") / block))).first()[0] or 0
    parts = max(1, -(-count // BLOCKS_A_TASK))
    found = scratch.keep(blocks.repartitionByRange(parts, "file", "block").mapInArrow(_scan(kind, end_id, block), _FOUND_SQL), "found")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("block") * block
    n = F.size("ends")
    # Rows of this scan are one for each block of a file and carry two numbers.
    carry = (found.select("file", "block", "size", n.alias("n"), (here + F.try_element_at("ends", F.lit(-1)) + 1).alias("next"))
             .withColumn("ordinal", F.coalesce(F.sum("n").over(upto), F.lit(0)))
             .withColumn("begin", F.coalesce(F.max("next").over(upto), F.lit(0)))
             .withColumn("last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()))
    joined = found.select("file", "block", "ends").join(carry, ["file", "block"])
    inner = (joined.select("file", "ordinal", "begin", (F.col("block") * block).alias("here"), "ends", F.posexplode("ends").alias("k", "end"))
             .select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
                     F.when(F.col("k") == 0, F.col("begin")).otherwise(F.col("here") + F.expr("get(ends, k - 1)") + 1).alias("start"),
                     (F.col("here") + F.col("end") + 1).alias("stop"))
             .select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens")))
    tail = (carry.where("last").withColumn("begin", F.coalesce("next", "begin"))
            .withColumn("n_tokens", F.col("block") * block + F.col("size") - F.col("begin")).where("n_tokens > 0")
            .select("file", (F.col("ordinal") + F.col("n")).alias("ordinal"), F.col("begin").alias("start"), "n_tokens"))
    return inner.union(tail)


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) of every document, end id included, found by scanning flat files made of `docs`.

    Null and empty texts count one id. Rows that share or lack a doc_id are counted each for itself; an empty table
    gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "separators")
    ordinals = write_flat_files(docs, scratch.path("flat"), tokenizer, end_id, scratch)
    kind = tokens.id_kind(tokens.tokenizer_path(tokenizer))
    found = scan_documents(spark, ordinals, scratch, kind, end_id, block)
    return ordinals.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
