"""Token ids in files coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, serves every file. A file is a row of independent blocks of BLOCK ids; in a
block LANES coders take turns, so numpy advances all lanes of several blocks at once. The footer has a checkpoint for
each block (place of its bytes, ids before it, CRC-32), and the ids and lengths of the documents; reading can start at
any checkpoint. Files cover ascending ranges of doc_id.

File: b"LRANS1\\0\\0", blocks, footer (zlib), footer length (8 bytes), CRC-32 of the footer (4 bytes), b"LRANS1\\0\\0".
Block: LANES final states (8 bytes each), then the words of 4 bytes that decoding takes in, in the order it takes them.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import files, tokens
from ledgerloom.llm.scratch import Scratch

MAGIC = b"LRANS1\0\0"
BLOCK, LANES, TOGETHER = 1 << 17, 256, 8
# Blocks a task decodes: some eight million ids.
BLOCKS_A_TASK = 64
SCALE = 20
LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Frequencies that sum to 2^SCALE, by id; ids that never occur have 0."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        return cls(freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 for every id that occurs, near to proportion, summing to 2^SCALE."""
    total, goal = int(counts.sum()), 1 << SCALE
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    some = np.flatnonzero(counts)
    if len(some) > goal // 2:
        raise ValueError("too many distinct ids for the scale")
    share = counts[some] * ((goal - len(some)) / total)
    freq[some] = 1 + np.floor(share).astype(np.int64)
    left = goal - int(freq.sum())
    order = some[np.argsort(-counts[some], kind="stable")]
    freq[order[0]] += left
    return freq


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Each row of `ids` as a block; rows are equally long, a multiple of LANES."""
    blocks, width = ids.shape
    steps = width // LANES
    lanes = ids.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((steps, blocks, LANES), np.uint32)
    taken = np.zeros((steps, blocks, LANES), bool)
    room = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        s = lanes[:, t]
        f = table.freq[s]
        full = x >= (f << room)
        taken[t] = full
        words[t] = x.astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.start[s]
    return [x[b].astype("<u8").tobytes() + words[:, b][taken[:, b]].astype("<u4").tobytes() for b in range(blocks)]


def decode_blocks(coded: list[bytes], width: int, table: Table) -> np.ndarray:
    """The inverse of encode_blocks."""
    steps, blocks = width // LANES, len(coded)
    x = np.stack([np.frombuffer(c, "<u8", LANES) for c in coded]).astype(np.uint64)
    parts = [np.frombuffer(c, "<u4", offset=8 * LANES) for c in coded]
    ends = np.cumsum([len(p) for p in parts])
    feed = np.append(np.concatenate(parts), np.uint32(0)).astype(np.uint64)
    at = (ends - [len(p) for p in parts]).astype(np.int64)
    out = np.empty((blocks, steps, LANES), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot]
        out[:, t] = s
        x = table.freq[s] * (x >> scale) + slot - table.start[s]
        need = x < LOW
        order = np.cumsum(need, axis=1)
        x = np.where(need, (x << np.uint64(32)) | feed[np.minimum(at[:, None] + order - 1, len(feed) - 1)], x)
        at = at + order[:, -1]
    if (x != LOW).any() or (at != ends).any():
        raise ValueError("a block does not end where it should")
    return out.reshape(blocks, width)


class Writer:
    def __init__(self, out, table: Table) -> None:
        self.out, self.table, self.held, self.size = out, table, [], 0
        self.place, self.total = len(MAGIC), 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.pad = int(np.argmax(table.freq)) if len(table.freq) else 0
        out.write(MAGIC)

    def add(self, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths += lengths
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BLOCK * TOGETHER:
            self._flush(False)

    def _put(self, coded: list[bytes]) -> None:
        for c in coded:
            self.out.write(c)
            self.blocks.append((self.place, len(c), zlib.crc32(c)))
            self.place += len(c)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK
        for a in range(0, whole, TOGETHER):
            b = min(whole, a + TOGETHER)
            self._put(encode_blocks(ids[a * BLOCK:b * BLOCK].reshape(b - a, BLOCK), self.table))
        rest = ids[whole * BLOCK:]
        if last and len(rest):
            self._put(encode_blocks(np.append(rest, np.full(-len(rest) % LANES, self.pad, rest.dtype)).reshape(1, -1), self.table))
            rest = rest[:0]
        self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        footer = zlib.compress(json.dumps({"total": self.total, "blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}).encode(), 1)
        self.out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)


def read_footer(source) -> dict:
    end = source.size()
    source.seek(end - 20)
    length, crc = struct.unpack("<QI", source.read(12))
    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    source.seek(end - 20 - length)
    footer = source.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("the footer is damaged")
    return json.loads(zlib.decompress(footer))


def read_ids(source, footer: dict, first: int, last: int, table: Table) -> np.ndarray:
    """Ids of the blocks first to last - 1."""
    out = []
    for a in range(first, last, TOGETHER):
        coded, widths = [], []
        for k in range(a, min(last, a + TOGETHER)):
            place, length, crc = footer["blocks"][k]
            source.seek(place)
            data = source.read(length)
            if zlib.crc32(data) != crc:
                raise ValueError(f"block {k} is damaged")
            coded.append(data)
            widths.append(min(BLOCK, footer["total"] - k * BLOCK))
        whole = sum(w == BLOCK for w in widths)
        if whole:
            out.append(decode_blocks(coded[:whole], BLOCK, table).ravel())
        if whole < len(widths):
            out.append(decode_blocks(coded[whole:], -(-widths[-1] // LANES) * LANES, table).ravel()[:widths[-1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counts(kind: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                found = np.bincount(tokens.unpack_bytes(packed, kind))
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])
    return run


def _write(folder: str, kind: np.dtype, freq: np.ndarray):
    names = ["file", "docs", "total", "blocks", "first_doc", "first_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        name = files.new_name(folder, "part", "lrans")
        first = (batch.column(0)[0].as_py(), batch.column(3)[0].as_py())
        docs = 0
        with files.writing(name) as out:
            writer = Writer(out, Table.of(freq))
            while batch is not None:
                docs += batch.num_rows
                for doc, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    writer.add([doc], [n], tokens.unpack_bytes(packed, kind))
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([docs]), pa.array([writer.total]), pa.array([len(writer.blocks)]),
                                          pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64())], names=names)
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text, with `end_id` after it, into files below `folder`; returns the written manifest.

    `docs` has doc_id and text. Documents are in ascending doc_id order over all files, nulls first; rows that share an id
    are neighbours in an order that a rerun repeats. Null and empty texts are the end id alone; an empty table writes an
    empty manifest. The manifest has a row for each file: file, docs, total (ids), blocks, base (ids before it), and the
    table of frequencies in a file of its own named in `table`. Other columns are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "rans")
    path = tokens.tokenizer_path(tokenizer)
    kind = tokens.id_kind(path)
    rows = docs.select(F.xxhash64("text").alias("row"), "doc_id", "text")
    staged = scratch.path("staged")
    rows.mapInArrow(tokens.staged(path, end_id), tokens.STAGED_SQL).write.option("compression", "uncompressed").parquet(staged)
    kept = spark.read.parquet(staged)
    size = max(end_id + 1, tokens.encoder(path).tokenizer.get_vocab_size(with_added_tokens=True))
    counts = np.zeros(size, np.int64)
    for i, n in kept.select("packed").mapInArrow(_counts(kind, size), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    freq = quantise(counts)
    ordered = kept.select("doc_id", "n_tokens", "packed", "row").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    written = ordered.mapInArrow(_write(folder, kind, freq), "file string, docs long, total long, blocks long, first_doc long, first_row long")
    manifest = scratch.keep(written, "written")
    table = files.new_name(folder, "frequencies", "json")
    with files.writing(table) as out:
        out.write(json.dumps({"scale": SCALE, "freq": freq.tolist()}).encode())
    base, rows = 0, []
    # One short row for each file; the number of files follows the number of partitions.
    for r in sorted(manifest.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_row)):
        rows.append((r.file, r.docs, r.total, r.blocks, base, table))
        base += r.total
    from ledgerloom.llm.scratch import delete
    delete(spark, staged)
    return scratch.keep(spark.createDataFrame(rows, "file string, docs long, total long, blocks long, base long, table string"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, Table] = {}
    held = None
    for batch in batches:
        for name, base, table, first, last in zip(*(c.to_pylist() for c in batch.columns)):
            if table not in tables:
                with files.reading(table) as source:
                    tables[table] = Table.of(np.array(json.loads(source.read())["freq"], np.int64))
            with files.reading(name) as source:
                if name != held:
                    footer = read_footer(source)
                    lengths = np.array(footer["lengths"], np.int64)
                    ends = np.cumsum(lengths)
                    starts, held = ends - lengths, name
                # The documents that begin between the two checkpoints, to their ends.
                a, b = np.searchsorted(starts, (first * BLOCK, last * BLOCK))
                step = a
                while step < b:
                    # About as many ids at once as the blocks coded together, or one longer document.
                    stop = min(b, max(step + 1, int(np.searchsorted(ends, starts[step] + BLOCK * TOGETHER, side="right"))))
                    block = int(starts[step]) // BLOCK
                    ids = read_ids(source, footer, block, -(-int(ends[stop - 1]) // BLOCK), tables[table])
                    cut = [ids[s - block * BLOCK:e - block * BLOCK].astype("<u4").tobytes() for s, e in zip(starts[step:stop].tolist(), ends[step:stop].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(footer["docs"][step:stop], pa.int64()), pa.array(base + starts[step:stop]),
                                                      pa.array(lengths[step:stop]), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    step = stop


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit integers.

    Files are read from their checkpoints, TOGETHER blocks a task row, in parallel; damaged files raise an error.
    """
    ranges = (manifest.select("file", "base", "table", F.col("blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(TOGETHER))).alias("first"))
              .select("file", "base", "table", "first", F.least(F.col("first") + TOGETHER, F.col("blocks")).alias("last")))
    # The rows are a few bytes long and stand for megabytes, so the number of tasks follows the blocks and not their bytes.
    blocks = manifest.agg(F.sum("blocks")).first()[0] or 0
    parts = max(1, -(-blocks // BLOCKS_A_TASK))
    # Runs of blocks of one file stay together, so a task reads few footers.
    spread = ranges.repartitionByRange(parts, "base", "file", "first").sortWithinPartitions("base", "file", "first")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
