"""Ranked lexical search by Block-Max MaxScore over an index in segments.

A segment is the inverted index of one slice of documents: sorted term hashes, and for each term blocks of postings,
compressed by gaps in as few bytes as the block needs. A block keeps its last document and the (occurrences, length)
pairs that no other pair of the block beats, so its greatest score is exact for any corpus statistics, and the index
doesn't depend on them.

A task searches the segments of its part, its shard, one after the other and carries the best rows of each item along.
Terms are ordered by their global bound, the greatest score in any document of any shard. Those whose bounds together
stay below the item's present threshold are non-essential: documents are taken from the other lists only. The
non-essential lists follow, greatest bound first; a candidate whose score so far, the greatest score of its block and the
bounds of the remaining lists stay below the threshold is dropped before the block is decompressed. Shards' best rows
are merged at the end. Nothing is lost: a bound is never below a score, and equal scores are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import words
from ledgerloom.llm.scratch import Scratch

SEGMENT_BYTES = 2 << 20
#: Segments of a file of the index.
FILE_SEGMENTS = 8
BLOCK = 64
#: Bytes of items searched in one pass.
ITEM_BYTES = 8 << 20
#: Fixed values of the score: 25 of 100 parts of the norm follow the length.
SCALE, FIXED, RELATIVE, SATURATION = 1_000_000_000, 75, 25, 12
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False

#: Arrays of a segment: by document, by term (`begin` holds an end too), by block, by impact, then the postings.
_ARRAYS = {"lengths": "<i4", "terms": "<u8", "begin": "<i4", "df": "<i4", "last": "<i4", "at": "<i8", "held": "u1", "widths": "u1",
           "impact": "<i4", "best_tf": "<i4", "best_n": "<i4", "body": "u1"}
_SEGMENT = pa.schema([("docs", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), *((a, pa.binary()) for a in _ARRAYS)])
_SEGMENT_SQL = "docs long, total long, ids array<long>, " + ", ".join(f"{a} binary" for a in _ARRAYS)
_BOUNDS = ["terms", "begin", "df", "impact", "best_tf", "best_n"]
_HIT = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(column: pa.Array) -> tuple[words.Words, np.ndarray]:
    """Terms of the texts and their hashes: runs of ASCII letters and digits and of anything beyond ASCII."""
    data, offsets = words.buffer_of(column)
    found = words.split(data, offsets, _SEPARATOR)
    return found, words.hashes(data, found, lower=True)


def _width(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes that the largest value of each block needs: 1, 2 or 4."""
    top = np.maximum.reduceat(values, first)
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def _spread(values: np.ndarray, place: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    for k in range(4):
        some = width > k
        out[place[some] + k] = (values[some] >> (8 * k)) & 255


def segment(ids: pa.Array, texts: pa.Array) -> dict:
    """The index of some documents, as arrays by name."""
    found, h = terms_of(texts)
    rows, n = len(texts), found.counts
    terms, code = np.unique(h, return_inverse=True)
    posting, tf = np.unique(code * rows + found.row, return_counts=True)
    term, doc = posting // max(rows, 1), posting % max(rows, 1)
    df = np.bincount(term, minlength=len(terms))
    start = np.cumsum(df) - df
    place = np.arange(len(doc)) - start[term]
    first = np.flatnonzero(place % BLOCK == 0)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    held = np.bincount(block, minlength=len(first))
    gap = doc.copy()
    gap[1:] -= np.where(place[1:] % BLOCK == 0, 0, doc[:-1])
    if len(first):
        wide, heavy = _width(gap, first), _width(tf, first)
        size = held * (wide + heavy)
        at = np.cumsum(size) - size
        body = np.zeros(int(size.sum()), np.uint8)
        inner = np.arange(len(doc)) - first[block]
        _spread(gap, at[block] + inner * wide[block], wide[block], body)
        _spread(tf, at[block] + held[block] * wide[block] + inner * heavy[block], heavy[block], body)
    else:
        wide = heavy = at = np.zeros(0, np.int64)
        body = np.zeros(0, np.uint8)
    # Pairs that no pair with as many occurrences in as short a document beats.
    order = np.lexsort((n[doc], -tf, block))
    far = int(n.max(initial=0)) + 1
    fall = n[doc][order] - block[order] * far
    before = np.append(far, np.minimum.accumulate(fall)[:-1]) if len(fall) else fall
    best = order[fall < before]
    begin = np.append(block[start], len(first))
    return {"docs": int((n > 0).sum()), "total": int(n.sum()), "ids": ids, "lengths": n, "terms": terms, "begin": begin, "df": df,
            "last": doc[np.append(first[1:], len(doc)) - 1] if len(first) else doc, "at": np.append(at, len(body)), "held": held, "widths": wide * 16 + heavy,
            "impact": np.searchsorted(block[best], np.arange(len(first) + 1)), "best_tf": tf[best], "best_n": n[doc][best], "body": body}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, size=SEGMENT_BYTES):
        s = segment(batch.column(0), batch.column(1))
        yield pa.record_batch(
            [pa.array([s["docs"]]), pa.array([s["total"]]), pa.array([s["ids"].to_pylist()], pa.list_(pa.int64())),
             *(pa.array([s[a].astype(kind).tobytes()], pa.binary()) for a, kind in _ARRAYS.items())], schema=_SEGMENT)


@dataclass
class Corpus:
    """Documents with a term, and all terms of all documents."""

    docs: int
    total: int

    def norm(self, n: np.ndarray) -> np.ndarray:
        return FIXED + (RELATIVE * n.astype(np.int64) * self.docs) // self.total

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (1000 * tf + SATURATION * norm)


def _arrays(batch: pa.RecordBatch, names: list[str], row: int) -> dict[str, np.ndarray]:
    return {a: np.frombuffer(batch.column(batch.schema.get_field_index(a))[row].as_buffer(), _ARRAYS[a]) for a in names}


def _find(terms: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked hash among sorted terms, -1 where it isn't there."""
    if not len(terms):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    return np.where(terms[at] == asked, at, -1)


def _term_bounds(corpus: Corpus, asked):
    """(term, df, bound) of the asked terms in each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = _arrays(batch, _BOUNDS, row)
                at = _find(s["terms"], asked.value)
                term = np.flatnonzero(at >= 0)
                at = at[term]
                if not len(at):
                    continue
                value = impact(s["best_tf"], corpus.norm(s["best_n"]))
                top = np.maximum.reduceat(value, s["impact"][s["begin"][:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(s["df"][at].astype(np.int64)), pa.array(top[at])], names=["term", "df", "bound"])
    return run


class _Segment:
    """A segment under search; lists and blocks that were decompressed are kept for the items that follow."""

    def __init__(self, batch: pa.RecordBatch, row: int, corpus: Corpus, asked: np.ndarray) -> None:
        self.__dict__.update(_arrays(batch, list(_ARRAYS), row))
        ids = batch.column(batch.schema.get_field_index("ids"))[row].values
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.norm = corpus.norm(self.lengths)
        self.place = _find(self.terms, asked)
        top = impact(self.best_tf, corpus.norm(self.best_n))
        self.top = np.maximum.reduceat(top, self.impact[:-1]) if len(top) else top
        self.score, self.taken = np.zeros(len(self.norm), np.int64), np.zeros(len(self.norm), bool)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores of weight 1) of a block."""
        known = self.blocks.get(b)
        if known is None:
            self.read += 1
            wide, heavy, held, at = int(self.widths[b]) >> 4, int(self.widths[b]) & 15, int(self.held[b]), int(self.at[b])
            doc = np.cumsum(np.frombuffer(self.body, f"<u{wide}", held, at), dtype=np.int64)
            tf = np.frombuffer(self.body, f"<u{heavy}", held, at + held * wide)
            known = self.blocks[b] = doc, impact(tf, self.norm[doc])
        return known

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.lists.get(t)
        if known is None:
            parts = [self.block(b) for b in range(self.begin[t], self.begin[t + 1])]
            known = self.lists[t] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return known

    def best(self, item: list[tuple[int, int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score `least` or more. `item`: (term, weight, bound), least bound first."""
        below = np.cumsum([0] + [bound for _, _, bound in item])
        essential = int(np.searchsorted(below[1:], least, side="left"))
        for term, weight, _ in item[essential:]:
            t = self.place[term]
            if t >= 0:
                doc, value = self.whole(t)
                self.score[doc] += weight * value
                self.taken[doc] = True
        docs = np.flatnonzero(self.taken)
        score = self.score[docs]
        self.score[docs], self.taken[docs] = 0, False
        for i in range(essential - 1, -1, -1):
            keep = score + below[i + 1] >= least
            docs, score = docs[keep], score[keep]
            t = self.place[item[i][0]]
            if not len(docs):
                break
            if t < 0:
                continue
            weight, low, high = item[i][1], self.begin[t], self.begin[t + 1]
            at = low + np.searchsorted(self.last[low:high], docs)
            inside = at < high
            hope = np.where(inside, weight * self.top[np.minimum(at, high - 1)], 0)
            keep = score + hope + below[i] >= least
            docs, score, at, inside = docs[keep], score[keep], at[keep], inside[keep]
            for b in np.unique(at[inside]).tolist():
                doc, value = self.block(b)
                who = np.flatnonzero(at == b)
                spot = np.minimum(np.searchsorted(doc, docs[who]), len(doc) - 1)
                score[who] += np.where(doc[spot] == docs[who], weight * value[spot], 0)
        keep = score >= least
        return docs[keep], score[keep]


def _search(corpus: Corpus, k: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, items = sent.value
        none = np.zeros(0, np.int64)
        held = [(none, none, none.astype(bool))] * len(items)
        for batch in batches:
            for row in range(batch.num_rows):
                part = _Segment(batch, row, corpus, asked)
                if not len(part.terms):
                    continue
                for i, (_, terms) in enumerate(items):
                    score, ids, known = held[i]
                    docs, found = part.best(terms, int(score[-1]) if len(score) >= k else 1)
                    if not len(docs):
                        continue
                    score, ids, known = np.append(score, found), np.append(ids, part.ids[docs]), np.append(known, part.known[docs])
                    order = np.lexsort((ids, ~known, -score))[:k]
                    held[i] = score[order], ids[order], known[order]
        for (name, _), (score, ids, known) in zip(items, held):
            if len(score):
                yield pa.record_batch([pa.array(np.full(len(score), name, np.int64)), pa.array(ids, mask=~known), pa.array(score)], schema=_HIT)
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, h = terms_of(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h[a:b].view(np.int64) for a, b in zip(found.first[:-1], found.first[1:])], pa.list_(pa.int64()))], names=["item", "terms"])


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments of all documents, written in files of few, whatever the size of the tasks."""
    return scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, _SEGMENT_SQL), "index", FILE_SEGMENTS)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the greatest scores above 0.

    `docs` has doc_id and text, `items` item_id and text. Terms are runs of ASCII letters and digits and of anything beyond
    ASCII, A-Z lower-cased. Equal scores come by doc_id, null last.

    Null texts have no terms; documents without terms count nowhere and items without terms get no rows. Rows that share
    an id are documents or items of their own. Empty tables give no rows; other columns are dropped. Items are searched
    in blocks of at most ITEM_BYTES of text (or one longer item), each sent to all tasks and searched in a pass of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = build_index(docs, scratch)
    corpus = Corpus(*index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())
    asked_for = scratch.keep(items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("item")), "items")
    whole = asked_for.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    if not corpus.total or not whole:
        return out
    count = 1 if whole <= ITEM_BYTES else -(-2 * whole // ITEM_BYTES)
    hits = None
    for block in range(count):
        part = asked_for.where(F.pmod(F.xxhash64("item"), F.lit(count)) == block).select("item", "text")
        wanted = [(r["item"], np.array(r["terms"], np.int64).view(np.uint64)) for r in part.mapInArrow(_item_terms, "item long, terms array<long>").toLocalIterator()]
        wanted = [(item, terms) for item, terms in wanted if len(terms)]
        if not wanted:
            continue
        asked = np.unique(np.concatenate([terms for _, terms in wanted]))
        bounds = index.select(*_BOUNDS).mapInArrow(_term_bounds(corpus, spark.sparkContext.broadcast(asked)), "term long, df long, bound long")
        known = {r["term"]: (corpus.weight(r["df"]), r["bound"]) for r in bounds.groupBy("term").agg(F.sum("df").alias("df"), F.max("bound").alias("bound")).toLocalIterator()}
        plans = []
        for item, terms in wanted:
            term, repeats = np.unique(np.searchsorted(asked, terms), return_counts=True)
            scored = [(int(t), int(r) * known[t][0], int(r) * known[t][0] * known[t][1]) for t, r in zip(term.tolist(), repeats) if t in known]
            plans.append((item, sorted((p for p in scored if p[2] > 0), key=lambda p: (p[2], p[0]))))
        found = index.mapInArrow(_search(corpus, k, spark.sparkContext.broadcast((asked, plans))), "item long, doc_id long, score long")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return out
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked_for.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
