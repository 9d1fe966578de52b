"""Token ids of many texts by a public tokenizer file, with a cache of text segments in each Python worker.

Texts are cut where the tokenizer's own first split is sure to fall, so the ids of the segments in a row are the ids of
the text. Equal segments (by 64-bit hash) are encoded once by the library; the rest is numpy. The cache is cleared when
it is full. Texts whose white space is not of single characters go through the library whole where that matters.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ledgerloom.llm import words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MOST_SEGMENTS = 1_000_000
SLICE = 3 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
#: First bytes of white space beyond ASCII in UTF-8, and control characters that some call white space.
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes that begin white space beyond ASCII."""
    out = _ODD[data]
    second = np.append(data[1:], 0)
    third = np.append(data[2:], (0, 0))[:len(data)]
    out |= (data == 0xC2) & ((second == 0x85) | (second == 0xA0))
    out |= (data == 0xE1) & (second == 0x9A) & (third == 0x80)
    out |= (data == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    out |= (data == 0xE2) & (second == 0x81) & (third == 0x9F)
    return out | (data == 0xE3) & (second == 0x80) & (third == 0x80)


class Encoder:
    """`spaces`: whether a token may begin with the space before a word; otherwise white space only separates.

    Special tokens' strings inside a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.spaces = self._plain(" b") != self._plain("b")
        self.folds = self._plain("A") == self._plain("a")
        self.mark = "\n" if self.spaces else " ~ "
        mark = self._plain(self.mark)
        self.mark_id = mark[0] if len(mark) == 1 else None
        self._clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the segments; rows marked odd become one segment each."""
        blank = words._SEPARATOR[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        last = first[1:]
        before = np.append(True, blank[:-1]) | first[:-1]
        after = np.append(blank[1:], True) | last
        stop = _STOP[data] & after & np.append(False, _LETTER[data[:-1]]) & ~first[:-1]
        if not self.spaces:
            begin = np.flatnonzero((~blank & before) | stop)
            end = np.flatnonzero((~blank & after) | np.append(stop[1:], False)) + 1
            return begin, end
        # The space before a word belongs to it; any other white space stands alone. Every byte is in one segment.
        joins = np.append(False, (data[:-1] == 32)) & ~first[:-1] & ~blank
        begins = (blank | before | stop) & ~joins | first[:-1]
        for i in np.flatnonzero(odd).tolist():
            begins[offsets[i]:offsets[i + 1]] = False
            begins[offsets[i]] = True
        begin = np.flatnonzero(begins)
        return begin, np.append(begin[1:], n)

    def _alone(self, segment: str) -> bool:
        """Whether the ids of a segment stay the same between marks, and hold no mark."""
        core = segment[1:] if self.spaces and segment[0] == " " else segment
        return core.split() == [core] if self.spaces else "~" not in segment

    def _learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments in a row, and their numbers: most as one text with marks between, sparing calls."""
        alone = np.array([self.mark_id is not None and self._alone(x) for x in segments], bool)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(segments)
        joined = np.flatnonzero(alone).tolist()
        for i in range(0, len(joined), 5_000):
            part = joined[i:i + 5_000]
            text = self.mark.join([segments[j] for j in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer does not keep marks apart")
            for j, a, b in zip(part, [0] + [e + 1 for e in ends[:-1]], ends):
                out[j] = ids[a:b]
        single = np.flatnonzero(~alone).tolist()
        for j, found in zip(single, self.tokenizer.encode_batch_fast([segments[j] for j in single], add_special_tokens=False)):
            out[j] = np.array(found.ids, self.kind)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null is empty."""
        data, offsets = words.buffer_of(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        odd = np.zeros(rows, bool)
        if self.spaces:
            blank = words._SEPARATOR[data]
            pair = blank[:-1] & blank[1:]
            bad = _odd_space(data)
            bad[1:] |= pair
            # A pair over two texts marks the second one, which is only slower.
            odd[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
        if self.folds:
            data = words._LOWER[data]
        begin, end = self._cut(data, offsets, odd)
        h = words.hashes(data, words.Words(begin, end, begin, offsets), lower=False)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) + len(unique) > MOST_SEGMENTS:
            self._clear()
        keys = unique.tolist()
        place = np.array([self.place.get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            raw = data.tobytes()
            spans = zip(begin[at[missing]].tolist(), end[at[missing]].tolist())
            ids, lengths = self._learn([raw[a:b].decode() for a, b in spans])
            known = len(self.length)
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(lengths) - lengths)
            self.length = np.append(self.length, lengths)
            self.flat = np.append(self.flat, ids)
            place[missing] = known + np.arange(len(missing))
            self.place.update(zip([keys[i] for i in missing.tolist()], place[missing].tolist()))
        place = place[inverse]
        lengths = self.length[place]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.begin[place] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.append(0, ends)[np.searchsorted(begin, offsets)]
        return ids, np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def id_kind(path: str) -> np.dtype:
    return encoder(path).kind


def ids_of(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in a row, each with the end id after it, and their numbers."""
    own = encoder(path)
    ids, n = own.encode(texts)
    ends = np.cumsum(n + 1) - 1
    out = np.empty(len(ids) + len(n), own.kind)
    out[ends] = end_id
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return out, n + 1


def pack_bytes(ids: np.ndarray) -> bytes:
    """Smaller bytes for shuffles and staging: byte planes, then zstd."""
    import zstandard
    planes = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, ids.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_bytes(packed: bytes, kind: np.dtype) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


STAGED_SQL = "row long, doc_id long, n_tokens long, packed binary"


def staged(path: str, end_id: int, place=None):
    """For mapInArrow over (row, doc_id, text): rows of STAGED_SQL; `place` adds a column of longs made from the text."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("packed", pa.binary())]
    schema = pa.schema(fields + ([("place", pa.int64())] if place else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, size=SLICE):
            ids, n = ids_of(path, batch.column(2), end_id)
            ends = np.cumsum(n)
            columns = [batch.column(0), batch.column(1), pa.array(n),
                       pa.array([pack_bytes(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())], pa.binary())]
            if place:
                columns.append(pa.array(place(batch.column(2))))
            yield pa.record_batch(columns, schema=schema)
    return run
