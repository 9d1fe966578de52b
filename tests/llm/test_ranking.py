"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ranking

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower() if (text or "").isascii() else
                        bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) of the best documents, from scores of all."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = terms(text)
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in asked if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ÉTÉ", "x1", "日本"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, weight, k=n))

    rows = [(i, text(rng.choice([1, 3, 20, 60, 300]))) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [(None, text(30)), (None, text(30)), (5, text(30)), (6, rows[6][1])]
    rows += [(3000, ""), (3001, None), (3002, "?! \x00 ~"), (3003, text(40_000)), (3004, "W1 " * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def items(docs):
    rng = random.Random(9)
    texts = [t for _, t in docs if t and len(t) < 3000]
    rows = [(i, " ".join(rng.choice(texts).split()[:rng.choice([1, 4, 30])])) for i in range(60)]
    return rows + [(7, "w1 W1 w1 w3"), (None, "w2 été"), (100, ""), (101, None), (102, "nothing known"), (103, "w399"), (104, "日本 x1, ÉTÉ")]


def ran(spark, frame, docs, items, k):
    asked = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, item int, rank string")
    return sorted(map(tuple, ranking.search(frame(docs).repartition(3), asked, k).collect()), key=repr)


@pytest.mark.parametrize("segment_bytes, block, k", [(2 << 20, 64, 20), (20_000, 4, 3)])
def test_search_equals_scoring_every_document(spark, frame, docs, items, monkeypatch, segment_bytes, block, k):
    monkeypatch.setattr(ranking, "SEGMENT_BYTES", segment_bytes)
    monkeypatch.setattr(ranking, "BLOCK", block)
    assert ran(spark, frame, docs, items, k) == plain(docs, items, k)


def test_items_in_several_passes(spark, frame, docs, items, monkeypatch):
    monkeypatch.setattr(ranking, "ITEM_BYTES", 3000)
    assert ran(spark, frame, docs[:300], items, 5) == plain(docs[:300], items, 5)


def test_a_file_of_the_index_holds_few_segments(spark):
    """A reader takes thousands of rows of a file at once, and a segment has megabytes."""
    docs = spark.range(0, 20, 1, 1).selectExpr("id as doc_id", "repeat('word ', 300000) as text")
    index = ranking.build_index(docs, ranking.Scratch(spark, "ranking"))
    held = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 20 and max(held) <= ranking.FILE_SEGMENTS < 20


def test_empty_tables(spark, frame, docs, items):
    assert ran(spark, frame, [], items, 5) == []
    assert ran(spark, frame, docs[:50], [], 5) == []
    assert ran(spark, frame, [(1, None), (2, "!")], items, 5) == []


def test_blocks_of_nonessential_lists_are_left_compressed():
    """A document that fits well sets the threshold; the blocks of the frequent term need not be read then."""
    texts = ["common rare rare rare"] + ["common filler " + "pad " * 50] * 999
    s = ranking.segment(pa.array(range(1000)), pa.array(texts))
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(1000))], pa.list_(pa.int64())), *(pa.array([s[a].astype(k).tobytes()], pa.binary()) for a, k in ranking._ARRAYS.items())],
                                       names=["ids", *ranking._ARRAYS])
    _, asked = ranking.terms_of(pa.array(["common rare"]))
    asked = np.sort(asked)
    corpus = ranking.Corpus(s["docs"], s["total"])
    part = ranking._Segment(batch, 0, corpus, asked)
    item = []
    for t in range(2):
        weight = max(1, corpus.weight(int(s["df"][part.place[t]])))
        low, high = part.begin[part.place[t]], part.begin[part.place[t] + 1]
        item.append((t, weight, int(weight * part.top[low:high].max())))
    item.sort(key=lambda x: x[2])
    docs, score = part.best(item, item[0][2] + 1)
    assert docs.tolist() == [0] and score[0] > item[0][2]
    assert part.read == 2 and len(part.held) > 16


def test_compressed_blocks_come_back():
    rng = np.random.default_rng(0)
    texts = [" ".join(["a"] * int(rng.choice([0, 1, 300, 70_000], p=[0.3, 0.5, 0.19, 0.01])) + ["b"]) for _ in range(700)]
    s = ranking.segment(pa.array(range(700)), pa.array(texts))
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(700))], pa.list_(pa.int64())), *(pa.array([s[a].astype(k).tobytes()], pa.binary()) for a, k in ranking._ARRAYS.items())],
                                       names=["ids", *ranking._ARRAYS])
    corpus = ranking.Corpus(s["docs"], s["total"])
    part = ranking._Segment(batch, 0, corpus, s["terms"])
    for word in ("a", "b"):
        t = int(np.flatnonzero(s["terms"] == ranking.terms_of(pa.array([word]))[1][0])[0])
        docs, score = part.whole(t)
        held = [(i, x.split().count(word)) for i, x in enumerate(texts) if word in x.split()]
        assert docs.tolist() == [i for i, _ in held]
        assert score.tolist() == ranking.impact(np.array([c for _, c in held]), part.norm[docs]).tolist()
        tops = [int(score[docs.searchsorted(0) + k * ranking.BLOCK:][:ranking.BLOCK].max()) for k in range(-(-len(docs) // ranking.BLOCK))]
        assert part.top[part.begin[t]:part.begin[t + 1]].tolist() == tops
