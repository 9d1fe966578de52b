"""Tree search against brute force: exact when every leaf is met, a measured share of the neighbours otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import nearest, queries

VEC = "vec_id long, embedding array<double>, label int, score double, vector string, rank int"


def usable(i, v):
    return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, asked, k):
    """Exact answers of each asked row, as sorted lists of (rank, vec_id, score) by id; rows may share ids."""
    good = [(i, np.array(v, float)) for i, v in rows if usable(i, v)]
    out = []
    for a, (i, v) in enumerate(good):
        if asked(i):
            with np.errstate(all="ignore"):
                far = sorted((float(np.sqrt(np.cumsum((w - v) ** 2)[-1])), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(far[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, "x", 9) for i, v in rows], VEC)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 8)) * 4
    rows = [(int(i), (centres[rng.integers(25)] + rng.normal(size=8)).tolist()) for i in range(2500)]
    rows += [(3000 + i, rows[40][1]) for i in range(600)]
    rows += [(4000 + i, [float(i % 5), 1.0, -2.0]) for i in range(90)]
    rows += [(i, v) for i, v in rows[:20]]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [None, 1.0]), (5004, [float("nan")] * 8), (5005, [float("inf")] + [1.0] * 7),
             (None, [1.0] * 8), (5100, [1e200] * 8), (5101, [1e200] * 7 + [2e200]), (5102, [-0.0, 1.0] + [0.0] * 6), (5200, [0.0, 1.0] + [0.0] * 6), (5300, [3.0] * 20)]
    return rows


def test_all_leaves_give_the_exact_answer(spark, rows):
    got = nearest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 10, visits=10**6)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, 10)


def test_recall_is_reached_without_meeting_all_leaves(spark, rows, caplog):
    with caplog.at_level("INFO", "ledgerloom.llm.nearest"):
        got = nearest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 10, recall=0.95).collect()
    met = [r.args for r in caplog.records if r.args and r.args[0] == 8][-1]
    assert met[1] < met[2] / 2
    want = plain(rows, lambda i: i % 10 == 0, 10)
    found, true = {(r["query_id"], r["vec_id"]) for r in got}, {(q, v) for q, _, v, _ in want}
    assert len(found & true) >= 0.9 * len(true)
    score = {(q, v): s for q, _, v, s in want}
    assert all(score.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] for r in got)


def test_hot_cells_are_cut_and_nothing_is_lost(spark, rows, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_BYTES", 2048)
    got = nearest.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, visits=10**6)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 50 == 0, 5)


def test_few_or_no_rows(spark, tmp_path):
    assert nearest.nearest(frame(spark, []), F.lit(True)).collect() == []
    assert nearest.nearest(frame(spark, [(1, None)]), F.lit(True)).collect() == []
    assert nearest.nearest(frame(spark, [(1, [1.0, 2.0])]), F.lit(True)).collect() == []
    two = frame(spark, [(100, [1.0, 2.0]), (7, [4.0, 6.0])])
    two.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()] == [(100, 1, 7, 5.0)]


def test_walk_takes_leaves_out_nearest_first_and_misses_none():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 3))
    tree = nearest.fit(vectors, 40)
    leaf = tree.assign(vectors)
    assert tree.leaves <= 40 and set(leaf.tolist()) == set(range(tree.leaves))
    for v, own in zip(vectors[:50], leaf):
        walk = tree.walk(v, tree.leaves)
        assert walk[0] == own and sorted(walk) == list(range(tree.leaves))
