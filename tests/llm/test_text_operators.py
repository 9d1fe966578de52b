import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import brown, containment, jaccard, quality, sketch, substrings, words


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_join_equals_brute_force(frame, corpus, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(frame(corpus), size, percent).collect()}
    assert got == brute.similar(corpus, size, percent)


def test_join_with_a_crowded_sketch_loses_nothing(frame, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(frame(corpus), 4, 85, most_bits=16).collect()}
    assert got == brute.similar(corpus, 4, 85)


def test_join_with_a_crowded_sketch_still_rules_unique_sets_out(frame, monkeypatch):
    """240,000 elements in 65,536 cells: one sketch of all would call nearly every element repeated."""
    base = [f"w{i}" for i in range(240)]
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(240))) for k in range(1000)] + [(2000 + k, " ".join([f"n{k}", *base])) for k in range(3)]
    kept, keep = {}, jaccard.Scratch.keep

    def counted(self, df, label):
        out = keep(self, df, label)
        kept[label] = out.count()
        return out
    monkeypatch.setattr(jaccard.Scratch, "keep", counted)
    got = {r.doc_id: r.component_id for r in jaccard.join_similar(frame(rows), 4, 85, most_bits=16).collect()}
    assert got == {k: min(k, 2000) for k, _ in rows}
    assert kept["parts"] < 100


def test_join_parts_of_the_sketch():
    assert jaccard.part_count(0, 29, 85) == (1, 1)
    assert jaccard.part_count(1 << 28, 29, 80) == (1, 1)
    for elements in (1 << 29, 1 << 32, 1 << 36):
        for percent in (60, 80, 85, 99):
            parts, asked = jaccard.part_count(elements, 29, percent)
            assert elements <= parts * (1 << 28) and 1 <= asked <= parts
    value = words.mix(np.arange(30_000, dtype=np.uint64))
    assert (abs(np.bincount(jaccard._part(value, 5).astype(int), minlength=5) - 6000) < 400).all()


def test_join_meets_by_enough_short_lists_or_a_long_one(spark):
    """Sets of 100 elements must share four posted ones; chance meetings must not tie clusters together."""
    lists = {e: [1, 2] for e in range(4)} | {e: [2, 3] for e in range(10, 13)} | {20: list(range(40, 40 + jaccard.SHORT + 1))}
    rows = [(d, 100, e, min(held), len(held)) for e, held in lists.items() for d in held]
    rows += [(d, n, e, 50, 2) for e in range(30, 36) for d, n in ((80, 100), (81, 84))]
    got = {(r.a, r.b) for r in jaccard._meetings(spark.createDataFrame(rows, "doc_id long, n long, e long, hub long, held long"), 85).collect()}
    assert got == {(1, 2)} | {(d, 40) for d in range(41, 41 + jaccard.SHORT)}


def test_join_compares_large_groups_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base[:k % 17], f"n{k}", *base[k % 17 + 1:100 + k % 3]])) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(frame(rows), 4, 85).collect()}
    assert got == brute.similar(rows, 4, 85)


def test_join_odd_rows(frame):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "A B C D E"), (5, None), (5, ""), (9, "q r")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join_similar(frame(rows), 4, 85).collect())
    assert got == [(False, 3, 2, 3), (False, 5, 0, 5), (False, 5, 0, 5), (False, 7, 2, 3), (False, 7, 2, 3), (False, 9, 1, 9), (True, 0, 2, None)]
    assert jaccard.join_similar(frame([])).count() == 0


def test_join_ships_only_sets_that_meet_others(spark):
    near = spark.createDataFrame([(k * 7919,) for k in range(300)], "node long")
    sets = spark.createDataFrame([(k, b"x") for k in range(0, 300 * 7919, 791)] + [(k * 7919, b"y") for k in range(300)] + [(None, b"z")],
                                 "node long, elements binary")
    marks = spark.sparkContext.broadcast(sketch.merge(near.mapInArrow(jaccard._mark(16), sketch.SCHEMA), 16, 1, (1,)))
    got = [(r.node, bytes(r.elements)) for r in sets.mapInArrow(jaccard._marked(16, marks), "node long, elements binary").collect()]
    assert {k for k, e in got if e == b"y"} == {k * 7919 for k in range(300)}
    assert len(got) < 400 and all(k is not None for k, _ in got)


def test_subsets_and_bounds():
    for n in range(1, 20):
        assert len(jaccard.subset_codes(np.arange(n, dtype=np.uint64), 85)) == jaccard.light_rows(n, 85)
        for m in range(n, 25):
            share = jaccard.least_share(n, m, 85)
            assert 100 * share >= 85 * (n + m - share) and 100 * (share - 1) < 85 * (n + m - share + 1)
    assert jaccard.light_bound({}, 85) >= jaccard.light_bound({20: 5}, 85) > 0


@pytest.mark.parametrize("width", [20, 5])
def test_repeats_equal_brute_force(frame, corpus, width):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(corpus), width).collect()}
    assert got == brute.without_repeats(corpus, width)


def test_repeats_with_a_crowded_sketch_lose_nothing(frame, corpus, monkeypatch):
    monkeypatch.setattr(substrings.sketch, "bits_for", lambda items, most: 16)
    monkeypatch.setattr(words, "SLICE_BYTES", 2000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(corpus), 20).collect()}
    assert got == brute.without_repeats(corpus, 20)


def test_repeats_odd_rows(frame):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(None, long), (4, long), (4, long), (2, None), (1, "")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.remove_repeats(frame(rows), 20).collect())
    assert got == [(-1, 25, 0), (1, 0, 0), (2, 0, 0), (4, 25, 25), (4, 25, 25)]
    twice = substrings.remove_repeats(frame([(4, long), (4, long)]), 20, carry=["lang"]).collect()
    assert [(r.n_removed, r.lang) for r in twice] == [(0, "xx")] * 2
    assert substrings.remove_repeats(frame([])).count() == 0


def test_repeats_of_rows_that_share_or_lack_an_id(spark, frame):
    """Each row loses its own words only: also without a key, and repeated rows are removed with one."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*(f"r{k}x{i}" for i in range(int(rng.integers(0, 60)))), *(passage if k % 3 else []), *(f"t{k}x{i}" for i in range(25))]) for k in range(30)]
    ids = [(None, 5, 5, k)[k % 4] for k in range(30)]
    least = -10 ** 6  # stands for null, which counts as the smallest
    rows = [(d, t, k) for k, (d, t) in enumerate([*zip(ids, texts), (None, texts[0]), (5, texts[1])])]
    keyed = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = {r.key: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(keyed, 20, carry=["key"], key="key").collect()}
    want = brute.without_repeats([((least if d is None else d, k), t) for d, t, k in rows], 20)
    assert got == {k: v for (_, k), v in want.items()} and got[30][1] == got[30][0] and got[31][2] == ""
    plain = substrings.remove_repeats(frame([(d, t) for d, t, k in rows[:30]]), 20).collect()
    assert len(plain) == 30 and sum(r.n_removed for r in plain) == 30 * (sum(k % 3 > 0 for k in range(30)) - 1)


def test_contained_items_equal_brute_force(spark, frame, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 3]
    cut = [" ".join(t.split()[:30]) for t in texts[:25]] + [" ".join(t.split()[2:40]) + " zzz yyy" for t in texts[25:50]]
    items = list(enumerate(cut + ["word", "One two", "", None, " ".join(["again"] * 9), cut[0]]))
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in containment.contained_items(frame(corpus), table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.contained(corpus, items, 5, 80)


def test_contained_items_in_blocks(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_BYTES", 500)
    items = list(enumerate(t for _, t in corpus[:15]))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in containment.contained_items(frame(corpus), table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.contained(corpus, items, 5, 80)


def test_contained_items_odd_rows(spark, frame):
    items = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (2, None)], "item_id long, text string")
    got = containment.contained_items(frame([(None, "x A b C y"), (3, None), (3, "a b c")]), items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    assert containment.contained_items(frame([(1, "a")]), items.limit(0)).count() == 0
    assert containment.contained_items(frame([]), items).count() == 0


def test_model_scores(spark, corpus):
    rows = [(d, t, d % 70 == 20) for d, t in corpus]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held_out boolean, score double")
    want = brute.base_scores(rows)
    got = brown.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and np.isfinite(r.score) and r.score <= 0


def test_model_is_a_distribution(spark):
    """After one history, the probabilities of all known words, the end and one unknown word sum to 1."""
    rows = [(k, " ".join(["a b c", "d e", "a c e f"][k % 3].split() * 3), False) for k in range(40)]
    tests = [(1000 + k, f"a {w}", True) for k, w in enumerate(["a", "b", "c", "d", "e", "f", "never"])] + [(2000, "a", True)]
    docs = spark.createDataFrame(rows + tests, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in brown.score(docs).where("doc_id >= 1000").collect()}
    # P(a x end) / P(x end | ...) is not at hand, so take texts apart by the chain rule: the end after each core word.
    end = got[2000]
    assert end < 0 and all(got[1000 + k] < 0 for k in range(7))
    assert got[1006] < min(got[1000 + k] for k in range(6))


def test_model_odd_tables(spark):
    kind = "doc_id long, text string, held_out boolean"
    assert brown.score(spark.createDataFrame([], kind)).count() == 0
    none = brown.score(spark.createDataFrame([(1, "a b", True), (None, None, None)], kind)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in none) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r.score == pytest.approx(0.0, abs=1e-6) for r in none)


def test_exchange_gain_is_exact_without_self_pairs():
    rng = np.random.default_rng(3)
    old, brown.CLASSES = brown.CLASSES, 4
    try:
        pairs = rng.integers(0, 6, (9, 8)).astype(float)
        pairs[np.arange(8), np.arange(8)] = 0
        classes = np.append(np.arange(8) % 4, 4)

        def matrix(c):
            m = np.zeros((5, 4))
            np.add.at(m, (c[:, None], c[None, :-1]), pairs)
            return m

        right = np.bincount(classes[:-1], pairs[2], 4)
        left = np.bincount(classes, pairs[:, 2], 5)
        tries = []
        for c in range(4):
            moved = classes.copy()
            moved[2] = c
            tries.append(brown.likelihood(matrix(moved)))
        best = brown.best_class(matrix(classes), classes[2], right, left)
        assert tries[best] >= max(tries) - 1.0
    finally:
        brown.CLASSES = old


def test_quality_learns_and_ignores_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0")
    w = quality.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"), rounds=4)
    got = {r.doc_id: r.score for r in quality.score(docs, w).collect()}
    right = [(got[r.doc_id] >= 0.3) == (r.quality == 1) for r in held.collect()]
    assert len(got) == docs.count() and np.mean(right) > 0.85
    assert all(0 <= s <= 1 for s in got.values())


def test_quality_odd_rows(spark, frame):
    rows = [(1, "good words here"), (2, None), (3, ""), (None, "x y"), (1, "good words here")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 0), (1, 1, 0), (8, 7, 0)], "doc_id long, quality int, toxic int")
    w = quality.fit(frame(rows), labels)
    got = quality.score(frame(rows), w, carry=["lang"]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.lang == "xx" for r in got)
    assert not quality.fit(frame([]), labels).any()
    assert quality.score(frame([]), w).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé. ", max_size=30)), max_size=8), st.integers(1, 4))
def test_words_and_shingles(texts, size):
    data, offsets = words.buffer_of(pa.array(texts, pa.string()))
    w = words.split(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in brute.words(t, lower=False)]
    value, first = words.by_row(*words.shingles(data, w, size), len(texts))
    assert [int(n) for n in np.diff(first)] == [len(brute.shingles(t, size)) for t in texts]


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer((" ".join(f"w{i}" for i in range(3000)) + " " + "y" * 4000).encode(), np.uint8)
    w = words.split(data, np.array([0, len(data)]))
    whole = words.hashes(data, w)
    monkeypatch.setattr(words, "CHUNK", 1 << 8)
    assert (words.hashes(data, w) == whole).all() and len(np.unique(whole)) == 3001


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    items = np.concatenate([items, items[:500], items[:40], items[:40]])
    parts = np.array_split(items, 3)

    def send(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held = sketch.Collector(17, 2)
                held.add(parts[k])
                yield held.rows()

    maps = sketch.merge(spark.range(3).mapInArrow(send, sketch.SCHEMA), 17, 2, (2, 4))
    assert sketch.reaches(maps, items[:500], 17).all() and sketch.reaches(maps, items[:40], 17, 1).all()
    assert sketch.reaches(maps, items[500:3000], 17).mean() < 0.05
