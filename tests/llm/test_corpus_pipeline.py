import random
from collections import Counter

import brute
import pytest

import corpus_pipeline as cp
from ledgerloom.llm import jaccard, tokens

KIND = "doc_id long, text string, lang string, source string, n_chars long, row_key long"
LEAST = -10 ** 6


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, key): ids repeated and null, among copies, near copies, shared passages and leaked items."""
    rng = random.Random(5)

    def text(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]

    passage, item, base = text(25), text(12), text(60)
    texts = [base, base, base[:-1] + ["x"], base + ["y"], text(30) + passage + text(30), text(30) + passage + text(30), text(40), text(40),
             text(30) + item + text(9), text(30), text(35) + item, text(33) + passage, text(28), base, [], text(45) + passage + text(5)]
    ids = [None, None, 7, 7, None, 7, 7, None, None, None, 9, 9, 9, 11, None, 11]
    return [(d, " ".join(t), k) for k, (d, t) in enumerate(zip(ids, texts))], " ".join(item)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(1, rows[1]), (2, None)], "item_id long, text string").write.parquet(f"{found}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{found}/labels.parquet")
    frame(spark, rows[0]).drop("row_key").coalesce(1).write.parquet(f"{found}/documents.parquet")
    return found


def frame(spark, rows):
    made = spark.createDataFrame([(d, t, "xx", "s", len(t), k) for d, t, k in rows], KIND)
    return made.withColumn("row_key", made["row_key"].alias("row_key", metadata=cp.MARK))


def test_a_column_of_the_users_named_like_the_key_is_no_key(spark, tmp_path):
    texts = [" ".join(f"w{i * 100 + j}" for j in range(30)) for i in range(5)]
    docs = spark.createDataFrame([(i, texts[i % 5], "xx", "s", 9, 1) for i in range(10)], KIND)
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    left = cp.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == list(range(5))
    left.write.parquet(f"{tmp_path}/left")
    again = spark.read.parquet(f"{tmp_path}/left")
    assert cp._has_key(again) and not cp._has_key(docs)
    assert sorted(r.doc_id for r in cp.repeated_passages(spark, again, str(tmp_path)).collect()) == list(range(5))


def order(row):
    return (LEAST if row[0] is None else row[0], row[2])


def plain_near(rows):
    group = brute.similar([(k, t) for _, t, k in rows], cp.NEAR_WORDS, cp.NEAR_PERCENT)
    first = {}
    for r in sorted(rows, key=order):
        first.setdefault(group[r[2]][1], r)
    return sorted(first.values(), key=lambda r: r[2])


def plain_passages(rows):
    cut = brute.without_repeats([(order(r), r[1]) for r in rows], cp.WINDOW)
    return [(r[0], cut[order(r)][2] if cut[order(r)][1] else r[1], r[2]) for r in rows]


def plain_clean(rows, item):
    gone = {k for k, *_ in brute.contained([(k, t) for _, t, k in rows], [(1, item)], cp.ITEM_WORDS, cp.ITEM_PERCENT)}
    return [r for r in rows if r[2] not in gone]


def got(df):
    return sorted(((r.doc_id, r.text, r.row_key) for r in df.collect()), key=lambda r: r[2])


def test_one_document_of_each_group_stays(spark, rows, folder):
    want = plain_near(rows[0])
    assert got(cp.near_duplicates(spark, frame(spark, rows[0]), folder)) == want and len(want) == 12


def test_crowded_sketches_keep_unlike_documents_out_of_the_join(spark, folder, monkeypatch):
    """As in a large corpus, nearly every cell of a sketch of all elements is taken more than once."""
    held, keep = {}, jaccard.Scratch.keep

    def counted(self, df, label, *more):
        out = keep(self, df, label, *more)
        held[label] = out.count()
        return out
    monkeypatch.setattr(jaccard.Scratch, "keep", counted)
    monkeypatch.setattr(jaccard.join_similar, "__defaults__", (5, 80, 16))
    base = [f"w{i}" for i in range(240)]
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(240)), k) for k in range(1000)] + [(2000 + k, " ".join([f"n{k}", *base]), 2000 + k) for k in range(3)]
    assert {r.doc_id for r in cp.near_duplicates(spark, frame(spark, rows), folder).collect()} == {*range(1000), 2000}
    assert held["parts"] < 100


def test_passages_go_row_by_row(spark, rows, folder):
    found = cp.repeated_passages(spark, frame(spark, rows[0]), folder)
    assert got(found) == plain_passages(rows[0])
    assert all(r.n_chars == len(r.text) for r in found.collect())


def test_leaked_items_go_row_by_row(spark, rows, folder):
    want = plain_clean(*rows)
    assert got(cp.decontaminate(spark, frame(spark, rows[0]), folder)) == want and len(want) == len(rows[0]) - 2


def test_stages_take_documents_without_a_key(spark, rows, folder):
    found = cp.decontaminate(spark, frame(spark, rows[0]).drop("row_key"), folder)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter((d, t) for d, t, _ in plain_clean(*rows))


def test_run_equals_the_plain_stages(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(cp, "KEEP_FROM", -1.0)
    want = plain_clean(plain_passages(plain_near(rows[0])), rows[1])
    encoder = tokens.encoder(tokens.tokenizer_path(cp.TOKENIZER)).tokenizer
    pieces = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == Counter(
        (d, len(encoder.encode(t, add_special_tokens=False).ids) + 1) for d, t, _ in want)
