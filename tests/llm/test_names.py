"""Columns of the caller that are named like an operator's own."""

from pyspark.sql import functions as F

from ledgerloom.llm import quality, sharding, substrings

import numpy as np

TEXTS = [(i, " ".join(f"w{j}" for j in range(25))) for i in range(4)]


def test_removal_with_columns_of_its_names(spark):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 7) for i, t in TEXTS], "doc_id long, text string, cover string, Row string, covers string, start int")
    got = substrings.remove_repeats(docs, 20, carry=["cover", "Row", "covers", "start"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.cover, r.Row, r.covers, r.start, r.n_removed) for r in got] == [(i, "a", "b", "c", 7, 25 if i else 0) for i in range(4)]


def test_score_replaces_a_carried_score(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in TEXTS], "doc_id long, text string, Score string")
    got = quality.score(docs, np.zeros((1 << quality.BITS) + 1), carry=["Score"])
    assert got.columns == ["doc_id", "score"] and [r.score for r in got.collect()] == [0.5] * 4


def test_shards_keep_columns_of_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "mine", 5, "x") for i, t in TEXTS], "doc_id long, text string, row string, slot int, shard string")
    sharding.write_shards(docs, f"{tmp_path}/out", 2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {"row", "slot", "shard", "slot_", "shard_"} <= set(back.columns)
    assert back.where((F.col("row") == "mine") & (F.col("slot") == 5) & (F.col("shard") == "x")).count() == 4
