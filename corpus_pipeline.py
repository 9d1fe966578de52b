"""Corpus pipeline: quality filter, near-duplicate join, passage removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) with docs in the columns of `documents`, and its result is written and read
again before the next. The first adds a key of its own for each row, KEY, known by a mark in its schema, which the others
carry (a stage that gets no such key writes its input with one first; a user's column of that name is left out), so rows that share or lack a doc_id are documents of their own everywhere. Null
ids count as the smallest. The last stage returns the pieces of packed sequences.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F  # noqa: E402

from ledgerloom.llm import containment, jaccard, packing, quality, substrings  # noqa: E402
from ledgerloom.llm.scratch import Scratch  # noqa: E402
from ledgerloom.session import tune  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "row_key"
#: Written into the schema of our own key column; a column of the user's that has its name lacks it.
MARK = {"made_by": "corpus_pipeline"}
KEEP_FROM = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80
WINDOW = 20
ITEM_WORDS, ITEM_PERCENT = 5, 80
TOKENIZER, END_ID, LENGTH = "byte_bpe_50k.json", 0, 1024

#: The stages are iterative and learned; no SQL says what they do. tests/llm/test_corpus_pipeline.py compares
#: the stages after the classifier and run() with plain versions.
ORACLE_SQL = None


def _has_key(docs: DataFrame) -> bool:
    return KEY in docs.columns and docs.schema[KEY].metadata == MARK


def _key(column) -> Column:
    return column.alias(KEY, metadata=MARK)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with KEY; it's written before anything reads it twice."""
    if _has_key(docs):
        return docs.select(*COLUMNS, KEY)
    return Scratch(spark, "pipeline").keep(docs.select(*COLUMNS, _key(F.monotonically_increasing_id())), "keyed")


def _named(docs: DataFrame) -> DataFrame:
    """Texts by key, for operators that know a document by its doc_id."""
    return docs.select(F.col(KEY).alias("doc_id"), "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores below KEEP_FROM go. Labels of one fold in five are left for measuring."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    weights = quality.fit(tune(spark) and docs, labels)
    held = [KEY] if _has_key(docs) else []
    good = quality.score(docs, weights, carry=["text", "lang", "source", "n_chars", *held]).where(F.col("score") >= KEEP_FROM)
    return good.select(*COLUMNS, _key(F.col(KEY) if held else F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike in 80 % of their five-word shingles, the one of smallest (id, key) stays.

    Texts without words are in no group and stay.
    """
    docs = _keyed(tune(spark), docs)
    found = jaccard.join_similar(_named(docs), NEAR_WORDS, NEAR_PERCENT)
    member = docs.select(KEY, "doc_id").join(found.select(F.col("doc_id").alias(KEY), "component_id"), KEY)
    member = Scratch(spark, "pipeline").keep(member, "groups")
    first = member.groupBy("component_id").agg(F.min(F.struct("doc_id", KEY)).alias("first"), F.count("*").alias("held")).where("held > 1")
    gone = member.join(first, "component_id").where(F.col(KEY) != F.col(f"first.{KEY}")).select(KEY)
    return docs.join(gone, KEY, "left_anti").select(*COLUMNS, KEY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of twenty that also start earlier go; texts that lose nothing keep their white space."""
    cut = substrings.remove_repeats(_keyed(tune(spark), docs), WINDOW, carry=["text", "lang", "source", "n_chars", KEY], key=KEY)
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), _key(F.col(KEY)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of the five-word shingles of a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _keyed(tune(spark), docs)
    gone = containment.contained_items(_named(docs), items, ITEM_WORDS, ITEM_PERCENT).select(F.col("doc_id").alias(KEY)).distinct()
    return docs.join(gone, KEY, "left_anti").select(*COLUMNS, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of LENGTH ids."""
    return packing.pack(tune(spark) and docs, TOKENIZER, END_ID, LENGTH)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
