"""Keys that unlike firms share: a hosted domain, the phone of an agent.

Off unless a caller gives ``most_names``. A key held under more names than that
is no key for matching, now and in later batches; it stays a value of its
records. Names are counted in sketches, one a key, so a domain of a million
firms costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.keys import record_keys
from ledgerloom.operators.skew import HOT_ROWS, lookup

# Keys that may be shared, and their columns. Numbers of companies are nobody else's.
SHAREABLE = {"domain": "domain", "phone": "phone"}
KEY = ["key_type", "key_value"]
# 2^12 registers: exact for some hundred names, 2 % off beyond.
SKETCH_BITS = 12


def key_names(records: DataFrame) -> DataFrame:
    """(key_type, key_value, names): a sketch of the names under which each key is held."""
    asked = record_keys(records, "name_key").where(F.col("key_type").isin(list(SHAREABLE)) & (F.col("name_key") != ""))
    return asked.groupBy(*KEY).agg(F.hll_sketch_agg("name_key", F.lit(SKETCH_BITS)).alias("names"))


def add_names(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sketches of the keys of ``fresh``, with the names they were known by before."""
    both = fresh.unionByName(known.join(fresh.select(*KEY), KEY, "left_semi").select(*KEY, "names"))
    return both.groupBy(*KEY).agg(F.hll_union_agg("names").alias("names"))


def shared_keys(sketches: DataFrame, most_names: int) -> DataFrame:
    """(key_type, key_value, held_by) of the keys of more than ``most_names`` names."""
    return sketches.select(*KEY, F.hll_sketch_estimate("names").alias("held_by")).where(F.col("held_by") > most_names)


def without_shared_keys(records: DataFrame, shared: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The records, with NULL for every shared key. A record without name loses its shared keys as well."""
    asked = record_keys(records).where(F.col("key_type").isin(list(SHAREABLE)))
    held = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("held"))
    hits = lookup(asked, shared.join(held, KEY), KEY, "held", "seq", hot_rows)
    lost = hits.groupBy("seq").agg(F.collect_set("key_type").alias("lost"))
    return records.join(lost, "seq", "left").withColumns({
        column: F.when(~F.coalesce(F.array_contains("lost", kind), F.lit(False)), F.col(column))
        for kind, column in SHAREABLE.items()}).select(*records.columns)
