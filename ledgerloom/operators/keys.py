"""Match keys of a record and the key table of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import blank_to_null, strip

# Key types that can match, strongest first, and their columns.
MATCH_KEYS = [
    ("corp_number", "corporation_number"),
    ("domain", "domain"),
    ("phone", "phone"),
    ("postal_name", "postal_name_key"),
]
# Registered next to the match keys, never looked up.
NAME_KEY = ("name_hash", "name_key")


def name_key(legal: Column, operating: Column) -> Column:
    name = F.coalesce(blank_to_null(legal), blank_to_null(operating), F.lit(""))
    return F.lower(strip(name))


def postal_name_key(postal: Column, key: Column) -> Column:
    """Postal code and name; a record lacking either has no such key."""
    return F.when((postal != "") & (key != ""), F.concat(postal, F.lit("|"), key))


def record_keys(records: DataFrame, *carry: str, with_name: bool = False) -> DataFrame:
    """One row per (record, key): priority, key_type, key_value."""
    pairs = MATCH_KEYS + ([NAME_KEY] if with_name else [])
    entries = F.array(*[
        F.struct(
            F.lit(rank).alias("priority"), F.lit(kind).alias("key_type"),
            blank_to_null(F.col(column)).alias("key_value"))
        for rank, (kind, column) in enumerate(pairs)
    ])
    return records.select("seq", *carry, F.inline(entries)).where(F.col("key_value").isNotNull())


def register_identifiers(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Key table after the records (with their business_id) are registered.

    A triple keeps the place in the arrival order at which it was first seen.
    """
    fresh = record_keys(records, "business_id", with_name=True).select(
        "business_id", "key_type", "key_value", F.col("seq").alias("first_seq"))
    both = fresh if known is None else known.select(fresh.columns).unionByName(fresh)
    return both.groupBy("business_id", "key_type", "key_value").agg(F.min("first_seq").alias("first_seq"))


def new_identifiers(records: DataFrame, known: DataFrame) -> DataFrame:
    """Triples of the records that the key table lacks, or has from a later place only."""
    triple = ["business_id", "key_type", "key_value"]
    fresh = register_identifiers(records)
    held = known.select(*triple, F.col("first_seq").alias("held_seq"))
    return fresh.join(held, triple, "left").where(
        F.col("held_seq").isNull() | (F.col("first_seq") < F.col("held_seq"))).select(fresh.columns)


def key_owners(identifiers: DataFrame) -> DataFrame:
    """One row per key: the business that registered it first.

    Reducing to one owner before any join keeps a key with a million owners
    from meeting a million records.
    """
    return identifiers.groupBy("key_type", "key_value").agg(
        F.min_by("business_id", F.struct("first_seq", "business_id")).alias("owner"))
