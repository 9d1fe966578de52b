"""Lead scores of golden records, and refreshing stale ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import measures
from ledgerloom.operators.contacts import active_contact_counts
from ledgerloom.session import materialize

# Fixed value: days after which an unverified active business is stale.
STALE_DAYS = 30


def source_counts(field_sources: DataFrame) -> DataFrame:
    """Distinct sources per business, from the provenance log."""
    return (
        field_sources.select("business_id", "source_name").distinct()
        .groupBy("business_id").agg(F.count(F.lit(1)).alias("source_count"))
    )


def rescore(businesses: DataFrame, contacts: DataFrame, field_sources: DataFrame, as_of: Column,
            with_checks: bool = False) -> DataFrame:
    """Score and readiness of every business, in one job.

    Both sides are reduced to one row per business before they are joined.
    """
    # Whole days that have passed, not dates in between: 90 days and 5 hours are 90.
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_verified_at").cast("timestamp"))) / 86_400_000_000).cast("int")
    joined = (
        businesses.join(active_contact_counts(contacts), "business_id", "left")
        .join(source_counts(field_sources), "business_id", "left")
    )
    checks = measures.score_checks(F.col("contact_count"), F.col("source_count"), days)
    scored = joined.withColumn("checks", checks).withColumn("quality_score", measures.score(F.col("checks")))
    scored = scored.withColumn("lead_ready", measures.is_lead_ready(F.col("quality_score")))
    return scored.select(*businesses.columns, *(["checks"] if with_checks else []))


def stale(as_of: Column, days: int = STALE_DAYS) -> Column:
    return F.coalesce(
        (F.col("last_verified_at") < as_of - F.expr(f"interval {days} days"))
        & (F.col("business_status") == "active"), F.lit(False))


def touch_stale(
    businesses: DataFrame, contacts: DataFrame, field_sources: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(businesses after the refresh, ids of the refreshed ones).

    Only the stale businesses are looked up in contacts and provenance.
    """
    ids = businesses.where(stale(as_of)).select("business_id")
    due = businesses.where(stale(as_of)).withColumn("last_verified_at", as_of)
    fresh = rescore(
        due, contacts.join(ids, "business_id", "left_semi"),
        field_sources.join(ids, "business_id", "left_semi"), as_of)
    rest = businesses.where(~stale(as_of))
    return rest.unionByName(fresh), ids


def add_contacts(
    businesses: DataFrame, contacts: DataFrame, found: DataFrame, field_sources: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(businesses, contacts) after appending contacts and rescoring their owners."""
    # Used four times, worked out once.
    fresh = materialize(found.join(contacts.select("contact_id"), "contact_id", "left_anti"), "fresh")
    every = contacts.unionByName(fresh.select(contacts.columns))
    ids = fresh.select("business_id").distinct()
    due = businesses.join(ids, "business_id", "left_semi")
    scored = rescore(
        due, every.join(ids, "business_id", "left_semi"),
        field_sources.join(ids, "business_id", "left_semi"), as_of)
    return businesses.join(ids, "business_id", "left_anti").unionByName(scored), every
