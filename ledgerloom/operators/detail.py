"""Everything known about some businesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import measures
from ledgerloom.operators.events import latest_events
from ledgerloom.operators.merge import flag_current
from ledgerloom.session import materialize


def business_detail(
    ids: DataFrame, businesses: DataFrame, contacts: DataFrame, field_sources: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """The four parts of a detail page for the wanted ids.

    A wanted id that is absent has no row in any part. Parts stay rows: a
    business with very many contacts is never nested into one value.
    """
    # Three parts meet the ids, and the fields are used twice: each is worked out once.
    wanted = materialize(ids.select("business_id").distinct(), "wanted")

    def of(df: DataFrame) -> DataFrame:
        return df.join(wanted, "business_id", "left_semi")

    return {
        "business": of(businesses),
        "contacts": of(contacts).where("is_active").orderBy(
            "business_id", F.desc_nulls_first("confidence"), "contact_id"),
        "field_sources": flag_current(materialize(of(field_sources), "fields")).orderBy(
            "business_id", "field_name", F.desc_nulls_first("confidence"), F.desc("seq")),
        "events": latest_events(of(events)).orderBy("business_id", "place"),
    }


def serialized(businesses: DataFrame) -> DataFrame:
    """Dates and times as text, as an API hands them out."""
    stamps = [c for c in ("first_seen_at", "last_verified_at", "last_updated_at", "created_at", "do_not_call_at")
              if c in businesses.columns]
    return businesses.withColumns({
        **{c: measures.iso_timestamp(F.col(c)) for c in stamps},
        "incorporation_date": measures.iso_date(F.col("incorporation_date")),
    })
