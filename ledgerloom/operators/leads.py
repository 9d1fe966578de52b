"""Filters, lists, counts and digests over golden records.

Every operator that hands leads out drops do-not-call businesses itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import measures
from ledgerloom.schemas import NEW_EVENT_TYPES

# Columns a list may be sorted by, and its length.
SORTABLE = [
    "legal_name", "operating_name", "province", "city", "phone", "email", "industry",
    "size_category", "business_status", "quality_score", "first_seen_at", "incorporation_date",
]
LIST_COLUMNS = [
    "business_id", "legal_name", "operating_name", "province", "city", "phone", "email", "industry",
    "size_category", "quality_score", "lead_ready", "business_status", "first_seen_at",
    "incorporation_date",
]
LEAD_COLUMNS = [
    "business_id", "legal_name", "operating_name", "city", "province", "industry", "quality_score",
    "phone", "email", "website", "size_category", "incorporation_date",
]
DIGEST_COLUMNS = LEAD_COLUMNS[:8]
LIST_LIMIT = 200
WINDOW_EVENTS = {"today": "new_today", "7d": "new_7d", "30d": "new_30d"}


@dataclass(frozen=True)
class LeadFilter:
    """Optional conditions of a list or an export; unset ones do not apply."""

    search: str | None = None
    province: str | None = None
    city: str | None = None
    industry: str | None = None
    size_category: str | None = None
    min_quality_score: float | None = None
    phone_available: bool = False
    email_available: bool = False
    new_only: bool = False
    decision_maker_available: bool = False

    def condition(self) -> Column:
        c = F.col
        parts = [callable_leads()]
        if self.search:
            like = f"%{self.search}%"
            parts.append(c("legal_name").ilike(like) | c("operating_name").ilike(like))
        for column in ("province", "size_category"):
            if getattr(self, column):
                parts.append(c(column) == getattr(self, column))
        for column in ("city", "industry"):
            if getattr(self, column):
                parts.append(c(column).ilike(f"%{getattr(self, column)}%"))
        if self.min_quality_score:
            parts.append(c("quality_score") >= self.min_quality_score)
        for column in ("phone", "email"):
            if getattr(self, f"{column}_available"):
                parts.append(c(column).isNotNull())
        return reduce(lambda a, b: a & b, parts)


def callable_leads() -> Column:
    """Not marked do-not-call; an unknown flag does not count as free."""
    return ~F.col("do_not_call")


def with_new_event(businesses: DataFrame, events: DataFrame) -> DataFrame:
    ids = events.where(F.col("event_type").isin(NEW_EVENT_TYPES)).select("business_id").distinct()
    return businesses.join(ids, "business_id", "left_semi")


def with_active_contact(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    ids = contacts.where("is_active").select("business_id").distinct()
    return businesses.join(ids, "business_id", "left_semi")


def filter_leads(
    businesses: DataFrame,
    wanted: LeadFilter = LeadFilter(),
    events: DataFrame | None = None,
    contacts: DataFrame | None = None,
) -> DataFrame:
    found = businesses.where(wanted.condition())
    if wanted.new_only:
        found = with_new_event(found, events)
    if wanted.decision_maker_available:
        found = with_active_contact(found, contacts)
    return found


def sorted_list(
    leads: DataFrame, sort_by: str = "quality_score", sort_order: str = "desc", limit: int = LIST_LIMIT
) -> DataFrame:
    """First rows of the list; NULLs last in both directions."""
    column = sort_by if sort_by in SORTABLE else "quality_score"
    ascending = sort_order.upper() == "ASC"
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return leads.select(LIST_COLUMNS).orderBy(order, "business_id").limit(limit)


def total(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count(F.lit(1)).alias("total"))


def sales_ready(businesses: DataFrame) -> DataFrame:
    return businesses.where(F.col("lead_ready") & callable_leads() & (F.col("business_status") == "active"))


def new_leads(businesses: DataFrame, events: DataFrame, window: str = "today", min_score: float = 0) -> DataFrame:
    """Leads with an event of the window, one row per event, best score first."""
    kind = WINDOW_EVENTS.get(window, "new_today")
    hits = events.where(F.col("event_type") == kind).select("business_id")
    wanted = businesses.where(callable_leads() & (F.col("quality_score") >= min_score))
    return wanted.join(hits, "business_id").select(LEAD_COLUMNS).orderBy(
        F.desc("quality_score"), "business_id")


def new_today_view(businesses: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Leads first seen on the day of ``as_of``."""
    hits = events.where(
        (F.col("event_type") == "new_today") & (F.col("detected_at") >= F.date_trunc("day", as_of))
    ).select("business_id")
    return businesses.where(callable_leads()).join(hits, "business_id")


def daily_digest(businesses: DataFrame, events: DataFrame, limit: int = 15) -> DataFrame:
    return new_leads(businesses, events).select(DIGEST_COLUMNS).orderBy(
        F.desc("quality_score"), "business_id").limit(limit)


def totals(businesses: DataFrame) -> DataFrame:
    return businesses.where(callable_leads()).agg(
        F.count(F.lit(1)).alias("total_businesses"), F.count_if("lead_ready").alias("lead_ready"))


def count_by(businesses: DataFrame, column: str) -> DataFrame:
    """Callable businesses by a column, without those where it is missing or blank."""
    return (
        businesses.where(callable_leads() & (F.trim(column) != ""))
        .groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), column)
    )


def digest_lines(leads: DataFrame) -> DataFrame:
    """One text line per lead of a new-leads digest."""
    text = F.concat(
        F.lit("• "), F.coalesce(measures.display_name(F.col("legal_name"), F.col("operating_name")), F.lit("null")),
        F.lit(" — "), F.coalesce("city", F.lit("null")), F.lit(", "), F.coalesce("province", F.lit("null")),
        F.lit(" — "), F.coalesce(F.nullif("industry", F.lit("")), F.lit("industry unknown")),
        F.lit(" — score "), F.floor(F.col("quality_score") + 0.5).cast("string"),
        F.when(measures.present(F.col("phone")), F.concat(F.lit(" — "), F.col("phone"))).otherwise(""),
    )
    return leads.select("business_id", "quality_score", text.alias("line"))


def message_rows(lines: DataFrame, title: Column, *order: Column) -> DataFrame:
    """A message as rows in reading order: the title line, then one row a line.

    Kept as rows so that no message has to fit one task; a writer sends them as
    text. ``title`` may use the number of lines, ``count``. No lines, no rows.
    """
    head = lines.agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 0).select(
        F.lit(0).alias("section"), title.alias("line"))
    body = lines.withColumn("section", F.lit(1))
    return body.unionByName(head, allowMissingColumns=True).orderBy("section", *order)


def digest_message(businesses: DataFrame, events: DataFrame, min_score: float = 50) -> DataFrame:
    lines = digest_lines(new_leads(businesses, events, "today", min_score))
    title = F.concat(F.lit(":new: *"), F.col("count").cast("string"), F.lit(" new sales-ready lead(s) today*"))
    return message_rows(lines, title, F.desc("quality_score"), F.col("business_id"))
