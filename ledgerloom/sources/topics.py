"""Nested JSON: registry topics and corporation officers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import labels
from ledgerloom.functions.text import blank_to_null, digits_only, parse_date, strip
from ledgerloom.operators.contacts import full_name
from ledgerloom.schemas import CONFIDENCE
from ledgerloom.sources.files import raw_records

TOPIC_PAGE = """
    total bigint, results array<struct<
        source_id: string, type: string, inactive: boolean,
        names: array<struct<type: string, text: string>>,
        attributes: array<struct<type: string, value: string>>>>
"""
# Name types of an operating name, and date attributes.
OPERATING_TYPES = ["assumed_name", "trade_name", "doing_business_as"]
DATE_ATTRIBUTES = ["entity_status_effective", "registration_date", "effective_date"]

_OFFICER = (
    "struct<firstName: string, first_name: string, middleName: string, middle_name: string, "
    "lastName: string, last_name: string, title: string, officer_type: string>"
)
OFFICER_PAYLOAD = f"corporation struct<directors: array<{_OFFICER}>>, directors array<{_OFFICER}>"


def topic_records(
    pages: DataFrame, source_name: str = "bc_orgbook", url_prefix: str = "entity/", listing_url: str = "search"
) -> DataFrame:
    """RAW records from pages of topics (column ``payload``: one JSON page)."""
    topics = pages.select(F.explode(F.from_json("payload", TOPIC_PAGE)["results"]).alias("t")).select("t.*")
    named = F.filter("names", lambda n: F.coalesce(strip(n["text"]), F.lit("")) != "")
    legal = F.filter(named, lambda n: n["type"] == "entity_name")
    trading = F.filter(named, lambda n: n["type"].isin(OPERATING_TYPES))
    dated = F.filter("attributes", lambda a: a["type"].isin(DATE_ATTRIBUTES)
                     & (F.coalesce(a["value"], F.lit("")) != ""))
    name = F.coalesce(
        strip(F.try_element_at(legal, F.lit(1))["text"]),
        blank_to_null(strip(F.try_element_at(F.col("names"), F.lit(1))["text"])))
    number = blank_to_null(F.col("source_id"))
    return raw_records(
        topics.where(name.isNotNull()),
        legal_name=name,
        operating_name=strip(F.try_element_at(trading, F.lit(-1))["text"]),
        province=F.lit("BC"),
        corporation_number=number,
        business_status=F.when(F.col("inactive"), "dissolved").otherwise("active"),
        incorporation_date=F.left(F.try_element_at(dated, F.lit(1))["value"], F.lit(10)),
        industry=blank_to_null(labels.entity_label(F.col("type"))),
        source_name=F.lit(source_name),
        source_kind=F.lit("provincial_registry"),
        source_url=F.coalesce(F.concat(F.lit(url_prefix), number), F.lit(listing_url)),
        confidence=F.lit("0.85").cast(CONFIDENCE),
    )


def recent_registrations(records: DataFrame, as_of: Column, days_back: int = 7) -> DataFrame:
    """Records registered in the last days; an unreadable date does not drop one."""
    registered = parse_date(F.col("incorporation_date"))
    return records.where(registered.isNull() | (registered >= F.date_sub(as_of, days_back)))


def new_topic_records(pages: DataFrame, as_of: Column, days_back: int = 7) -> DataFrame:
    return recent_registrations(topic_records(pages, "bc_orgbook_new"), as_of, days_back)


def officer_contacts(payloads: DataFrame, url_prefix: str = "corporation/") -> DataFrame:
    """Contacts from corporation JSON (business_id, corporation_number, payload)."""
    parsed = payloads.withColumn("number", digits_only(F.col("corporation_number"))).where(
        F.col("number").isNotNull()
    ).withColumn("doc", F.from_json("payload", OFFICER_PAYLOAD))
    officers = F.when(F.col("doc.corporation").isNotNull(), F.col("doc.corporation.directors")).otherwise(
        F.col("doc.directors"))
    rows = parsed.select("business_id", "number", F.explode(officers).alias("o"))

    def either(a: str, b: str) -> Column:
        return F.coalesce(blank_to_null(F.col("o")[a]), blank_to_null(F.col("o")[b]))

    title = strip(F.coalesce(either("title", "officer_type"), F.lit("Director")))
    return rows.select(
        "business_id",
        full_name(either("firstName", "first_name"), either("middleName", "middle_name"),
                  either("lastName", "last_name")).alias("full_name"),
        title.alias("title_raw"), labels.officer_role(title).alias("role_category"),
        F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"),
        F.concat(F.lit(url_prefix), F.col("number")).alias("source_url"),
        F.lit("0.80").cast(CONFIDENCE).alias("confidence"),
    ).where(F.col("full_name").isNotNull())
