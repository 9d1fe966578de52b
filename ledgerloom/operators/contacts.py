"""Decision-maker contacts: extraction from pages, roll-up, targets, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import reach
from ledgerloom.functions.labels import PAGE_TITLES
from ledgerloom.functions.text import blank_to_null, strip
from ledgerloom.schemas import CONFIDENCE

# Site paths read for contacts, in order.
CANDIDATE_PATHS = [
    "/about", "/about-us", "/team", "/our-team", "/leadership",
    "/contact", "/contact-us", "/staff", "/management",
]
# Characters read to each side of a title, and the confidence.
REACH = 200
PAGE_CONFIDENCE = "0.50"
WEBSITE_SOURCE = "company_website_enrichment"
OFFICER_SOURCE = "corporations_canada_api"


def extract_contacts(pages: DataFrame, *carry: str) -> DataFrame:
    """One row per (page, title phrase found): nearby e-mail and phone.

    The phrases are an array inside the row, so a page is read once and only its
    hits leave the projection.
    """
    lowered = pages.withColumn("lowered", F.lower("html"))
    hits = F.array_compact(F.array(*[
        F.when(
            F.instr(F.col("lowered"), phrase) > 0,
            F.struct(
                F.lit(place).alias("phrase_order"), F.lit(phrase).alias("title_raw"),
                F.lit(role).alias("role_category"),
                F.instr(F.col("lowered"), phrase).alias("at")))
        for place, (phrase, role) in enumerate(PAGE_TITLES.items())]))
    first = F.greatest(F.col("at") - 1 - REACH, F.lit(0))
    window = F.substring(F.col("html"), first + 1, F.col("at") - 1 + REACH - first)
    return (
        lowered.select(*carry, F.col("url").alias("source_url"), "html", F.inline(hits))
        .withColumn("near", window)
        .select(*carry, "source_url", "phrase_order", "title_raw", "role_category",
                reach.first_email(F.col("near")).alias("email"),
                reach.first_phone(F.col("near")).alias("phone"),
                F.lit(PAGE_CONFIDENCE).cast(CONFIDENCE).alias("confidence"))
    )


def page_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def candidate_pages(pages: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Pages on the contact paths of a site, with host and path order."""
    paths = CANDIDATE_PATHS if paths is None else paths
    order = F.array_position(F.array(*[F.lit(p) for p in paths]), page_path(F.col("url")))
    return (
        pages.withColumn("path_order", order).where(F.col("path_order") > 0)
        .withColumn("host", reach.url_host(F.col("url")))
    )


def first_contacts(found: DataFrame, owner: str, page_order: list[str]) -> DataFrame:
    """First contact per (owner, role, e-mail) in page, then phrase order.

    A minimum per key, combined before the shuffle; a missing e-mail is a key
    value like any other.
    """
    rest = ["title_raw", "phone", "source_url", "confidence"]
    order = [*page_order, "phrase_order"]
    best = found.groupBy(owner, "role_category", "email").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return best.select(owner, "role_category", "email", *[F.col("first")[c].alias(c) for c in rest])


def website_targets(businesses: DataFrame, contacts: DataFrame, limit: int | None = None) -> DataFrame:
    """Businesses with a website and no contact at all, newest update first."""
    known = contacts.select("business_id").distinct()
    found = businesses.where(F.col("website").isNotNull()).join(known, "business_id", "left_anti").select(
        "business_id", "website", "last_updated_at")
    if limit is None:
        return found
    return found.orderBy(F.col("last_updated_at").desc_nulls_first(), "business_id").limit(limit)


def officer_targets(
    businesses: DataFrame, contacts: DataFrame, limit: int | None = None, source: str = OFFICER_SOURCE
) -> DataFrame:
    """Businesses with a corporation number and no contact from the source."""
    known = contacts.where(F.col("source_name") == source).select("business_id").distinct()
    found = businesses.where(F.col("corporation_number").isNotNull()).join(
        known, "business_id", "left_anti").select("business_id", "corporation_number", "quality_score")
    if limit is None:
        return found
    return found.orderBy(F.col("quality_score").desc_nulls_first(), "business_id").limit(limit)


def site_contacts(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Contacts of each target business from the landed pages of its site."""
    sites = targets.select("business_id", reach.url_host(F.col("website")).alias("host"))
    visited = candidate_pages(pages)
    # Pages are read and their contacts reduced once per host; only the result
    # meets the businesses that share the host.
    found = first_contacts(
        extract_contacts(visited, "host", "path_order"), "host", ["path_order", "source_url"])
    return sites.join(found, "host").drop("host")


def as_contact_rows(found: DataFrame, source_name: str, as_of: Column) -> DataFrame:
    """Extracted contacts in the shape of the contact table, with stable ids."""
    has = set(found.columns)
    name = F.col("full_name") if "full_name" in has else F.lit(None).cast("string")
    rows = found.select(
        "business_id", name.alias("full_name"), "title_raw", "role_category", "email", "phone",
        F.lit(source_name).alias("source_name"), "source_url", "confidence",
        as_of.alias("retrieved_at"), F.lit(True).alias("is_active"))
    fields = ["business_id", "full_name", "title_raw", "role_category", "email", "phone", "source_name", "source_url"]
    # Absent values are marked, so that two contacts never share an id by chance
    # of which field is missing.
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in fields]
    return rows.withColumn("contact_id", F.sha2(F.concat_ws("\x1f", *parts), 256))


def active_contact_counts(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("business_id").agg(F.count_if("is_active").alias("contact_count"))


def _listed() -> Column:
    return F.coalesce(blank_to_null(F.col("full_name")), blank_to_null(F.col("title_raw")))


def flatten_contacts(contacts: DataFrame) -> DataFrame:
    """Three '; '-joined strings per business, strongest contact first.

    One row per business at any size. Contacts meet first by business,
    confidence and the beginning of their id, which keeps the order; only the
    few strings of a business are then put together.
    """
    active = contacts.where("is_active")
    entry = F.struct(
        "contact_id", F.concat(_listed(), F.lit(" ("), F.col("role_category"), F.lit(")")).alias("name"),
        blank_to_null(F.col("email")).alias("email"), blank_to_null(F.col("phone")).alias("phone"))
    order = F.struct((-F.col("confidence")).alias("strength"), F.left("contact_id", F.lit(2)).alias("ids"))
    cells = ("name", "email", "phone")
    runs = active.groupBy("business_id", order.alias("order")).agg(F.array_sort(F.collect_list(entry)).alias("items"))

    def joined(items: str, column: str) -> Column:
        return F.array_join(F.transform(items, lambda i: i[column]), "; ")

    # A run without any such value must leave no separator behind.
    strings = runs.select("business_id", F.struct("order", *[blank_to_null(joined("items", c)).alias(c) for c in cells]).alias("run"))
    whole = strings.groupBy("business_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return whole.select("business_id", joined("runs", "name").alias("decision_makers"),
                        joined("runs", "email").alias("contact_emails"), joined("runs", "phone").alias("contact_phones"))


def contact_lines(contacts: DataFrame) -> DataFrame:
    """Active contacts one a row with their place in the business, for readers of businesses with very many."""
    place = F.row_number().over(Window.partitionBy("business_id").orderBy(F.desc_nulls_first("confidence"), "contact_id"))
    return contacts.where("is_active").select(
        "business_id", place.alias("place"), "contact_id", _listed().alias("listed"), "role_category", "email", "phone")


def enrichment_yield(targets: DataFrame, found: DataFrame) -> DataFrame:
    """How many target businesses gained contacts, of how many."""
    gained = found.select("business_id", F.lit(1).alias("hit")).distinct()
    return targets.select("business_id").distinct().join(gained, "business_id", "left").agg(
        F.count("hit").alias("enriched"), F.count(F.lit(1)).alias("targeted"))


def full_name(first: Column, middle: Column, last: Column) -> Column:
    parts = [blank_to_null(strip(p)) for p in (first, middle, last)]
    return blank_to_null(F.concat_ws(" ", *parts))
