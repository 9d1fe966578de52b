"""Matching free-form headers to record fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import strip

Hints = Mapping[str, Sequence[str]]

# Header hints per field and portal family, in the order tried.
CKAN_HINTS: Hints = {
    "legal_name": ["legal name", "legal_name", "company", "operator name"],
    "operating_name": ["trade name", "operating name", "dba", "business name"],
    "address_line1": ["address", "street address", "location"],
    "city": ["city", "municipality"],
    "postal_code": ["postal code", "postal_code"],
    "phone": ["phone", "telephone"],
    "email": ["email"],
    "website": ["website", "url"],
    "industry": ["business type", "category", "licence type", "license type"],
    "naics_code": ["naics"],
    "incorporation_date": ["issued date", "start date", "date issued"],
    "business_status": ["status"],
}
SOCRATA_HINTS: Hints = {
    "legal_name": ["legal name", "legal_name", "company", "licencee"],
    "operating_name": [
        "trade name", "trading name", "tradename", "operating name", "dba", "business name"],
    "address_line1": [
        "address", "street address", "location", "business_address", "house_no", "street_name"],
    "city": ["city", "municipality", "community"],
    "postal_code": ["postal code", "postal_code", "postalcode"],
    "phone": ["phone", "telephone"],
    "email": ["email"],
    "website": ["website", "url"],
    "industry": [
        "business type", "category", "licence type", "license type", "licencetype",
        "licence_type", "industry"],
    "naics_code": ["naics"],
    "incorporation_date": [
        "issued date", "start date", "date issued", "issuedate", "licenceissuedate", "creation_date"],
    "business_status": ["status", "licence_status", "licencestatus"],
}
OPENDATASOFT_HINTS: Hints = {
    "legal_name": ["legal name", "legal_name", "businessname", "company"],
    "operating_name": [
        "trade name", "tradename", "operating name", "dba", "business name", "businesstradename"],
    "address_line1": ["address", "house", "street", "unit", "localarea"],
    "city": ["city", "municipality"],
    "postal_code": ["postal code", "postal_code", "postalcode"],
    "phone": ["phone", "telephone"],
    "email": ["email"],
    "website": ["website", "url"],
    "industry": ["business type", "category", "businesstype", "businesssubtype", "type"],
    "naics_code": ["naics"],
    "incorporation_date": ["issueddate", "issued date", "folderyear", "extractdate"],
    "business_status": ["status"],
}


def effective_hints(defaults: Hints, overrides: Hints | None = None) -> dict[str, Sequence[str]]:
    """Default hints; a field with hints of its own uses only those."""
    return {field: (overrides or {}).get(field) or hints for field, hints in defaults.items()}


def match_columns(headers: Sequence[str], hints: Hints) -> dict[str, str | None]:
    """Header of each field: first hint, then first header, that contains it."""
    def find(words: Sequence[str]) -> str | None:
        return next((h for word in words for h in headers if word in h.lower()), None)

    return {field: find(words) for field, words in hints.items()}


def match_header_table(headers: DataFrame, hints: Hints) -> DataFrame:
    """The same match for a table of headers (source, position, header).

    The hints ride along as an array in each row; the best hit of a field is a
    minimum per (source, field).
    """
    entries = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(place).alias("hint_place"), F.lit(word).alias("hint"))
        for field, words in hints.items() for place, word in enumerate(words)])
    hits = headers.select("source", "position", "header", F.inline(entries)).where(
        F.contains(F.lower("header"), F.col("hint")))
    return hits.groupBy("source", "field").agg(
        F.min_by("header", F.struct("hint_place", "position")).alias("header"))


def mapped(column: str | None) -> Column:
    """Trimmed value of a mapped column; NULL when unmapped or empty."""
    if column is None:
        return F.lit(None).cast("string")
    value = F.col(f"`{column}`")
    return F.when(F.length(value) > 0, strip(value))
