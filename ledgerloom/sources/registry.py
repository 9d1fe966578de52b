"""Configured open-data sources.

Sites and datasets stay out: jobs start from landed files, and where a source's
files lie is the caller's to say.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.sources import mapping


@dataclass(frozen=True)
class Portal:
    name: str
    family: str
    province: str
    kind: str = "municipal_open_data"
    hints: Mapping[str, Sequence[str]] = field(default_factory=dict)
    where: str | None = None
    default_city: str | None = None
    confidence: str = "0.70"


# The portals, their provinces, kinds and header hints.
PORTALS = [
    Portal("ontario_licensed_businesses", "ckan", "ON", "provincial_registry"),
    Portal("toronto_business_licences", "ckan", "ON"),
    Portal("alberta_licensed_businesses", "ckan", "AB", "provincial_registry"),
    Portal("montreal_commercial_establishments", "ckan", "QC", hints={
        "legal_name": ["nom_etablissement", "establishment name", "name"],
        "operating_name": ["dba", "trade name"],
        "address_line1": ["adresse", "address"],
        "city": ["ville", "city"],
        "postal_code": ["code_postal", "postal code"],
    }),
    Portal("montreal_locaux_commerciaux", "ckan", "QC", hints={
        "legal_name": ["nom_entreprise", "company", "nom"],
        "operating_name": ["enseigne", "trade name"],
        "address_line1": ["adresse", "address", "suite_adresse"],
        "city": ["ville", "city"],
        "industry": ["type_usage", "categorie", "category"],
    }),
    Portal("ottawa_business_licences", "ckan", "ON", hints={
        "legal_name": ["business name", "company name", "licensee"],
        "operating_name": ["trade name", "operating as"],
        "address_line1": ["address", "street address", "location"],
        "city": ["ward", "city"],
        "industry": ["licence type", "business type", "category"],
        "incorporation_date": ["issue date", "date issued"],
        "business_status": ["status"],
    }),
    Portal("halifax_business_registrations", "ckan", "NS", hints={
        "legal_name": ["business_name", "company", "name"],
        "operating_name": ["trade name", "operating name"],
        "address_line1": ["address", "location", "civic_address"],
        "city": ["community", "district"],
        "industry": ["category", "business type", "type"],
        "incorporation_date": ["date_issued", "start date"],
        "business_status": ["status"],
    }),
    Portal("brampton_business_directory", "ckan", "ON", hints={
        "legal_name": ["business_name", "company_name", "name"],
        "operating_name": ["trade_name", "dba"],
        "address_line1": ["address", "street_address"],
        "industry": ["business_type", "category", "naics_description"],
        "naics_code": ["naics", "naics_code"],
    }),
    Portal("manitoba_business_listings", "ckan", "MB", "provincial_registry", hints={
        "legal_name": ["business name", "company name", "legal name"],
        "operating_name": ["operating name", "dba", "trade name"],
        "address_line1": ["address", "location", "street address"],
        "city": ["city", "municipality", "community"],
        "postal_code": ["postal code", "postal_code"],
        "industry": ["industry", "business type", "sector"],
        "incorporation_date": ["date registered", "registration date"],
        "business_status": ["status"],
    }),
    Portal("calgary_business_licences", "socrata", "AB", hints={
        "operating_name": ["tradename", "trade name"],
        "address_line1": ["address"],
        "industry": ["licencetype", "licence type"],
        "incorporation_date": ["licenceissuedate", "creation_date"],
        "business_status": ["licencestatus", "status"],
    }),
    Portal("edmonton_business_licences", "socrata", "AB", hints={
        "operating_name": ["trade name", "trading name", "business name"],
        "address_line1": ["address", "location"],
        "industry": ["category", "business type"],
        "incorporation_date": ["issue date", "date issued"],
        "business_status": ["status"],
    }),
    Portal("winnipeg_business_licences", "socrata", "MB", hints={
        "operating_name": ["business name", "trade name"],
        "address_line1": ["address", "location"],
        "industry": ["licence type", "category"],
        "incorporation_date": ["issue date"],
        "business_status": ["status"],
    }),
    Portal("vancouver_business_licences", "opendatasoft", "BC", hints={
        "operating_name": ["businessname", "business name", "tradename"],
        "address_line1": ["house", "street"],
        "industry": ["businesstype", "businesssubtype"],
        "incorporation_date": ["issueddate", "folderyear"],
        "business_status": ["status"],
    }, where="status='Issued'", default_city="Vancouver"),
]

FAMILY_HINTS = {
    "ckan": mapping.CKAN_HINTS,
    "socrata": mapping.SOCRATA_HINTS,
    "opendatasoft": mapping.OPENDATASOFT_HINTS,
}


def portal(name: str) -> Portal:
    found = next((p for p in PORTALS if p.name == name), None)
    if found is None:
        raise KeyError(f"unknown source: {name}")
    return found


def hints_of(source: Portal) -> dict[str, Sequence[str]]:
    return mapping.effective_hints(FAMILY_HINTS[source.family], source.hints)


def registry_table(spark: SparkSession, portals: Sequence[Portal] = tuple(PORTALS)) -> DataFrame:
    """The configured sources as rows (one per entry of the list)."""
    return spark.createDataFrame(
        [(p.name, p.family, p.province, p.kind, p.confidence) for p in portals],
        "source_name string, family string, province string, source_kind string, confidence string",
    ).withColumn("confidence", F.col("confidence").cast("decimal(4,2)"))


def apply_registry(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Province, kind and confidence of each record from its source's entry.

    The registry is a hand-written list, so it is small enough to send along.
    """
    entry = registry.select(
        "source_name", F.col("province").alias("of_province"), F.col("source_kind").alias("of_kind"),
        F.col("confidence").alias("of_confidence"))
    columns = records.columns
    joined = records.join(F.broadcast(entry), "source_name", "left")
    return joined.withColumns({
        "province": F.coalesce("of_province", "province"),
        "source_kind": F.coalesce("of_kind", "source_kind"),
        "confidence": F.coalesce("of_confidence", "confidence"),
    }).select(columns)
