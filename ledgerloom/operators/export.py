"""Lead export with flattened contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.contacts import flatten_contacts
from ledgerloom.operators.leads import LeadFilter, filter_leads

# The columns of an export file, in order.
EXPORT_COLUMNS = [
    "legal_name", "operating_name", "province", "city", "address_line1",
    "postal_code", "website", "phone", "email", "industry", "naics_code",
    "size_category", "size_confidence", "business_status",
    "incorporation_date", "quality_score", "lead_ready",
    "first_seen_at", "last_verified_at",
    "decision_makers", "contact_emails", "contact_phones",
]


def export_rows(
    businesses: DataFrame, contacts: DataFrame, wanted: LeadFilter = LeadFilter(), events: DataFrame | None = None
) -> DataFrame:
    """Export columns and business_id, one row per business."""
    leads = filter_leads(businesses, wanted, events, contacts)
    flat = flatten_contacts(contacts)
    text = ["decision_makers", "contact_emails", "contact_phones"]
    return leads.join(flat, "business_id", "left").select(
        "business_id",
        *[F.coalesce(c, F.lit("")).alias(c) if c in text else F.col(c) for c in EXPORT_COLUMNS])


def write_export(rows: DataFrame, path: str) -> None:
    """CSV files whose order over all files is best score first.

    A range sort, so each task writes its own share.
    """
    order = [F.desc_nulls_first("quality_score"), F.col("business_id")]
    (
        rows.orderBy(*order).select(EXPORT_COLUMNS).write
        .option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ssXXX")
        .csv(path)
    )
