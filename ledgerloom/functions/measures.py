"""Company size, lead score and display values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import blank_to_null
from ledgerloom.schemas import SCORE

# Lower bound of each employee-size class.
SIZE_CLASSES = [
    (1, "1-4"), (5, "5-9"), (10, "10-19"), (20, "20-49"), (50, "50-99"),
    (100, "100-199"), (200, "200-499"), (500, "500-999"), (1000, "1000+"),
]

# Weight of each lead-quality check, and the bar of a ready lead.
WEIGHTS = {
    "has_verified_phone": 20,
    "has_website": 10,
    "has_verified_address": 15,
    "has_employee_info": 10,
    "has_decision_maker": 20,
    "recently_verified": 10,
    "multiple_sources": 15,
}
LEAD_READY_THRESHOLD = 50
RECENT_DAYS = 90


def size_class(count: Column) -> Column:
    label = None
    for low, name in reversed(SIZE_CLASSES):
        label = F.when(count >= low, name) if label is None else label.when(count >= low, name)
    return label


def _nonzero(count: Column) -> Column:
    return F.nullif(count, F.lit(0))


def classify_size(count_min: Column, count_max: Column, exact: Column | None = None) -> Column:
    """Struct (size_category, size_confidence); a count of zero is no count."""
    low = _nonzero(count_min)
    midpoint = F.floor((low + F.coalesce(_nonzero(count_max), low)) / 2)
    estimate = F.struct(
        F.when(low.isNotNull(), size_class(midpoint)).alias("size_category"),
        F.lit("estimated").alias("size_confidence"),
    )
    if exact is None:
        return estimate
    known = _nonzero(exact)
    return F.when(
        known.isNotNull(),
        F.struct(size_class(known).alias("size_category"), F.lit("confirmed").alias("size_confidence")),
    ).otherwise(estimate)


def present(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def score_checks(contact_count: Column, source_count: Column, days_since_verified: Column) -> Column:
    """Struct of the seven checks over the golden columns of a business."""
    return F.struct(
        present(F.col("phone")).alias("has_verified_phone"),
        present(F.col("website")).alias("has_website"),
        (present(F.col("address_line1")) & present(F.col("postal_code"))).alias("has_verified_address"),
        present(F.col("size_category")).alias("has_employee_info"),
        F.coalesce(contact_count > 0, F.lit(False)).alias("has_decision_maker"),
        F.coalesce(days_since_verified <= RECENT_DAYS, F.lit(False)).alias("recently_verified"),
        F.coalesce(source_count >= 2, F.lit(False)).alias("multiple_sources"),
    )


def score(checks: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    total = F.lit(0)
    for name, weight in weights.items():
        total = total + F.when(checks[name], weight).otherwise(0)
    return total.cast(SCORE)


def is_lead_ready(value: Column, threshold: int = LEAD_READY_THRESHOLD) -> Column:
    return F.coalesce(value >= threshold, F.lit(False))


def display_name(legal: Column, operating: Column) -> Column:
    return F.coalesce(blank_to_null(legal), blank_to_null(operating))


def rounded_score(value: Column) -> Column:
    """Whole number, halves to even, as the page shows it."""
    return F.bround(value, 0).cast("int")


def percent(value: Column) -> Column:
    return F.bround(value * 100, 0).cast("int")


def iso_timestamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssXXX")


def iso_date(value: Column) -> Column:
    return value.cast("string")
