"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import leads
from ledgerloom.plans import inputs, queries_leads, queries_records, queries_sources, queries_values
from ledgerloom.plans.book import Book

BOOK = Book()
for _module in (queries_values, queries_leads, queries_records, queries_sources):
    BOOK.merge(_module.book)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top sales-ready leads by score."""
    return leads.sorted_list(leads.sales_ready(inputs.businesses(spark, sf_dir)))
