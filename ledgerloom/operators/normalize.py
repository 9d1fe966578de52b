"""Raw records to comparable records, and the split into good and rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import reach, text
from ledgerloom.operators.keys import name_key, postal_name_key
from ledgerloom.schemas import BUSINESS_STATUSES, CONFIDENCE, SOURCE_KINDS

NAMES = ["legal_name", "operating_name", "city", "address_line1", "industry"]
CODES = ["naics_code", "corporation_number", "business_number"]
LOWERED = ["website", "email"]


def normalize_records(raw: DataFrame) -> DataFrame:
    """RAW columns in, NORM columns out; narrow steps only.

    The steps keep a value that later ones use several times in a column of its
    own. ``incorporation_text`` keeps the date as it was written, so that the
    validity split can tell a missing date from an unreadable one.
    """
    c = F.col
    stripped = raw.withColumns({
        **{f: text.strip(c(f)) for f in [*NAMES, *CODES, "incorporation_date"]},
        **{f: text.strip(F.lower(f)) for f in LOWERED},
        "province": F.when(c("province") != "", text.strip(c("province"))),
        "plain_phone": reach.plain_number(c("phone")),
    })
    cleaned = stripped.withColumns({f: text.clean_stripped(c(f)) for f in [*NAMES, *CODES, *LOWERED]})
    named = cleaned.withColumns({
        **{f: text.collapse_spaces(c(f)) for f in NAMES}, "site_host": reach.host_of(c("website"))})
    keyed = named.withColumns({
        "name_key": name_key(c("legal_name"), c("operating_name")),
        "postal_code": text.normalize_postal_code(c("postal_code")),
    })
    return keyed.select(
        "seq", "legal_name", "operating_name", text.province_code(c("province")).alias("province"),
        "city", "address_line1", "postal_code", "website",
        reach.domain_of_host(c("site_host")).alias("domain"),
        reach.normalize_phone(c("phone"), plain=c("plain_phone")).alias("phone"),
        "email", "industry", *CODES,
        text.date_of(c("incorporation_date")).alias("incorporation_date"),
        text.blank_to_null(c("incorporation_date")).alias("incorporation_text"),
        text.normalize_status(c("business_status")).alias("business_status"),
        "employee_count_min", "employee_count_max", "source_name", "source_kind", "source_url",
        c("confidence").cast(CONFIDENCE).alias("confidence"),
        "name_key", postal_name_key(c("postal_code"), c("name_key")).alias("postal_name_key"),
    )


def reject_reason():
    c = F.col
    return F.concat_ws(
        "; ",
        F.when(~c("business_status").isin(BUSINESS_STATUSES), F.lit("business_status")),
        F.when(~F.coalesce(c("source_kind"), F.lit("")).isin(SOURCE_KINDS), F.lit("source_kind")),
        F.when(c("incorporation_text").isNotNull() & c("incorporation_date").isNull(),
               F.lit("incorporation_date")),
    )


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, rejected records with a reason). No record is lost."""
    judged = records.withColumn("reason", reject_reason())
    good = judged.where(F.col("reason") == "").drop("reason", "incorporation_text")
    return good, judged.where(F.col("reason") != "")
