"""Table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

CONFIDENCE = T.DecimalType(4, 2)
SCORE = T.DecimalType(5, 2)

# The fields that take part in merging, in merge order.
MERGE_FIELDS = [
    "legal_name", "operating_name", "province", "city", "address_line1",
    "postal_code", "website", "domain", "phone", "email", "industry",
    "naics_code", "corporation_number", "business_number",
    "incorporation_date", "business_status",
]

# The domains of the coded columns.
BUSINESS_STATUSES = ["active", "inactive", "dissolved", "unknown"]
SIZE_CONFIDENCES = ["confirmed", "estimated"]
CONTACT_ROLES = [
    "owner", "founder", "president", "general_manager", "office_manager",
    "operations_manager", "it_manager", "it_director", "procurement",
    "other_decision_maker",
]
SOURCE_KINDS = [
    "federal_registry", "provincial_registry", "municipal_open_data",
    "business_directory", "company_website", "manual", "other",
]
JOB_STATUSES = ["running", "success", "partial_failure", "failed"]
EVENT_TYPES = ["new_today", "new_7d", "new_30d", "recently_changed", "new_location"]
NEW_EVENT_TYPES = ["new_today", "new_7d", "new_30d"]

# Defaults of a record that names no source kind or confidence.
DEFAULT_KIND = "other"
DEFAULT_CONFIDENCE = "0.60"


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


RAW_TEXT = [
    "legal_name", "operating_name", "province", "city", "address_line1",
    "postal_code", "website", "phone", "email", "industry", "naics_code",
    "corporation_number", "business_number", "incorporation_date",
    "business_status",
]

RAW = T.StructType(
    [T.StructField("seq", T.LongType())]
    + _fields(RAW_TEXT, T.StringType())
    + _fields(["employee_count_min", "employee_count_max"], T.IntegerType())
    + _fields(["source_name", "source_kind", "source_url"], T.StringType())
    + [
        T.StructField("confidence", CONFIDENCE),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

IDENTIFIERS = T.StructType([
    T.StructField("business_id", T.LongType()),
    T.StructField("key_type", T.StringType()),
    T.StructField("key_value", T.StringType()),
    T.StructField("first_seq", T.LongType()),
])

# Sketches of the names under which a domain or phone is held.
KEY_NAMES = T.StructType([
    T.StructField("key_type", T.StringType()),
    T.StructField("key_value", T.StringType()),
    T.StructField("names", T.BinaryType()),
])

FIELD_SOURCES = T.StructType([
    T.StructField("business_id", T.LongType()),
    T.StructField("field_name", T.StringType()),
    T.StructField("field_value", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_kind", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("confidence", CONFIDENCE),
    T.StructField("seq", T.LongType()),
    T.StructField("retrieved_at", T.TimestampType()),
])

# Sources of which a business has an accepted value: what scores need of the log.
BUSINESS_SOURCES = T.StructType([
    T.StructField("business_id", T.LongType()),
    T.StructField("source_name", T.StringType()),
])

# One golden record. ``picked`` holds the confidence of each current value, so
# that a merge needs this table only and never the whole provenance log.
BUSINESSES = T.StructType(
    [T.StructField("business_id", T.LongType())]
    + [
        T.StructField(name, T.DateType() if name == "incorporation_date" else T.StringType())
        for name in MERGE_FIELDS
    ]
    + [T.StructField("picked", T.StructType(_fields(MERGE_FIELDS, CONFIDENCE)))]
    + _fields(["size_category", "size_confidence"], T.StringType())
    + [
        T.StructField("quality_score", SCORE),
        T.StructField("lead_ready", T.BooleanType()),
        T.StructField("do_not_call", T.BooleanType()),
        T.StructField("do_not_call_reason", T.StringType()),
    ]
    + _fields(
        ["do_not_call_at", "first_seen_at", "last_verified_at", "last_updated_at", "created_at"],
        T.TimestampType(),
    )
)

CONTACTS = T.StructType([
    T.StructField("contact_id", T.StringType()),
    T.StructField("business_id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("title_raw", T.StringType()),
    T.StructField("role_category", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("confidence", CONFIDENCE),
    T.StructField("retrieved_at", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
])

EVENTS = T.StructType([
    T.StructField("business_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("changed_fields", T.ArrayType(T.StringType())),
])

JOB_RUNS = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("records_collected", T.LongType()),
    T.StructField("records_new", T.LongType()),
    T.StructField("records_updated", T.LongType()),
    T.StructField("errors_count", T.LongType()),
    T.StructField("error_detail", T.StringType()),
])

DNC_REQUESTS = T.StructType([
    T.StructField("business_id", T.LongType()),
    T.StructField("requested_by", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("requested_at", T.TimestampType()),
])

REJECTS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("reason", T.StringType()),
])
