"""Business tables derived from the test tables.

The texts are plain SQL that Spark and DuckDB read alike; ``{name}`` stands for
a table. They only shape inputs: all operators run on top of them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import merge, scoring, suppression
from ledgerloom.operators.normalize import normalize_records, split_valid
from ledgerloom.schemas import RAW
from ledgerloom.session import materialize, spread

# The fixed clock of the derived tables.
AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

_NONE = "cast(null as varchar(20))"

RAW_BUSINESS = f"""
select cast(c_custkey as bigint) as seq, c_name as legal_name, {_NONE} as operating_name,
  n_name as province, 'City ' || cast(c_custkey % 20 as varchar(20)) as city,
  cast(c_custkey as varchar(20)) || '  Main St' as address_line1,
  'm' || cast(c_custkey % 10 as varchar(20)) || 'v-' || cast(c_custkey % 9 as varchar(20)) || 't'
    || cast(c_custkey % 7 as varchar(20)) as postal_code,
  {_NONE} as website, {_NONE} as phone, {_NONE} as email, c_mktsegment as industry,
  {_NONE} as naics_code, cast(c_custkey as varchar(20)) as corporation_number,
  {_NONE} as business_number, {_NONE} as incorporation_date, 'active' as business_status,
  cast(c_custkey % 60 as int) as employee_count_min,
  cast(c_custkey % 60 + c_custkey % 13 as int) as employee_count_max,
  'registry' as source_name, 'federal_registry' as source_kind, 'registry.csv' as source_url,
  cast(0.90 as decimal(4,2)) as confidence
from {{customer}} join {{nation}} on c_nationkey = n_nationkey
union all
select 1000000000 + o_orderkey, '  customer#' || lpad(cast(o_custkey as varchar(20)), 9, '0') || ' ',
  'Shop ' || cast(o_orderkey % 500 as varchar(20)), 'Ontario',
  'City ' || cast(o_custkey % 20 as varchar(20)), 'N/A', '',
  'https://www.Firm' || cast(o_custkey as varchar(20)) || '.ca/about',
  '(416) 555-' || lpad(cast(o_custkey % 10000 as varchar(20)), 4, '0'),
  case when o_orderkey % 4 = 0 then 'Info@Firm' || cast(o_custkey as varchar(20)) || '.CA' end,
  {_NONE}, {_NONE}, case when o_orderkey % 3 = 0 then cast(o_custkey as varchar(20)) end, {_NONE},
  cast(cast(o_orderdate as date) as varchar(20)),
  case o_orderstatus when 'F' then 'Active' when 'P' then 'inactive' else 'Issued' end,
  cast(null as int), cast(null as int), 'licence_' || substr(o_orderpriority, 1, 1),
  'municipal_open_data', 'licences.csv', cast(0.70 as decimal(4,2))
from {{orders}}
union all
select 2000000000 + s_suppkey, '--', s_name, 'on', 'City ' || cast(s_suppkey % 20 as varchar(20)),
  {_NONE}, {_NONE}, 'firm' || cast(s_suppkey as varchar(20)) || '.ca',
  '1-416-555-' || lpad(cast(s_suppkey % 10000 as varchar(20)), 4, '0'), {_NONE}, {_NONE}, {_NONE},
  {_NONE}, {_NONE}, {_NONE}, {_NONE}, cast(null as int), cast(null as int), 'directory',
  'business_directory', 'directory.html', cast(0.60 as decimal(4,2))
from {{supplier}}
"""

BIZ_CONTACTS = """
select cast(event_id as varchar(20)) as contact_id, user_id as business_id,
  case when event_id % 4 = 0 then null else 'Person ' || cast(event_id % 97 as varchar(20)) end as full_name,
  event_type as title_raw,
  case event_type when 'signup' then 'owner' when 'view' then 'president' when 'click' then 'it_manager'
    when 'purchase' then 'procurement' else 'other_decision_maker' end as role_category,
  case when event_id % 3 = 0 then null else 'p' || cast(event_id % 97 as varchar(20)) || '@example.com' end as email,
  case when event_id % 5 = 0 then '+1416555' || lpad(cast(event_id % 10000 as varchar(20)), 4, '0') end as phone,
  case when event_id % 7 = 0 then 'corporations_canada_api' else 'company_website_enrichment' end as source_name,
  'page' as source_url, cast(0.50 + (event_id % 5) * 0.10 as decimal(4,2)) as confidence,
  cast(ts as timestamp) as retrieved_at, event_id % 6 <> 0 as is_active
from {events}
"""

BIZ_EVENTS = """
select event_id, user_id as business_id,
  case event_type when 'signup' then 'new_today' when 'view' then 'new_7d' when 'click' then 'new_30d'
    when 'purchase' then 'recently_changed' else 'new_location' end as event_type,
  cast(ts as timestamp) as detected_at
from {events}
"""

JOB_RUNS = """
select event_id as id, 'source_' || cast(user_id % 13 as varchar(20)) as source_name, 'collect' as job_type,
  case event_type when 'error' then 'failed' when 'view' then 'partial_failure' else 'success' end as status,
  cast(ts as timestamp) as started_at, cast(ts as timestamp) as finished_at,
  cast(floor(value) as int) as records_collected, cast(event_id % 50 as int) as records_new,
  cast(event_id % 20 as int) as records_updated, cast(event_id % 7 as int) as errors_count,
  case when event_id % 2 = 0 then 'timeout ' || cast(event_id % 5 as varchar(20)) end as error_detail
from {events}
"""

DNC_REQUESTS = """
select user_id as business_id, 'dashboard' as requested_by, 'manual' as channel,
  case when event_id % 4 = 0 then null else 'asked in call ' || cast(event_id as varchar(20)) end as note,
  cast(ts as timestamp) as requested_at
from {events} where event_type = 'error' and event_id % 10 = 0 and user_id % 3 = 0
"""

SITE_PAGES = """
select page_id, url, html || case page_id % 4
    when 0 then '<p>President: p' || cast(page_id as varchar(20)) || '@Example.com (416) 555-0'
      || cast(100 + page_id % 900 as varchar(20)) || '</p>'
    when 1 then '<p>Our IT Manager</p>' when 2 then '<p>office manager o@example.com</p>' else '' end as html
from {pages}
"""

# Site pages again, under the contact paths of the firms' own hosts.
FIRM_PAGES = """
select page_id, 'https://www.firm' || cast(page_id % 40 as varchar(20)) || '.ca' || case page_id % 5
    when 0 then '/about' when 1 then '/team/' when 2 then '/contact' when 3 then '/products' else '/about-us?x=1' end as url,
  html
from ({site_pages}) as s
"""

# Whole names, in places of their kind.
NAME_POOL = """
select cast(c_custkey as bigint) as seq, n_name as province, c_mktsegment as city, c_name as name
from {customer} join {nation} on c_nationkey = n_nationkey
union all
select 1000000000 + s_suppkey, n_name, 'supplier', s_name from {supplier} join {nation} on s_nationkey = n_nationkey
union all
select 2000000000 + p_partkey, p_brand, p_type, p_name from {part}
"""

TEXTS = {
    "raw_business": RAW_BUSINESS, "biz_contacts": BIZ_CONTACTS, "biz_events": BIZ_EVENTS, "job_runs": JOB_RUNS,
    "dnc_requests": DNC_REQUESTS, "site_pages": SITE_PAGES, "name_pool": NAME_POOL,
}


def tables_in(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an input text over the Parquet tables of a scale factor."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables_in(text)}
    return spark.sql(text, **tables)


def firm_pages_text() -> str:
    return FIRM_PAGES.replace("{site_pages}", SITE_PAGES)


def raw_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive(spark, sf_dir, RAW_BUSINESS).withColumn("extra", F.lit(None))
    return spread(df.select([F.col(f.name).cast(f.dataType) for f in RAW.fields]), "seq")


def good_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_valid(normalize_records(raw_business(spark, sf_dir)))[0]


def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good records with the company each is known to belong to."""
    firm = F.regexp_extract("domain", r"^firm(\d+)\.ca$", 1)
    return good_records(spark, sf_dir).withColumn(
        "business_id", F.coalesce("corporation_number", firm).cast("bigint"))


def history(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    records = materialize(entity_records(spark, sf_dir), "records") if records is None else records
    return merge.record_history(records)


def field_sources(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    return merge.accepted_values(history(spark, sf_dir, records), as_of())


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, BIZ_CONTACTS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, BIZ_EVENTS)


def golden(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Golden records with times spread over the months before the clock."""
    def ago(days: int):
        return as_of() - F.make_dt_interval(days=(F.col("business_id") % days).cast("int"))

    records = entity_records(spark, sf_dir) if records is None else records
    merged = merge.golden_records(merge.with_prior(records, None))
    return merged.select(
        "*", F.lit(0).cast("decimal(5,2)").alias("quality_score"), F.lit(False).alias("lead_ready"),
        F.lit(False).alias("do_not_call"), F.lit(None).cast("string").alias("do_not_call_reason"),
        F.lit(None).cast("timestamp").alias("do_not_call_at"), ago(200).alias("first_seen_at"),
        ago(120).alias("last_verified_at"), ago(45).alias("last_updated_at"), ago(200).alias("created_at"))


def sources(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """(business_id, source_name) of the provenance, one row each."""
    return merge.accepted_sources(history(spark, sf_dir, records))


def scored(spark: SparkSession, sf_dir: str, with_checks: bool = False, records: DataFrame | None = None,
           kept: DataFrame | None = None) -> DataFrame:
    records = materialize(entity_records(spark, sf_dir), "records") if records is None else records
    kept = sources(spark, sf_dir, records) if kept is None else kept
    return scoring.rescore(
        golden(spark, sf_dir, records), contacts(spark, sf_dir), kept, as_of(), with_checks)


def scored_with_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scored businesses and their sources, each worked out once."""
    records = materialize(entity_records(spark, sf_dir), "records")
    kept = materialize(sources(spark, sf_dir, records), "sources")
    return materialize(scored(spark, sf_dir, records=records, kept=kept), "scored"), kept


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, DNC_REQUESTS)


def businesses(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Golden records, scored and with do-not-call marks."""
    return suppression.mark_do_not_call(scored(spark, sf_dir, records=records), requests(spark, sf_dir))
