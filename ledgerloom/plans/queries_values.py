"""Queries of the column functions and the schema mapping (N…, M…)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import labels, measures, reach, text
from ledgerloom.operators.keys import name_key, postal_name_key
from ledgerloom.operators.normalize import normalize_records
from ledgerloom.plans import inputs, oracle
from ledgerloom.plans.book import Book
from ledgerloom.sources import mapping, registry

book = Book()


def cases(table: str, key: str, *values: str) -> str:
    """Text in many forms: the forms take turns along a table."""
    arms = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"select {key} as id, case {key} % {len(values)} {arms} end as v from {{{table}}}"


CUST = "cast(c_custkey as varchar(20))"
ORDER = "cast(o_orderkey as varchar(20))"
PHONE_LINE = "lpad(cast(o_custkey % 10000 as varchar(20)), 4, '0')"

book.scalar(
    "n01_normalize_province",
    cases("customer", "c_custkey", "'Ontario'", "' on '", "'BRITISH COLUMBIA'", "c_mktsegment", "''", "null",
          "'quebec'", "'Newfoundland and Labrador'", "'yt'"),
    text.normalize_province, oracle.province("v"))
book.scalar(
    "n02_normalize_postal_code",
    cases("customer", "c_custkey", f"'m' || {CUST} || 'v'", "'m5h1a1'", "'H2X-1Y4'", "' k1a 0b1 '", "''", "null",
          f"'  90210-' || {CUST}"),
    text.normalize_postal_code, oracle.postal("v"))
book.scalar(
    "n03_normalize_phone",
    cases("orders", "o_orderkey", f"'(416) 555-' || {PHONE_LINE}", f"'1-604-555-' || {PHONE_LINE}",
          f"'+1 905.555.' || {PHONE_LINE}", "'555-1234'", ORDER, f"'416-555-' || {PHONE_LINE} || ' ext. 22'",
          f"'(911) 555-' || {PHONE_LINE}", "null", f"'514 155 ' || {PHONE_LINE}", "'123'", "'+44 20 7946 0958'"),
    reach.normalize_phone, oracle.phone("v"))
book.scalar(
    "n04_normalize_domain",
    cases("customer", "c_custkey", f"'https://www.Firm' || {CUST} || '.ca/about'", f"'shop.firm' || {CUST} || '.on.ca'",
          f"'http://firm' || {CUST} || '.co.uk:8080/x?y=1'", "'N/A'", "'localhost'", "''", "null",
          f"'www.a.b.firm' || {CUST} || '.com'", "'ca'", "'on.ca'", f"'firm' || {CUST} || '.com.ng'",
          f"'https://shop.firm' || {CUST} || '.co.ke/x'", "'com.ng'", "'org.zz'",
          f"'https://shop.firm' || {CUST} || '.any.ck/'", "'any.ck'", "'shop.www.ck'", "'www.ck'", "'ck'",
          f"'a.firm' || {CUST} || '.ward.kobe.jp'", "'ward.kobe.jp'", "'www.city.kobe.jp'", "'kobe.jp'", "'x.kobe.jp'"),
    reach.normalize_domain, oracle.domain("v"))
book.scalar(
    "n05_clean_string",
    cases("orders", "o_orderkey", "o_orderpriority", "' N/A '", "'n / a'", "'None'", "'--'", "'   '", "'NIL'",
          f"'  ' || {ORDER} || ' '", "'nab'", "'-'", "null"),
    text.clean_string, oracle.clean("v"))
book.scalar(
    "n06_normalize_name",
    cases("customer", "c_custkey", "'  Acme   ' || c_name || '  '", "c_name", "'na'", "'a  b   c'"),
    text.normalize_name, oracle.name("v"))
book.scalar(
    "n07_clean_lower",
    cases("customer", "c_custkey", f"' HTTP://Firm' || {CUST} || '.CA '", "'NONE'", "c_name", "''"),
    text.clean_lower, oracle.clean("lower(v)"))
book.scalar(
    "n08_normalize_status",
    cases("orders", "o_orderkey", "o_orderstatus", "''", "null", "'ACTIVE'", "'Issued'"),
    text.normalize_status, "lower(coalesce(nullif(v, ''), 'unknown'))")

NORM_COLUMNS = [
    "seq", "legal_name", "operating_name", "province", "city", "address_line1", "postal_code", "website", "domain",
    "phone", "email", "industry", "naics_code", "corporation_number", "business_number", "incorporation_date",
    "business_status", "employee_count_min", "employee_count_max", "source_name", "source_kind", "source_url",
    "confidence",
]


@book.add("n09_normalize_record", f"select {', '.join(NORM_COLUMNS)} from norm")
def normalized(spark, sf_dir):
    return normalize_records(inputs.raw_business(spark, sf_dir)).select(NORM_COLUMNS)


@book.add("n10_name_key", "select seq, name_key from keyed")
def name_keys(spark, sf_dir):
    records = normalize_records(inputs.raw_business(spark, sf_dir))
    return records.select("seq", name_key(F.col("legal_name"), F.col("operating_name")).alias("name_key"))


@book.add("n11_postal_name_key", "select seq, postal_name_key from keyed")
def postal_name_keys(spark, sf_dir):
    records = normalize_records(inputs.raw_business(spark, sf_dir))
    return records.select("seq", postal_name_key(F.col("postal_code"), F.col("name_key")).alias("postal_name_key"))


book.scalar(
    "n12_registry_status",
    cases("orders", "o_orderkey", "'Active'", "' ACTIF '", "'Dissoute'", "'amalgamated'", "o_orderstatus", "''", "null",
          "'Inactive'", "'dissolved'"),
    labels.registry_status,
    "case lower(trim(coalesce(v, ''))) when 'active' then 'active' when 'actif' then 'active' "
    "when 'dissolved' then 'dissolved' when 'dissoute' then 'dissolved' when 'amalgamated' then 'dissolved' "
    "when 'inactive' then 'inactive' when '' then 'active' else lower(trim(v)) end")
book.scalar(
    "n13_digits_to_int",
    cases("part", "p_partkey", "cast(p_size as varchar(20))", "' 12 '", "'3a'", "''", "null", "'-5'", "'007'"),
    text.digits_to_int, "case when regexp_full_match(trim(v), '[0-9]+') then cast(trim(v) as int) end")
book.scalar(
    "n14_portal_status",
    cases("orders", "o_orderkey", "'Issued'", "'VALID'", "'Closed'", "'cancelled'", "'Dissolved'", "o_orderstatus",
          "''", "null", "'suspended'", "'Registered'"),
    labels.portal_status,
    "case when v is null or v = '' then null when lower(v) in ('active', 'issued', 'valid', 'open', 'registered') "
    "then 'active' when lower(v) in ('inactive', 'closed', 'cancelled', 'expired', 'suspended') then 'inactive' "
    "when lower(v) = 'dissolved' then 'dissolved' else 'unknown' end")
book.scalar(
    "n15_entity_label",
    cases("part", "p_partkey", "'BC'", "'S'", "'XP'", "'LLC'", "p_brand", "null", "'A'", "'SP'"),
    labels.entity_label, oracle.case_of("v", labels.ENTITY_TYPES, "v"))
book.scalar(
    "n16_officer_role",
    cases("events", "event_id", "event_type", "'Vice-President'", "'Managing Director'", "'CEO'", "'Co-Founder'",
          "' General Manager '", "'Owner/Operator'", "'Chief Executive Officer'", "'VP Sales'"),
    labels.officer_role, oracle.officer_role("v"))
book.scalar(
    "n17_page_title_role",
    cases("pages", "page_id", *[f"'{p}'" for p in labels.PAGE_TITLES], "url"),
    labels.page_title_role, oracle.case_of("v", labels.PAGE_TITLES, "null"))
HTML = inputs.SITE_PAGES.replace("page_id, url, html ||", "page_id as id, html ||").replace(" as html", " as v")
book.scalar(
    "n18_first_email", HTML, reach.first_email,
    r"lower(nullif(regexp_extract(v, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', 0), ''))")
book.scalar(
    "n19_first_phone", HTML, reach.first_phone,
    r"nullif(regexp_extract(v, '(\+?1[\s.\-]?)?\(?[0-9]{3}\)?[\s.\-]?[0-9]{3}[\s.\-]?[0-9]{4}', 0), '')")
book.scalar(
    "n20_size_class", "select p_partkey as id, p_partkey % 1500 - 2 as v from {part}",
    measures.size_class, oracle.size_class("v"))

SIZES = """
select p_partkey as id, cast(p_partkey % 61 as int) as low,
  case when p_partkey % 4 <> 0 then cast(p_partkey % 61 + p_size as int) end as high,
  case when p_partkey % 9 = 0 then cast(p_partkey % 1300 as int) end as exact
from {part}
"""
_MID = "((low + coalesce(nullif(high, 0), low)) // 2)"


@book.add("n21_classify_size", f"""
select id, case when exact <> 0 then {oracle.size_class('exact')} when low <> 0 then {oracle.size_class(_MID)} end
  as size_category, case when exact <> 0 then 'confirmed' else 'estimated' end as size_confidence
from ({oracle.plain(SIZES)}) as t""")
def classified(spark, sf_dir):
    size = measures.classify_size(F.col("low"), F.col("high"), F.col("exact"))
    return inputs.derive(spark, sf_dir, SIZES).select("id", size.alias("size")).select("id", "size.*")


@book.add("n22_score_business", """
select business_id, quality_score, phone is not null as has_verified_phone, website is not null as has_website,
  address_line1 is not null and postal_code is not null as has_verified_address,
  size_category is not null as has_employee_info, contact_count > 0 as has_decision_maker,
  business_id % 120 <= 90 as recently_verified, source_count >= 2 as multiple_sources from scored""")
def scores(spark, sf_dir):
    scored = inputs.scored(spark, sf_dir, with_checks=True)
    return scored.select("business_id", "quality_score", "checks.*")


@book.add("n23_is_lead_ready", "select business_id, quality_score >= 50 as ready from scored")
def ready(spark, sf_dir):
    return inputs.businesses(spark, sf_dir).select(
        "business_id", measures.is_lead_ready(F.col("quality_score")).alias("ready"))


book.scalar(
    "n24_digits_only",
    cases("customer", "c_custkey", f"'BC-' || {CUST}", f"{CUST}", "'none'", "''", "null", f"'12 ' || {CUST} || '-7'"),
    text.digits_only, "nullif(regexp_replace(v, '[^0-9]', '', 'g'), '')")
book.scalar(
    "n25_url_host",
    cases("pages", "page_id", "url", "'https://www.Firm' || cast(page_id as varchar(20)) || '.ca/about'",
          "'firm' || cast(page_id as varchar(20)) || '.ca'", "'firm.ca:8080/x'", "''", "null"),
    reach.url_host, oracle.host("v"))


@book.add("n26_display_values", """
select business_id, coalesce(legal_name, operating_name) as display_name,
  cast(round_even(quality_score, 0) as int) as shown_score,
  cast(round(cast(0.50 + (business_id % 5) * 0.10 as decimal(4,2)) * 100, 0) as int) as shown_percent
from businesses""")
def display_values(spark, sf_dir):
    confidence = (F.lit(0.5) + (F.col("business_id") % 5) * 0.1).cast("decimal(4,2)")
    return inputs.businesses(spark, sf_dir).select(
        "business_id", measures.display_name(F.col("legal_name"), F.col("operating_name")).alias("display_name"),
        measures.rounded_score(F.col("quality_score")).alias("shown_score"),
        measures.percent(confidence).alias("shown_percent"))


@book.add("n27_iso_text", """
select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' as stamp,
  strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def iso_text(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        measures.iso_timestamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"),
        measures.iso_date(F.col("o_orderdate").cast("date")).alias("day"))


book.scalar(
    "n28_unaccent", "select doc_id as id, text as v from {documents}", text.unaccent,
    "replace(replace(replace(strip_accents(v), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')")

# Headers of one landed file per portal: what the table names look like when
# they stand for licence data.
HEADERS = """
select source, position, header from (
  select 'source_' || cast(p_partkey as varchar(20)) as source, 0 as position, 'Email Address' as header, p_partkey from {part}
  union all select 'source_' || cast(p_partkey as varchar(20)), 1, p_type, p_partkey from {part}
  union all select 'source_' || cast(p_partkey as varchar(20)), 2,
    case p_partkey % 3 when 0 then 'Trade Name' when 1 then 'DBA' else 'Business Name' end, p_partkey from {part}
  union all select 'source_' || cast(p_partkey as varchar(20)), 3,
    case p_partkey % 2 when 0 then 'Street Address' else 'Licence Status' end, p_partkey from {part}
  union all select 'source_' || cast(p_partkey as varchar(20)), 4,
    case p_partkey % 4 when 0 then 'COMPANY' when 1 then 'legal_name' when 2 then 'City' else 'Telephone' end, p_partkey from {part}
) as h
"""


def _hint_values(hints) -> str:
    return ", ".join(f"('{f}', {i}, '{w}')" for f, words in hints.items() for i, w in enumerate(words))


def _match_sql(hints) -> str:
    return f"""
select source, field, header from (
  select source, field, header, row_number() over (partition by source, field order by place, position) as k
  from ({oracle.plain(HEADERS)}) as h join (values {_hint_values(hints)}) as w(field, place, hint)
    on contains(lower(header), hint))
where k = 1"""


@book.add("m01_match_headers", _match_sql(mapping.CKAN_HINTS))
def matched_headers(spark, sf_dir):
    return mapping.match_header_table(inputs.derive(spark, sf_dir, HEADERS), mapping.CKAN_HINTS)


_OVERRIDES = {"legal_name": ["business name", "dba"], "city": ["ward", "city"], "operating_name": ["company"]}


@book.add("m02_hint_overrides", _match_sql({**mapping.CKAN_HINTS, **_OVERRIDES}))
def overridden_headers(spark, sf_dir):
    hints = mapping.effective_hints(mapping.CKAN_HINTS, _OVERRIDES)
    return mapping.match_header_table(inputs.derive(spark, sf_dir, HEADERS), hints)


@book.add("m03_trimmed_getter", """
select o_orderkey as id, case when length(v) > 0 then trim(v) end as value, cast(null as varchar) as unmapped from (
  select o_orderkey, case o_orderkey % 4 when 0 then '' when 1 then '  ' when 2 then ' ' || o_orderpriority else null end as v
  from orders)""")
def trimmed(spark, sf_dir):
    source = cases("orders", "o_orderkey", "''", "'  '", "' ' || o_orderpriority", "null")
    return inputs.derive(spark, sf_dir, source).select(
        "id", mapping.mapped("v").alias("value"), mapping.mapped(None).alias("unmapped"))


_REGISTRY_NAMES = [p.name for p in registry.PORTALS]


@book.add("m04_source_registry", f"""
select seq, p.source_name, p.province, p.source_kind, p.confidence
from (select seq, case seq % 14 {' '.join(f"when {i} then '{n}'" for i, n in enumerate(_REGISTRY_NAMES))} end as source_name
  from raw_business) r
join (values {', '.join(f"('{p.name}', '{p.province}', '{p.kind}', cast({p.confidence} as decimal(4,2)))" for p in registry.PORTALS)})
  as p(source_name, province, source_kind, confidence) using (source_name)""")
def registered(spark, sf_dir):
    raw = inputs.raw_business(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in _REGISTRY_NAMES])
    named = raw.withColumn("source_name", F.get(names, (F.col("seq") % 14).cast("int"))).where(
        F.col("source_name").isNotNull())
    return registry.apply_registry(named, registry.registry_table(spark)).select(
        "seq", "source_name", "province", "source_kind", "confidence")
