"""Scans, sinks and page extraction (S…, C…, U1).

A file scan is checked as a round trip: a derived table is written to the shared
folder in the source's format, scanned, and compared with the table.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom.functions import labels
from ledgerloom.operators import contacts as ct
from ledgerloom.operators import export, leads
from ledgerloom.plans import inputs, oracle
from ledgerloom.plans.book import Book
from ledgerloom.plans.pipeline import collect, with_arrival_order, with_place
from ledgerloom.plans.queries_leads import EXPORT, NO_CONTACT
from ledgerloom.session import scratch_path
from ledgerloom.sources import files, lines, listings, registry, topics
from ledgerloom.sources.tables import TableStore

book = Book()


def landed_csv(df, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


FEDERAL = """
select n_name as `Province/territory`,
  case when c_custkey % 5 = 0 then '' else c_name || ', "Inc" ' || cast(c_custkey as varchar(20)) end as `Corporate name - form 1`,
  case when c_custkey % 10 = 0 then '' else 'Form 2 of ' || c_name end as `Corporate name - form 2`,
  case c_custkey % 4 when 0 then 'Active' when 1 then 'Dissoute' when 2 then '' else 'Pending' end as `Status`,
  ' ' || cast(c_custkey as varchar(20)) as `Corporation number`,
  case when c_custkey % 3 = 0 then '' else 'BN' || cast(c_custkey as varchar(20)) end as `Business number (BN)`,
  '2020-01-15' as `Anniversary date`, cast(c_custkey as varchar(20)) || ' Main St' as `Street`,
  case when c_custkey % 2 = 0 then ' Unit 5' else '' end as `Street 2`, 'City ' || cast(c_custkey % 20 as varchar(20)) as `City/town`,
  'M5H 1A1' as `Postal code`, cast(c_custkey % 60 as varchar(20)) as `Minimum number of directors`,
  case when c_custkey % 7 = 0 then 'many' else cast(c_custkey % 60 + 3 as varchar(20)) end as `Maximum number of directors`
from {customer} join {nation} on c_nationkey = n_nationkey
"""
FEDERAL_COLUMNS = [
    "legal_name", "province", "city", "address_line1", "postal_code", "corporation_number", "business_number",
    "incorporation_date", "business_status", "employee_count_min", "employee_count_max", "source_name", "source_kind",
    "confidence",
]
FEDERAL_SQL = """
select * from (
  select case when c_custkey % 5 <> 0 then c_name || ', "Inc" ' || c_custkey when c_custkey % 10 <> 0
      then 'Form 2 of ' || c_name end as legal_name, n_name as province, 'City ' || (c_custkey % 20) as city,
    c_custkey || ' Main St' || case when c_custkey % 2 = 0 then ' Unit 5' else '' end as address_line1,
    'M5H 1A1' as postal_code, cast(c_custkey as varchar) as corporation_number,
    case when c_custkey % 3 <> 0 then 'BN' || c_custkey end as business_number, '2020-01-15' as incorporation_date,
    case c_custkey % 4 when 0 then 'active' when 1 then 'dissolved' when 2 then 'active' else 'pending' end as business_status,
    cast(c_custkey % 60 as int) as employee_count_min,
    case when c_custkey % 7 <> 0 then cast(c_custkey % 60 + 3 as int) end as employee_count_max,
    'corporations_canada_federal' as source_name, 'federal_registry' as source_kind, cast(0.9 as decimal(4,2)) as confidence
  from customer join nation on c_nationkey = n_nationkey)
where legal_name is not null"""


@book.add("s01_federal_scan", FEDERAL_SQL + " and upper(province) = 'NATION_3'")
def federal(spark, sf_dir):
    path = landed_csv(inputs.derive(spark, sf_dir, FEDERAL), "federal")
    return files.federal_registry(spark, path, province="nation_3").select(FEDERAL_COLUMNS)


@book.add("s02_inactive_files", f"{FEDERAL_SQL} union all {FEDERAL_SQL}")
def federal_with_inactive(spark, sf_dir):
    df = inputs.derive(spark, sf_dir, FEDERAL)
    return files.federal_registry(
        spark, landed_csv(df, "active"), landed_csv(df, "inactive")).select(FEDERAL_COLUMNS)


# Three kinds of rows: one line, three lines (a blank one among them), and one field too many.
BROKEN_LINES = """
select cast(o_orderkey as varchar(20)) || ',12" board,' || o_orderstatus as line from {orders} where o_orderkey % 3 = 0
union all
select '"' || cast(o_orderkey as varchar(20)) || '","Clerk' || chr(10) || chr(10) || o_orderpriority || ', ""' || cast(o_custkey as varchar(20))
  || '""' || '",' || o_orderstatus from {orders} where o_orderkey % 3 = 1
union all
select cast(o_orderkey as varchar(20)) || ',"a' || chr(10) || 'b",,' || o_orderstatus from {orders} where o_orderkey % 3 = 2
"""


@book.add("s01b_quoted_line_breaks", """
select cast(o_orderkey as varchar) as key, '12" board' as note, o_orderstatus as status, null as reason from orders where o_orderkey % 3 = 0
union all select cast(o_orderkey as varchar), 'Clerk' || chr(10) || chr(10) || o_orderpriority || ', "' || o_custkey || '"', o_orderstatus, null
from orders where o_orderkey % 3 = 1
union all select null, o_orderkey || ',"a' || chr(10) || 'b",,' || o_orderstatus, null, 'number of fields' from orders where o_orderkey % 3 = 2""")
def quoted_line_breaks(spark, sf_dir):
    """Files cut into splits anywhere, quoted line breaks included: records come back whole, the others with a reason."""
    head, body = scratch_path(spark, "head"), scratch_path(spark, "body")
    spark.range(1).select(F.lit("key,note,status").alias("line")).write.text(head)
    inputs.derive(spark, sf_dir, BROKEN_LINES).write.text(body)
    records, malformed = lines.read_records(spark, [head, body], strict=True)
    none = F.lit(None).cast("string")
    return records.select("key", "note", "status", none.alias("reason")).unionByName(
        malformed.select(none.alias("key"), F.col("line").alias("note"), none.alias("status"), "reason"))


PORTAL_COLUMNS = [
    "legal_name", "operating_name", "province", "city", "address_line1", "postal_code", "phone", "email", "website",
    "industry", "incorporation_date", "business_status", "source_name", "source_kind", "confidence",
]
# Licence rows under the headers of two resources of one dataset.
CKAN_A = """
select ' Customer ' || cast(o_custkey as varchar(20)) as `Legal Name`, 'Shop ' || cast(o_orderkey as varchar(20)) as `Trade Name`,
  cast(o_orderkey as varchar(20)) || ' King St, "Rear"' as `Street Address`, 'Toronto' as `Municipality`, 'M5H 1A1' as `Postal Code`,
  o_orderpriority as `Licence Type`, cast(cast(o_orderdate as date) as varchar(20)) as `Issued Date`, o_orderstatus as `Status`
from {orders} where o_orderkey % 2 = 0
"""
CKAN_B = """
select o_orderstatus as `STATUS`, '' as `E-mail`, 'Company ' || cast(o_custkey as varchar(20)) as `Company`,
  '416-555-0100' as `Telephone`, case when o_orderkey % 3 = 0 then '' else 'c' || cast(o_custkey as varchar(20)) || '@x.ca' end as `Email`
from {orders} where o_orderkey % 2 = 1
"""


@book.add("s03_ckan_scan", """
select 'Customer ' || o_custkey as legal_name, 'Shop ' || o_orderkey as operating_name, 'ON' as province, 'Toronto' as city,
  o_orderkey || ' King St, "Rear"' as address_line1, 'M5H 1A1' as postal_code, null as phone, null as email, null as website,
  o_orderpriority as industry, cast(cast(o_orderdate as date) as varchar) as incorporation_date, o_orderstatus as business_status,
  'toronto_business_licences' as source_name, 'municipal_open_data' as source_kind, cast(0.7 as decimal(4,2)) as confidence
from orders where o_orderkey % 2 = 0
union all
select 'Company ' || o_custkey, null, 'ON', null, null, null, '416-555-0100',
  case when o_orderkey % 3 <> 0 then 'c' || o_custkey || '@x.ca' end, null, null, null, o_orderstatus,
  'toronto_business_licences', 'municipal_open_data', 0.7
from orders where o_orderkey % 2 = 1""")
def ckan(spark, sf_dir):
    resources = [landed_csv(inputs.derive(spark, sf_dir, text), "ckan") for text in (CKAN_A, CKAN_B)]
    return files.portal_scan(spark, registry.portal("toronto_business_licences"), resources).select(PORTAL_COLUMNS)


MANIFESTS = """
select cast(s_suppkey as varchar(20)) as dataset,
  '{{"result": {{"resources": [{{"format": "' || case when s_suppkey % 3 = 0 then 'JSON' else 'csv' end || '", "url": "a'
  || cast(s_suppkey as varchar(20)) || '"}}, {{"format": "XLSX", "url": "b"}}, {{"format": "CSV", "url": "c'
  || cast(s_suppkey as varchar(20)) || '"}}, {{"format": "PDF", "url": ""}}]}}}}' as manifest
from {supplier} where s_suppkey % 2 = 0
union all
select 'x' || cast(s_suppkey as varchar(20)),
  '{{"result": {{"resources": [{{"format": "XLSX", "url": "b"}}, {{"format": "PDF", "url": ""}}, {{"url": "d"}}]}}}}'
from {supplier} where s_suppkey % 2 = 1
"""


@book.add("s04_resource_pick", """
select cast(s_suppkey as varchar) as dataset, 'c' || s_suppkey as url from supplier where s_suppkey % 2 = 0
union all select cast(s_suppkey as varchar), 'a' || s_suppkey from supplier where s_suppkey % 2 = 0 and s_suppkey % 3 <> 0
union all select 'x' || s_suppkey, unnest(['b', 'd']) from supplier where s_suppkey % 2 = 1""")
def resource_pick(spark, sf_dir):
    return files.csv_resources(inputs.derive(spark, sf_dir, MANIFESTS))


SOCRATA = """
select 'Cust ' || cast(o_custkey as varchar(20)) as `company`, 'Shop ' || cast(o_orderkey as varchar(20)) as `tradename`,
  cast(o_orderkey as varchar(20)) || ' Ave' as `address`, o_orderpriority as `licencetypes`,
  cast(cast(o_orderdate as date) as varchar(20)) as `licenceissuedate`, o_orderstatus as `jobstatus`, 'Beltline' as `community`
from {orders}
"""


@book.add("s05_socrata_scan", """
select 'Cust ' || o_custkey as legal_name, 'Shop ' || o_orderkey as operating_name, 'AB' as province, 'Beltline' as city,
  o_orderkey || ' Ave' as address_line1, null as postal_code, null as phone, null as email, null as website,
  o_orderpriority as industry, cast(cast(o_orderdate as date) as varchar) as incorporation_date,
  o_orderstatus as business_status, 'calgary_business_licences' as source_name, 'municipal_open_data' as source_kind,
  cast(0.7 as decimal(4,2)) as confidence from orders""")
def socrata(spark, sf_dir):
    pages = inputs.derive(spark, sf_dir, SOCRATA).repartition(3)
    return files.portal_scan(
        spark, registry.portal("calgary_business_licences"), [landed_csv(pages, "pages")]).select(PORTAL_COLUMNS)


OPENDATASOFT = """
select 'Shop ' || cast(o_orderkey as varchar(20)) as `BusinessName`, case o_orderstatus when 'F' then 'Issued' else 'Gone' end as `Status`,
  case when o_orderkey % 4 = 0 then 'Burnaby' else '' end as `City`, cast(o_orderkey as varchar(20)) as `House`,
  'West St' as `Street`, o_orderpriority as `BusinessType`, cast(cast(o_orderdate as date) as varchar(20)) as `IssuedDate`
from {orders}
"""


@book.add("s06_opendatasoft_scan", """
select 'Shop ' || o_orderkey as legal_name, 'Shop ' || o_orderkey as operating_name, 'BC' as province,
  case when o_orderkey % 4 = 0 then 'Burnaby' else 'Vancouver' end as city, cast(o_orderkey as varchar) as address_line1,
  null as postal_code, null as phone, null as email, null as website, o_orderpriority as industry,
  cast(cast(o_orderdate as date) as varchar) as incorporation_date, 'active' as business_status,
  'vancouver_business_licences' as source_name, 'municipal_open_data' as source_kind, cast(0.7 as decimal(4,2)) as confidence
from orders where o_orderstatus = 'F'""")
def opendatasoft(spark, sf_dir):
    path = landed_csv(inputs.derive(spark, sf_dir, OPENDATASOFT), "export")
    return files.portal_scan(spark, registry.portal("vancouver_business_licences"), [path]).select(PORTAL_COLUMNS)


TOPIC_ROWS = """
select '{{"total": 2, "results": [{{"source_id": "BC' || cast(c_custkey as varchar(20)) || '", "type": "'
  || case c_custkey % 3 when 0 then 'BC' when 1 then 'SP' else 'ZZ' end || '", "inactive": '
  || case when c_custkey % 4 = 0 then 'true' else 'false' end
  || ', "names": [{{"type": "business_number", "text": "123"}}, {{"type": "entity_name", "text": " '
  || c_name || ' "}}, {{"type": "trade_name", "text": "First"}}, {{"type": "doing_business_as", "text": "Last '
  || cast(c_custkey as varchar(20)) || '"}}], "attributes": [{{"type": "x", "value": "no"}}, {{"type": "registration_date", "value": "2024-01-'
  || lpad(cast(1 + c_custkey % 28 as varchar(20)), 2, '0') || 'T08:00:00"}}]}}, {{"source_id": "", "type": "", "names": '
  || case when c_custkey % 2 = 0 then '[]' else '[{{"type": "other", "text": "Only ' || c_name || '"}}]' end
  || ', "attributes": []}}]}}' as payload
from {customer}
"""
TOPIC_SQL = """
select c_name as legal_name, 'Last ' || c_custkey as operating_name, 'BC' || c_custkey as corporation_number,
  case when c_custkey % 4 = 0 then 'dissolved' else 'active' end as business_status,
  '2024-01-' || lpad(cast(1 + c_custkey % 28 as varchar), 2, '0') as incorporation_date,
  case c_custkey % 3 when 0 then 'BC Company' when 1 then 'BC Sole Proprietorship' else 'ZZ' end as industry from customer
union all
select 'Only ' || c_name, null, null, 'active', null, null from customer where c_custkey % 2 = 1
"""
TOPIC_COLUMNS = ["legal_name", "operating_name", "corporation_number", "business_status", "incorporation_date", "industry"]


@book.add("s07_topic_scan", TOPIC_SQL)
def topic_scan(spark, sf_dir):
    return topics.topic_records(inputs.derive(spark, sf_dir, TOPIC_ROWS)).select(TOPIC_COLUMNS)


@book.add("s08_new_registrations",
          f"select * from ({TOPIC_SQL}) where incorporation_date is null or incorporation_date >= '2024-01-15'")
def new_registrations(spark, sf_dir):
    pages = inputs.derive(spark, sf_dir, TOPIC_ROWS)
    return topics.new_topic_records(pages, inputs.as_of("2024-01-22 00:00:00")).select(TOPIC_COLUMNS)


LISTING_PAGES = """
select '<html><div class="results">' || case when s_suppkey % 3 = 0
  then '<div class="listing promo"><h3 class="item-Name">Firm &amp; ' || s_name || '</h3><span class="the-phone"> 416 <b>555</b> </span>'
    || '<span class="street-address">1  King <i>St</i></span><a class="mlr__submenu__item" href="/internal">x</a></div>'
    || '<div class="listing"><p>no name here</p></div>'
  else '<div class="x listing__content__wrapper"><a class="listing__name--link jsListingName" href="#">' || s_name
    || '</a><div class="listing__address--full"><span>' || cast(s_suppkey as varchar(20)) || ' Main St,</span> Toronto</div>'
    || '<a class="mlr__item__cta" data-phone="416-555-' || lpad(cast(s_suppkey % 10000 as varchar(20)), 4, '0')
    || '">Call</a><a class="mlr__submenu__item" href="https://firm' || cast(s_suppkey as varchar(20)) || '.ca/">web</a></div>'
    || '<div class="listing__content__wrapper"><a class="listing__name--link"><b>Second</b> Co</a></div>' end
  || '</div></html>' as html, 'Retail Stores' as query, 'Toronto' as city, 'ON' as province,
  'page/' || cast(s_suppkey as varchar(20)) as url
from {supplier}
"""


@book.add("s09_listing_scan", """
select case when s_suppkey % 3 = 0 then 'Firm & ' || s_name else s_name end as legal_name, 'Retail Stores' as industry,
  case when s_suppkey % 3 = 0 then '1 King St' else s_suppkey || ' Main St, Toronto' end as address_line1,
  case when s_suppkey % 3 = 0 then '416555' else '416-555-' || lpad(cast(s_suppkey % 10000 as varchar), 4, '0') end as phone,
  case when s_suppkey % 3 <> 0 then 'https://firm' || s_suppkey || '.ca/' end as website, 'page/' || s_suppkey as source_url
from supplier
union all
select 'SecondCo', 'Retail Stores', null, null, null, 'page/' || s_suppkey from supplier where s_suppkey % 3 <> 0""")
def listing_scan(spark, sf_dir):
    found = listings.listing_records(inputs.derive(spark, sf_dir, LISTING_PAGES))
    return found.select("legal_name", "industry", "address_line1", "phone", "website", "source_url")


def _as_written(column: str) -> str:
    """A value as the file shows it."""
    if column in ("first_seen_at", "last_verified_at"):
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S') || 'Z'"
    return f"cast({column} as varchar)"


@book.add("s11_csv_export", f"""
select row_number() over (order by quality_score desc, business_id) - 1 as place,
  {', '.join(f"coalesce({_as_written(c)}, '') as {c}" for c in export.EXPORT_COLUMNS)}
from ({EXPORT.replace('select b.legal_name', 'select b.business_id, b.legal_name')})""")
def csv_export(spark, sf_dir):
    """Written as CSV files and read again: every column, in the order over all files. Quotes and commas
    come back."""
    rows = export.export_rows(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir))
    path = scratch_path(spark, "export")
    export.write_export(rows, path)
    back = with_arrival_order(with_place(files.read_csv(spark, path), 0))
    return back.select(F.col("seq").alias("place"), *[F.coalesce(c, F.lit("")).alias(c) for c in export.EXPORT_COLUMNS])


@book.add("s13_table_store", "select contact_id, business_id, role_category, confidence, is_active from biz_contacts")
def table_store(spark, sf_dir):
    """Two versions are written; a reader sees the rows of both."""
    store = TableStore(spark, scratch_path(spark, "tables"))
    rows = inputs.contacts(spark, sf_dir)
    for half in [rows.where("business_id % 2 = 0"), rows.where("business_id % 2 = 1")]:
        version = store.begin()
        store.upsert("contacts", half, version)
        store.commit(version)
    return store.read("contacts").select("contact_id", "business_id", "role_category", "confidence", "is_active")


def _collected(spark, sf_dir):
    """Three sources and one that cannot be read."""
    raw = inputs.raw_business(spark, sf_dir).drop("seq")

    def only(kind):
        return lambda _: raw.where(F.col("source_kind") == kind)

    kinds = ["federal_registry", "municipal_open_data", "business_directory"]
    sources = {kind: only(kind) for kind in kinds} | {"gone": lambda s: s.read.csv(scratch_path(s, "nowhere"))}
    return collect(spark, sources)


@book.add("s14_source_union", """
select source_kind as source, count(*) as n, false as failed from raw_business group by 1
union all select 'gone', 0, true""")
def source_union(spark, sf_dir):
    """What each source brought, the one that failed included."""
    whole, status, _ = _collected(spark, sf_dir)
    held = whole.groupBy(F.col("source_kind").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return status.join(held, status["source_name"] == held["source"], "left").select(
        F.col("source_name").alias("source"), F.coalesce("n", F.lit(0)).alias("n"), (F.col("status") == "failed").alias("failed"))


@book.add("u01_union_all", """
select source_name, count(*) as n, count(distinct legal_name) as names,
  case source_kind when 'federal_registry' then 0 when 'municipal_open_data' then 1 else 2 end as place
from raw_business group by 1, 4""")
def union_all(spark, sf_dir):
    """All records of all sources; sources follow each other in their order, without gaps."""
    whole, _, _ = _collected(spark, sf_dir)
    kinds = whole.groupBy("source_kind").agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("held"))
    # Three rows: a source's place is told by how many records came before it.
    places = kinds.select("source_kind", F.when(
        F.col("low") == F.sum("held").over(Window.orderBy("low")) - F.col("held"), F.row_number().over(Window.orderBy("low")) - 1).alias("place"))
    return whole.join(places, "source_kind").groupBy("source_name", "place").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("legal_name").alias("names"))


_EMAIL = r"lower(nullif(regexp_extract(near, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}', 0), ''))"
_PHONE = r"nullif(regexp_extract(near, '(\+?1[\s.\-]?)?\(?[0-9]{3}\)?[\s.\-]?[0-9]{3}[\s.\-]?[0-9]{4}', 0), '')"
_PHRASES = ", ".join(f"({i}, '{p}', '{r}')" for i, (p, r) in enumerate(labels.PAGE_TITLES.items()))


def extraction(pages: str) -> str:
    return f"""
select page_id, url as source_url, phrase_order, title_raw, role_category, {_EMAIL} as email, {_PHONE} as phone,
  cast(0.5 as decimal(4,2)) as confidence
from (select *, substr(html, greatest(pos - 201, 0) + 1, pos - 1 + 200 - greatest(pos - 201, 0)) as near from (
  select *, strpos(lower(html), title_raw) as pos from {pages}
  join (values {_PHRASES}) as p(phrase_order, title_raw, role_category) on contains(lower(html), title_raw)))"""


@book.add("c01_contact_extraction", extraction("site_pages"))
def contact_extraction(spark, sf_dir):
    return ct.extract_contacts(inputs.derive(spark, sf_dir, inputs.SITE_PAGES), "page_id")


_ORDER = f"list_position([{oracle.quoted(ct.CANDIDATE_PATHS)}], regexp_replace(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '/+$', ''))"
CANDIDATES = f"""
select page_id, url, html, {_ORDER} as path_order, regexp_extract(url, '://([^/?#]*)', 1) as host
from firm_pages where {_ORDER} > 0"""


@book.add("c02_candidate_pages", f"select page_id, host, path_order from ({CANDIDATES})")
def candidate_pages(spark, sf_dir):
    pages = inputs.derive(spark, sf_dir, inputs.firm_pages_text())
    return ct.candidate_pages(pages).select("page_id", "host", "path_order")


FOUND = extraction(f"({CANDIDATES})").replace("select page_id, url", "select page_id, host, path_order, url", 1)


@book.add("w05_first_contacts", f"""
select host, role_category, email, title_raw, phone, source_url from (
  select *, row_number() over (partition by host, role_category, email order by path_order, source_url, page_id, phrase_order) as k
  from ({FOUND})) where k = 1""")
def first_contacts(spark, sf_dir):
    pages = ct.candidate_pages(inputs.derive(spark, sf_dir, inputs.firm_pages_text()))
    found = ct.extract_contacts(pages, "host", "path_order", "page_id")
    return ct.first_contacts(found, "host", ["path_order", "source_url", "page_id"]).drop("confidence")


@book.add("c03_site_contacts", f"""
select business_id, role_category, email, title_raw from (
  select t.business_id, f.*, row_number() over (partition by t.business_id, role_category, email
    order by path_order, source_url, phrase_order, title_raw) as k
  from (select business_id, 'www.' || domain as host from businesses where website is not null) t
  join ({FOUND}) f using (host)) where k = 1""")
def site_contacts(spark, sf_dir):
    """Every business with a site, whether or not it has contacts already."""
    targets = inputs.businesses(spark, sf_dir).where(F.col("website").isNotNull()).select("business_id", "website")
    found = ct.site_contacts(targets, inputs.derive(spark, sf_dir, inputs.firm_pages_text()))
    return found.select("business_id", "role_category", "email", "title_raw")
