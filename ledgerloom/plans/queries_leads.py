"""Filters, joins, counts and lists over businesses (F…, T…, A…, J4 to J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import contacts as ct
from ledgerloom.operators import detail, events as ev, export, jobs, leads, scoring, suppression
from ledgerloom.operators.leads import LeadFilter
from ledgerloom.plans import inputs
from ledgerloom.plans.book import Book
from ledgerloom.session import materialize
from ledgerloom.sources import topics

book = Book()
FREE = "not do_not_call"
NEW = "business_id in (select business_id from biz_events where event_type in ('new_today', 'new_7d', 'new_30d'))"
ACTIVE_CONTACT = "business_id in (select business_id from biz_contacts where is_active)"


def filtered(key: str, wanted: LeadFilter, condition: str) -> None:
    @book.add(key, f"select business_id, legal_name, quality_score from businesses where {FREE} and {condition}")
    def query(spark, sf_dir):
        found = leads.filter_leads(
            inputs.businesses(spark, sf_dir), wanted, inputs.events(spark, sf_dir), inputs.contacts(spark, sf_dir))
        return found.select("business_id", "legal_name", "quality_score")


filtered("f01_search", LeadFilter(search="SHOP 1"), "(legal_name ilike '%shop 1%' or operating_name ilike '%shop 1%')")
filtered("f02_province", LeadFilter(province="NA"), "province = 'NA'")
filtered("f03_city", LeadFilter(city="city 1"), "city ilike '%city 1%'")
filtered("f04_industry", LeadFilter(industry="build"), "industry ilike '%build%'")
filtered("f05_size_category", LeadFilter(size_category="20-49"), "size_category = '20-49'")
filtered("f06_min_score", LeadFilter(min_quality_score=65), "quality_score >= 65")
filtered("f07_phone_available", LeadFilter(phone_available=True), "phone is not null")
filtered("f08_email_available", LeadFilter(email_available=True), "email is not null")
filtered("f09_not_do_not_call", LeadFilter(), "true")
filtered(
    "f10_composed_filter",
    LeadFilter(search="customer", city="City", min_quality_score=40, phone_available=True, new_only=True,
               decision_maker_available=True),
    f"(legal_name ilike '%customer%' or operating_name ilike '%customer%') and city ilike '%city%' "
    f"and quality_score >= 40 and phone is not null and {NEW} and {ACTIVE_CONTACT}")
filtered("j05_new_only", LeadFilter(new_only=True), NEW)
filtered("j06_decision_maker_available", LeadFilter(decision_maker_available=True), ACTIVE_CONTACT)


@book.add("f11_sales_ready",
          f"select business_id, quality_score from businesses where lead_ready and {FREE} and business_status = 'active'")
def sales_ready(spark, sf_dir):
    return leads.sales_ready(inputs.businesses(spark, sf_dir)).select("business_id", "quality_score")


JOB_COLUMNS = "id, source_name, status, started_at, records_collected, records_new, errors_count"


def job_rows(df):
    return df.select(*JOB_COLUMNS.split(", "))


@book.add("f12_filter_jobs", f"select {JOB_COLUMNS} from job_runs where status = 'failed' "
          "and started_at >= timestamp '2024-01-20 00:00:00'")
def filtered_jobs(spark, sf_dir):
    runs = inputs.derive(spark, sf_dir, inputs.JOB_RUNS)
    return job_rows(jobs.filter_jobs(runs, "failed", inputs.as_of("2024-01-20 00:00:00")))


@book.add("f13_stale", f"select business_id from businesses where business_status = 'active' "
          f"and last_verified_at < timestamp '{inputs.AS_OF}' - interval 30 days")
def stale(spark, sf_dir):
    return inputs.businesses(spark, sf_dir).where(scoring.stale(inputs.as_of())).select("business_id")


@book.add("f14_recent_events", f"select event_id, event_type from biz_events "
          f"where detected_at >= timestamp '2024-01-25 00:00:00' - interval 10 days")
def recent_events(spark, sf_dir):
    events = inputs.events(spark, sf_dir)
    return events.where(F.col("detected_at") >= inputs.as_of("2024-01-25 00:00:00") - F.expr("interval 10 days")).select(
        "event_id", "event_type")


@book.add("t01_sorted_list", f"""
select business_id, legal_name, operating_name, province, city, phone, email, industry, size_category, quality_score,
  lead_ready, business_status, first_seen_at, incorporation_date
from businesses where {FREE} order by email asc nulls last, business_id limit 200""")
def sorted_list(spark, sf_dir):
    return leads.sorted_list(leads.filter_leads(inputs.businesses(spark, sf_dir)), "email", "asc")


@book.add("t01b_default_sort", f"""
select business_id, quality_score from businesses where {FREE}
order by quality_score desc nulls last, business_id limit 200""")
def default_sort(spark, sf_dir):
    found = leads.filter_leads(inputs.businesses(spark, sf_dir))
    return leads.sorted_list(found, "no_such_column", "sideways").select("business_id", "quality_score")


@book.add("t02_latest_jobs", f"select {JOB_COLUMNS} from job_runs order by started_at desc, id desc limit 10")
def latest_jobs(spark, sf_dir):
    return job_rows(jobs.latest_jobs(inputs.derive(spark, sf_dir, inputs.JOB_RUNS)))


@book.add("t03_job_page", f"select {JOB_COLUMNS} from job_runs where status = 'partial_failure' "
          "and started_at >= timestamp '2024-01-10 00:00:00' order by started_at desc, id desc limit 50")
def job_page(spark, sf_dir):
    runs = inputs.derive(spark, sf_dir, inputs.JOB_RUNS)
    found = jobs.filter_jobs(runs, "partial_failure", inputs.as_of("2024-01-10 00:00:00"))
    return job_rows(jobs.latest_jobs(found, jobs.JOB_PAGE))


@book.add("t04_daily_digest", f"""
select b.business_id, legal_name, operating_name, city, province, industry, quality_score, phone
from businesses b join biz_events e using (business_id) where e.event_type = 'new_today' and {FREE}
order by quality_score desc, business_id limit 15""")
def daily_digest(spark, sf_dir):
    return leads.daily_digest(inputs.businesses(spark, sf_dir), inputs.events(spark, sf_dir))


NO_CONTACT = "business_id not in (select business_id from biz_contacts)"


@book.add("t05_website_targets", f"""
select business_id, website, last_updated_at from businesses where website is not null and {NO_CONTACT}
order by last_updated_at desc nulls first, business_id limit 200""")
def website_targets(spark, sf_dir):
    return ct.website_targets(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir), 200)


NO_OFFICER = "business_id not in (select business_id from biz_contacts where source_name = 'corporations_canada_api')"


@book.add("t06_officer_targets", f"""
select business_id, corporation_number, quality_score from businesses where corporation_number is not null
  and {NO_OFFICER} order by quality_score desc nulls first, business_id limit 50""")
def officer_targets(spark, sf_dir):
    return ct.officer_targets(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir), 50)


@book.add("t07_source_history", """
select business_id, field_name, field_value, source_name, confidence, seq, is_current_pick from history
order by business_id, field_name, confidence desc, seq desc""")
def source_history(spark, sf_dir):
    from ledgerloom.operators.merge import flag_current
    log = flag_current(inputs.field_sources(spark, sf_dir))
    return log.select("business_id", "field_name", "field_value", "source_name", "confidence", "seq",
                      "is_current_pick").orderBy("business_id", "field_name", F.desc("confidence"), F.desc("seq"))


EXPORT = f"""
select {', '.join('b.' + c for c in export.EXPORT_COLUMNS[:19])}, coalesce(decision_makers, '') as decision_makers,
  coalesce(contact_emails, '') as contact_emails, coalesce(contact_phones, '') as contact_phones
from businesses b left join (
  select business_id,
    coalesce(string_agg(coalesce(full_name, title_raw) || ' (' || role_category || ')', '; '
      order by confidence desc, contact_id), '') as decision_makers,
    coalesce(string_agg(email, '; ' order by confidence desc, contact_id), '') as contact_emails,
    coalesce(string_agg(phone, '; ' order by confidence desc, contact_id), '') as contact_phones
  from biz_contacts where is_active group by 1) c using (business_id)
where {FREE}"""


@book.add("t08_export_order", EXPORT + " order by quality_score desc, business_id")
def export_order(spark, sf_dir):
    rows = export.export_rows(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir))
    return rows.orderBy(F.desc("quality_score"), "business_id").select(export.EXPORT_COLUMNS)


@book.add("a01_event_counts", f"select event_type, count(*) as n from biz_events "
          f"where detected_at >= timestamp '2024-02-15 00:00:00' - interval 30 days group by 1")
def event_counts(spark, sf_dir):
    return ev.recent_event_counts(inputs.events(spark, sf_dir), inputs.as_of("2024-02-15 00:00:00"))


for _key, _column in {"a02_by_province": "province", "a03_by_size": "size_category"}.items():
    def _count(spark, sf_dir, column=_column):
        return leads.count_by(inputs.businesses(spark, sf_dir), column)
    book.add(_key, f"select {_column}, count(*) as cnt from businesses where {FREE} and trim({_column}) <> '' "
             f"group by 1 order by cnt desc, 1")(_count)


@book.add("a04_totals", f"select count(*) as total_businesses, count(*) filter (where lead_ready) as lead_ready "
          f"from businesses where {FREE}")
def totals(spark, sf_dir):
    return leads.totals(inputs.businesses(spark, sf_dir))


@book.add("a05_source_counts", "select business_id, count(distinct source_name) as source_count from accepted group by 1")
def source_counts(spark, sf_dir):
    return scoring.source_counts(inputs.field_sources(spark, sf_dir))


@book.add("a06_contact_counts",
          "select business_id, count(*) filter (where is_active) as contact_count from biz_contacts group by 1")
def contact_counts(spark, sf_dir):
    return ct.active_contact_counts(inputs.contacts(spark, sf_dir))


@book.add("a07_businesses_per_source",
          "select source_name, count(distinct business_id) as cnt from accepted group by 1 order by 2 desc, 1")
def per_source(spark, sf_dir):
    return jobs.businesses_per_source(inputs.field_sources(spark, sf_dir))


@book.add("a08_filtered_total", f"select count(*) as total from businesses where {FREE} and province = 'NA' "
          "and phone is not null")
def filtered_total(spark, sf_dir):
    return leads.total(leads.filter_leads(
        inputs.businesses(spark, sf_dir), LeadFilter(province="NA", phone_available=True)))


FLAT = """
select business_id,
  coalesce(string_agg(coalesce(full_name, title_raw) || ' (' || role_category || ')', '; '
    order by confidence desc, contact_id), '') as decision_makers,
  coalesce(string_agg(email, '; ' order by confidence desc, contact_id), '') as contact_emails,
  coalesce(string_agg(phone, '; ' order by confidence desc, contact_id), '') as contact_phones
from biz_contacts where is_active group by 1"""


@book.add("a09_flatten_contacts", FLAT)
def flatten(spark, sf_dir):
    return ct.flatten_contacts(inputs.contacts(spark, sf_dir))


@book.add("j09_export_contacts", f"""
select b.business_id, b.legal_name, coalesce(decision_makers, '') as decision_makers,
  coalesce(contact_emails, '') as contact_emails from businesses b left join ({FLAT}) c using (business_id) where {FREE}""")
def export_contacts(spark, sf_dir):
    rows = export.export_rows(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir))
    return rows.select("business_id", "legal_name", "decision_makers", "contact_emails")


@book.add("a12_digest_message", f"""
select 1 as section, '• ' || coalesce(legal_name, operating_name) || ' — ' || coalesce(city, 'null') || ', '
  || coalesce(province, 'null') || ' — ' || coalesce(industry, 'industry unknown') || ' — score '
  || cast(cast(quality_score as int) as varchar) || coalesce(' — ' || phone, '') as line
from businesses join biz_events e using (business_id)
where e.event_type = 'new_today' and {FREE} and quality_score >= 50
union all
select 0, ':new: *' || cast(count(*) as varchar) || ' new sales-ready lead(s) today*'
from businesses join biz_events e using (business_id)
where e.event_type = 'new_today' and {FREE} and quality_score >= 50 having count(*) > 0""")
def digest_message(spark, sf_dir):
    return leads.digest_message(inputs.businesses(spark, sf_dir), inputs.events(spark, sf_dir)).select("section", "line")


ALERT_FROM = "timestamp '2024-01-20 12:00:00' - interval 15 minutes"


@book.add("a13_failure_alert", f"""
select 1 as section, '• ' || source_name || ' (' || job_type || ') — ' || cast(errors_count as varchar) || ' error(s) at '
  || strftime(started_at, '%Y-%m-%dT%H:%M:%S') || ': ' || coalesce(error_detail, 'see logs') as line
from job_runs where status = 'failed' and started_at >= {ALERT_FROM}
union all select 0, ':rotating_light: *Lead-gen pipeline failure(s)*' from job_runs
where status = 'failed' and started_at >= {ALERT_FROM} having count(*) > 0""")
def failure_alert(spark, sf_dir):
    runs = inputs.derive(spark, sf_dir, inputs.JOB_RUNS)
    return jobs.failure_alert(runs, inputs.as_of("2024-01-20 12:00:00")).select("section", "line")


@book.add("a14_source_growth", """
select source_name, coalesce(b.cnt, 0) as cnt_before, coalesce(a.cnt, 0) as cnt_after,
  coalesce(a.cnt, 0) - coalesce(b.cnt, 0) as added
from (select source_name, count(distinct business_id) as cnt from accepted where seq < 1000000000 group by 1) b
full outer join (select source_name, count(distinct business_id) as cnt from accepted group by 1) a using (source_name)""")
def growth(spark, sf_dir):
    log = inputs.field_sources(spark, sf_dir)
    before = jobs.businesses_per_source(log.where(F.col("seq") < 1000000000))
    return jobs.source_growth(before, jobs.businesses_per_source(log))


OFFICERS = """
select user_id as business_id, 'BC-' || cast(user_id as varchar(20)) as corporation_number,
  case when event_id % 3 = 0 then '{{"corporation": {{"directors": ' else '{{"directors": ' end
  || '[{{"firstName": "P' || cast(event_id % 97 as varchar(20)) || '", "lastName": "Q' || cast(user_id as varchar(20))
  || '", "title": "' || event_type || ' Vice-President"}}, {{"first_name": " R ", "middle_name": "S", "last_name": "",
  "officer_type": "Managing Director"}}, {{"firstName": "", "title": "Owner"}}]'
  || case when event_id % 3 = 0 then '}}}}' else '}}' end as payload
from {events}
"""
OFFICER_ROWS = """
select user_id as business_id, 'P' || cast(event_id % 97 as varchar) || ' Q' || cast(user_id as varchar) as full_name,
  event_type || ' Vice-President' as title_raw, 'president' as role_category,
  'corporation/' || cast(user_id as varchar) as source_url, cast(0.8 as decimal(4,2)) as confidence from events
union all
select user_id, 'R S', 'Managing Director', 'other_decision_maker', 'corporation/' || cast(user_id as varchar), 0.8 from events
"""


@book.add("s10_officer_contacts", OFFICER_ROWS)
def officer_contacts(spark, sf_dir):
    return topics.officer_contacts(inputs.derive(spark, sf_dir, OFFICERS)).drop("email", "phone")


@book.add("a15_enrichment_yield", f"""
select count(*) filter (where business_id in (select business_id from ({OFFICER_ROWS}))) as enriched, count(*) as targeted
from businesses where corporation_number is not null and {NO_OFFICER}""")
def enrichment_yield(spark, sf_dir):
    targets = ct.officer_targets(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir), None)
    found = topics.officer_contacts(inputs.derive(spark, sf_dir, OFFICERS))
    return ct.enrichment_yield(targets, found)


STALE = f"business_status = 'active' and last_verified_at < timestamp '{inputs.AS_OF}' - interval 30 days"


@book.add("a16_refreshed_count", f"select count(*) as refreshed from businesses where {STALE}")
def refreshed_count(spark, sf_dir):
    return inputs.businesses(spark, sf_dir).where(scoring.stale(inputs.as_of())).agg(
        F.count(F.lit(1)).alias("refreshed"))


@book.add("j04_new_leads", f"""
select b.business_id, legal_name, operating_name, city, province, industry, quality_score, phone, email, website,
  size_category, incorporation_date
from businesses b join biz_events e using (business_id)
where e.event_type = 'new_7d' and quality_score >= 45 and {FREE} order by quality_score desc, business_id""")
def new_leads(spark, sf_dir):
    return leads.new_leads(inputs.businesses(spark, sf_dir), inputs.events(spark, sf_dir), "7d", 45)


@book.add("j04b_new_today_view", f"""
select b.business_id, legal_name, quality_score from businesses b join biz_events e using (business_id)
where e.event_type = 'new_today' and {FREE} and e.detected_at >= timestamp '2024-01-29 00:00:00'""")
def new_today(spark, sf_dir):
    found = leads.new_today_view(
        inputs.businesses(spark, sf_dir), inputs.events(spark, sf_dir), inputs.as_of("2024-01-29 15:30:00"))
    return found.select("business_id", "legal_name", "quality_score")


@book.add("j07_without_contact", f"select business_id, website from businesses where website is not null and {NO_CONTACT}")
def without_contact(spark, sf_dir):
    return ct.website_targets(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir), None).select(
        "business_id", "website")


@book.add("j08_without_officer", f"select business_id, corporation_number from businesses "
          f"where corporation_number is not null and {NO_OFFICER}")
def without_officer(spark, sf_dir):
    return ct.officer_targets(inputs.businesses(spark, sf_dir), inputs.contacts(spark, sf_dir), None).select(
        "business_id", "corporation_number")


@book.add("j10_business_detail", """
select 'business' as part, business_id, legal_name as label, cast(quality_score as varchar) as detail from businesses
union all
select 'contact', c.business_id, c.contact_id, c.role_category from biz_contacts c
  join businesses b using (business_id) where c.is_active
union all
select 'field', business_id, field_name, field_value from history
union all
select 'event', business_id, cast(event_id as varchar), event_type from (
  select e.*, row_number() over (partition by e.business_id order by detected_at desc, event_id desc) as k
  from biz_events e join businesses b using (business_id)) where k <= 20""")
def business_detail(spark, sf_dir):
    records = materialize(inputs.entity_records(spark, sf_dir), "records")
    found = materialize(inputs.businesses(spark, sf_dir, records), "businesses")
    parts = detail.business_detail(
        found.select("business_id"), found, inputs.contacts(spark, sf_dir), inputs.field_sources(spark, sf_dir, records),
        inputs.events(spark, sf_dir))
    shown = {
        "business": ("legal_name", F.col("quality_score").cast("string")), "contacts": ("contact_id", F.col("role_category")),
        "field_sources": ("field_name", F.col("field_value")),
        "events": (F.col("event_id").cast("string"), F.col("event_type")),
    }
    labels = {"business": "business", "contacts": "contact", "field_sources": "field", "events": "event"}
    rows = None
    for name, (label, text) in shown.items():
        column = F.col(label) if isinstance(label, str) else label
        part = parts[name].select(
            F.lit(labels[name]).alias("part"), "business_id", column.alias("label"), text.alias("detail"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@book.add("w06_latest_events", """
select business_id, event_id, event_type, k as place from (
  select *, row_number() over (partition by business_id order by detected_at desc, event_id desc) as k from biz_events)
where k <= 20""")
def latest_events(spark, sf_dir):
    return ev.latest_events(inputs.events(spark, sf_dir)).select("business_id", "event_id", "event_type", "place")


@book.add("d07_rescore", "select business_id, quality_score, lead_ready from scored")
def rescored(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select("business_id", "quality_score", "lead_ready")


@book.add("d08_do_not_call", "select business_id, do_not_call, do_not_call_reason, do_not_call_at from businesses")
def do_not_call(spark, sf_dir):
    return inputs.businesses(spark, sf_dir).select(
        "business_id", "do_not_call", "do_not_call_reason", "do_not_call_at")


@book.add("d09_touch_stale", f"""
select business_id, case when {STALE} then timestamp '{inputs.AS_OF}' else last_verified_at end as last_verified_at,
  case when {STALE} and business_id % 120 > 90 then quality_score + 10 else quality_score end as quality_score
from scored""")
def touched(spark, sf_dir):
    businesses, kept = inputs.scored_with_sources(spark, sf_dir)
    refreshed, _ = scoring.touch_stale(businesses, inputs.contacts(spark, sf_dir), kept, inputs.as_of())
    return refreshed.select("business_id", "last_verified_at", "quality_score")


@book.add("d10_add_contacts", f"""
select business_id, case when contact_count = 0 and business_id in (select business_id from ({OFFICER_ROWS}))
  then quality_score + 20 else quality_score end as quality_score from scored""")
def add_contacts(spark, sf_dir):
    (businesses, kept), known = inputs.scored_with_sources(spark, sf_dir), inputs.contacts(spark, sf_dir)
    found = topics.officer_contacts(inputs.derive(spark, sf_dir, OFFICERS)).distinct()
    rows = ct.as_contact_rows(found, ct.OFFICER_SOURCE, inputs.as_of())
    after, _ = scoring.add_contacts(businesses, known, rows, kept, inputs.as_of())
    return after.select("business_id", "quality_score")
