"""Check queries in DuckDB SQL: the same results by other means.

Only the input texts are shared with the Spark side.
"""

from __future__ import annotations

from ledgerloom.functions import labels, measures, reach, text
from ledgerloom.plans import inputs
from ledgerloom.schemas import BUSINESS_STATUSES, MERGE_FIELDS

SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def plain(sql: str) -> str:
    """An input text with its table names filled in."""
    return sql.format(**{name: name for name in inputs.tables_in(sql)})


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def clean(x: str) -> str:
    return (f"case when {strip(x)} <> '' and lower({strip(x)}) not in ({quoted(text.NA_TOKENS)}) "
            f"then {strip(x)} end")


def name(x: str) -> str:
    return f"regexp_replace({clean(x)}, '\\s+', ' ', 'g')"


def case_of(x: str, values: dict[str, str], default: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in values.items())
    return f"case {x} {arms} else {default} end"


def province(x: str) -> str:
    v = f"upper({strip(x)})"
    return f"case when {x} <> '' then {case_of(v, text.PROVINCE_CODES, f'left({v}, 2)')} end"


def postal(x: str) -> str:
    packed = f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
    return (f"case when length({packed}) = 6 then left({packed}, 3) || ' ' || right({packed}, 3) "
            f"else nullif(upper({strip(x)}), '') end")


def national(x: str) -> str:
    digits = f"regexp_replace(regexp_replace({x}, '(?i)\\s*(ext\\.?|x)\\s*[0-9]+$', ''), '[^0-9]', '', 'g')"
    return f"regexp_replace({digits}, '^1([0-9]{{10}})$', '\\1')"


def phone_of(n: str, x: str) -> str:
    return (f"case when regexp_full_match({n}, '[2-9][0-8][0-9][2-9][0-9]{{6}}') "
            f"and substr({n}, 2, 2) <> '11' and left({n}, 2) not in ('37', '96') "
            f"and not ({x} like '+%' and {x} not like '+1%') then '+1' || {n} end")


def phone(x: str) -> str:
    return phone_of(national(x), x)


def host(x: str) -> str:
    return (f"nullif(split_part(split_part(split_part(regexp_replace({strip(f'lower({x})')}, "
            f"'^[a-z]+://', ''), '/', 1), '?', 1), ':', 1), '')")


def domain_of(h: str) -> str:
    parts = f"string_split({h}, '.')"
    suffix = "(on\\.ca|(ac|co|com|edu|go|gob|gov|govt|mil|ne|net|nom|or|org)\\.[a-z][a-z])"
    wild = "(" + "|".join(w.replace(".", "\\.") for w in reach.WILDCARD_SUFFIXES) + ")"
    excepted = "(" + "|".join(w.replace(".", "\\.") for w in reach.EXCEPTED_NAMES) + ")"
    return (f"case when regexp_matches({h}, '(^|\\.){excepted}$') then regexp_extract({h}, '(^|\\.){excepted}$', 2) "
            f"when regexp_matches({h}, '\\.{wild}$') then nullif(regexp_extract({h}, '(^|\\.)([^.]+\\.[^.]+\\.{wild})$', 2), '') "
            f"when {h} is null or regexp_full_match({h}, '{suffix}') then null "
            f"when regexp_full_match({h}, '.*\\.{suffix}') then array_to_string({parts}[-3:], '.') "
            f"when len({parts}) = 1 then case when {h} not in ('ca', 'com') then {h} end "
            f"else array_to_string({parts}[-2:], '.') end")


def domain(x: str) -> str:
    return domain_of(host(clean(x)))


def size_class(x: str) -> str:
    bounds = [low for low, _ in measures.SIZE_CLASSES] + [None]
    arms = []
    for (low, label), high in zip(measures.SIZE_CLASSES, bounds[1:]):
        upper = f" and {x} < {high}" if high else ""
        arms.append(f"when {x} >= {low}{upper} then '{label}'")
    return "case " + " ".join(arms) + " end"


def officer_role(x: str) -> str:
    arms = " ".join(f"when contains(lower({strip(x)}), '{k}') then '{v}'" for k, v in labels.OFFICER_ROLES.items())
    return f"case {arms} else 'other_decision_maker' end"


NORM = f"""
select seq, {name('legal_name')} as legal_name, {name('operating_name')} as operating_name,
  {province('province')} as province, {name('city')} as city, {name('address_line1')} as address_line1,
  {postal('postal_code')} as postal_code, website, {domain_of('site_host')} as domain,
  {phone_of('dialled', 'phone')} as phone, {clean('lower(email)')} as email, {name('industry')} as industry,
  {clean('naics_code')} as naics_code, {clean('corporation_number')} as corporation_number,
  {clean('business_number')} as business_number, try_cast(incorporation_date as date) as incorporation_date,
  lower(coalesce(nullif(business_status, ''), 'unknown')) as business_status,
  employee_count_min, employee_count_max, source_name, source_kind, source_url, confidence
from (select * replace (site as website), {host('site')} as site_host, {national('phone')} as dialled
  from (select *, {clean('lower(website)')} as site from raw_business))
"""

KEYED = """
select *, case when postal_code <> '' and name_key <> '' then postal_code || '|' || name_key end as postal_name_key
from (select *, lower(trim(coalesce(nullif(legal_name, ''), nullif(operating_name, ''), ''))) as name_key from norm)
"""

ENTITIES = """
select *, cast(coalesce(corporation_number, nullif(regexp_extract(domain, '^firm([0-9]+)[.]ca$', 1), '')) as bigint)
  as business_id from good
"""

# One row per non-empty (record, field), in field order.
VALUES = f"""
select * from (
  select business_id, seq, confidence, source_name, source_kind, source_url,
    unnest(range({len(MERGE_FIELDS)})) as place, unnest([{quoted(MERGE_FIELDS)}]) as field_name,
    unnest([{', '.join(f'cast({f} as varchar)' for f in MERGE_FIELDS)}]) as field_value
  from entities)
where field_value <> ''
"""

ACCEPTED = """
select * from (
  select *, max(confidence) over (partition by business_id, field_name order by seq
    rows between unbounded preceding and 1 preceding) as seen from vals)
where seen is null or confidence >= seen
"""

HISTORY = """
select *, lag(field_value) over (partition by business_id, field_name order by seq) as was,
  row_number() over (partition by business_id, field_name order by confidence desc, seq desc) = 1 as is_current_pick,
  seq = min(seq) over (partition by business_id) as is_first
from accepted
"""

CHANGES = """
select e.seq, e.business_id, e.source_name, e.incorporation_date,
  e.seq = min(e.seq) over (partition by e.business_id) as is_new, coalesce(c.changed, '') as changed
from entities e left join (
  select h.seq, string_agg(h.field_name, ',' order by h.place) as changed
  from history h join (select business_id, min(seq) as first_seq from entities group by 1) f using (business_id)
  where h.seq <> f.first_seq and coalesce(h.was, '') <> h.field_value group by 1) c using (seq)
"""

_PIVOT = ", ".join(
    f"max(case when field_name = '{f}' and is_current_pick then field_value end) as {f}" for f in MERGE_FIELDS)
GOLDEN = f"""
select g.*, s.size_category, case when s.size_category is not null then 'estimated' end as size_confidence from (
  select business_id, {_PIVOT} from history group by business_id) g
left join (
  select business_id, arg_max(size_category, seq) as size_category from (
    select business_id, seq, {size_class('((employee_count_min + coalesce(nullif(employee_count_max, 0), employee_count_min)) // 2)')} as size_category
    from entities where employee_count_min <> 0) where size_category is not null group by 1) s using (business_id)
"""

SCORED = f"""
select *, quality_score >= 50 as lead_ready from (
  select g.* replace (cast(g.incorporation_date as date) as incorporation_date),
    timestamp '{inputs.AS_OF}' - to_days(cast(business_id % 200 as int)) as first_seen_at,
    timestamp '{inputs.AS_OF}' - to_days(cast(business_id % 120 as int)) as last_verified_at,
    timestamp '{inputs.AS_OF}' - to_days(cast(business_id % 45 as int)) as last_updated_at,
    coalesce(n, 0) as contact_count, coalesce(sources, 0) as source_count,
    cast((phone is not null)::int * 20 + (website is not null)::int * 10
      + (address_line1 is not null and postal_code is not null)::int * 15
      + (size_category is not null)::int * 10 + (coalesce(n, 0) > 0)::int * 20
      + (business_id % 120 <= 90)::int * 10 + (coalesce(sources, 0) >= 2)::int * 15 as decimal(5,2)) as quality_score
  from golden g
  left join (select business_id, count(*) filter (where is_active) as n from biz_contacts group by 1) using (business_id)
  left join (select business_id, count(distinct source_name) as sources from accepted group by 1) using (business_id))
"""

BUSINESSES = """
select s.*, r.business_id is not null as do_not_call, r.reason as do_not_call_reason, r.at as do_not_call_at
from scored s left join (
  select business_id, coalesce(note, 'Requested by business') as reason, requested_at as at from (
    select *, row_number() over (partition by business_id order by requested_at desc, note desc nulls last) as k
    from dnc_requests) where k = 1) r using (business_id)
"""

CTES = {
    **{key: plain(value) for key, value in inputs.TEXTS.items()},
    "firm_pages": plain(inputs.FIRM_PAGES.replace("{site_pages}", "site_pages")).replace("(site_pages)", "site_pages"),
    "norm": NORM,
    "keyed": KEYED,
    "good": f"select * from keyed where business_status in ({quoted(BUSINESS_STATUSES)})",
    "entities": ENTITIES, "vals": VALUES, "accepted": ACCEPTED, "history": HISTORY, "changes": CHANGES,
    "golden": GOLDEN, "scored": SCORED, "businesses": BUSINESSES,
}


def _needs(sql: str) -> set[str]:
    import re
    words = set(re.findall(r"[a-z_]+", sql))
    return {name_ for name_ in CTES if name_ in words}


def check(sql: str) -> str:
    """The query with the derived tables it uses, directly or not."""
    wanted: set[str] = set()
    frontier = _needs(sql)
    while frontier:
        wanted |= frontier
        frontier = set().union(*(_needs(CTES[n]) - {n} for n in frontier)) - wanted
    ctes = [f"{n} as materialized ({CTES[n].strip()})" for n in CTES if n in wanted]
    return (f"with recursive {', '.join(ctes)} {sql.strip()}" if ctes else sql.strip())
