"""Matching, resolution, merging and events (J1 to J3, W…, A10, A11, U…, D…, K…)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import similarity as sim
from ledgerloom.functions.text import strip
from ledgerloom.operators import events as ev
from ledgerloom.operators import jobs, keys, match, merge, resolve, scoring, shared
from ledgerloom.operators.normalize import normalize_records, split_valid
from ledgerloom.plans import inputs
from ledgerloom.plans.book import Book
from ledgerloom.schemas import BUSINESS_STATUSES, MERGE_FIELDS
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sources.tables import TableStore
from ledgerloom.streaming.rolling import rolling_counts
from ledgerloom.streaming.upserts import landed_records, upsert_stream

book = Book()

# The registry is the snapshot, everything else the batch.
FIRST_BATCH_SEQ = 1000000000


def _snapshot(records):
    return records.where(F.col("seq") < FIRST_BATCH_SEQ).withColumn("business_id", F.col("seq"))


def _batch(records):
    return records.where(F.col("seq") >= FIRST_BATCH_SEQ)


KEY_ROWS = """
select seq, kind, place, value from (
  select seq, unnest(['corp_number', 'domain', 'phone', 'postal_name']) as kind, unnest([0, 1, 2, 3]) as place,
    unnest([corporation_number, domain, phone, postal_name_key]) as value from good)
where value <> ''
"""
NAME_ROWS = "select seq, 'name_hash' as kind, name_key as value from good where name_key <> ''"
# Snapshot of the first half of all licences and the registry.
SNAPSHOT = f"seq < {FIRST_BATCH_SEQ} or (seq < {2 * FIRST_BATCH_SEQ} and seq % 2 = 0)"


@book.add("j01_exact_match", f"""
select * from (
with keys as ({KEY_ROWS}),
owners as (select kind, value, min(seq) as business_id from keys where {SNAPSHOT} group by 1, 2)
select seq, business_id, kind as key_type from (
  select k.seq, o.business_id, k.kind, row_number() over (partition by k.seq order by k.place) as n
  from keys k join owners o using (kind, value) where not ({SNAPSHOT.replace('seq', 'k.seq')})) where n = 1)""")
def exact(spark, sf_dir):
    records = inputs.good_records(spark, sf_dir)
    held = F.expr(SNAPSHOT)
    identifiers = keys.register_identifiers(records.where(held).withColumn("business_id", F.col("seq")))
    return match.exact_match(records.where(~held), identifiers)


@book.add("j01b_unshared_keys", f"""
select * from (
with shared as (
  select kind, value from ({KEY_ROWS}) k join good g using (seq) where kind in ('domain', 'phone') and g.name_key <> ''
  group by 1, 2 having count(distinct g.name_key) > 1),
keys as (select k.* from ({KEY_ROWS}) k anti join shared s on s.kind = k.kind and s.value = k.value),
owners as (select kind, value, min(seq) as business_id from keys where {SNAPSHOT} group by 1, 2)
select seq, business_id, kind as key_type from (
  select k.seq, o.business_id, k.kind, row_number() over (partition by k.seq order by k.place) as n
  from keys k join owners o using (kind, value) where not ({SNAPSHOT.replace('seq', 'k.seq')})) where n = 1)""")
def exact_without_shared_keys(spark, sf_dir):
    """Exact matches when a domain or phone of two names is no key."""
    records = materialize(inputs.good_records(spark, sf_dir), "good")
    records = materialize(shared.without_shared_keys(records, shared.shared_keys(shared.key_names(records), 1)), "keyed")
    held = F.expr(SNAPSHOT)
    identifiers = keys.register_identifiers(records.where(held).withColumn("business_id", F.col("seq")))
    return match.exact_match(records.where(~held), identifiers)


@book.add("u02_register_keys", f"""
select business_id, kind as key_type, value as key_value, min(seq) as first_seq from (
  select seq, kind, value from ({KEY_ROWS}) union all {NAME_ROWS}) k join (select seq, business_id from entities) e using (seq)
group by 1, 2, 3""")
def registered(spark, sf_dir):
    records = inputs.entity_records(spark, sf_dir)
    first = records.where(F.col("seq") < FIRST_BATCH_SEQ)
    later = records.where(F.col("seq") >= FIRST_BATCH_SEQ)
    return keys.register_identifiers(later, keys.register_identifiers(first))


# Sequential resolution on exact keys: each record follows the first holder of
# its first key held before.
IN_ORDER = f"""
with recursive keys as ({KEY_ROWS}),
firsts as (select kind, value, min(seq) as holder from keys group by 1, 2),
parents as (
  select g.seq, p.holder from good g left join (
    select k.seq, f.holder, row_number() over (partition by k.seq order by k.place) as n
    from keys k join firsts f using (kind, value) where f.holder < k.seq) p on p.seq = g.seq and p.n = 1),
walk as (
  select seq, seq as business_id from parents where holder is null
  union all select p.seq, w.business_id from parents p join walk w on p.holder = w.seq)
select seq, business_id from walk"""


@book.add("j03b_resolve_in_order", f"select * from ({IN_ORDER})")
def in_order(spark, sf_dir):
    records = materialize(inputs.good_records(spark, sf_dir), "records")
    return resolve.resolve_in_order(records, fuzzy=False)


@book.add("j03_components", f"""
select * from (
with recursive keys as ({KEY_ROWS}),
stars as (select k.seq as a, f.holder as b from keys k
  join (select kind, value, min(seq) as holder from keys group by 1, 2) f using (kind, value) where k.seq <> f.holder),
edges as (select a, b from stars union select b, a from stars),
reach as (select seq as node, seq as label from good
  union select e.b, r.label from reach r join edges e on e.a = r.node where r.label < e.b)
select node as seq, min(label) as business_id from reach group by 1)""")
def components(spark, sf_dir):
    records = materialize(inputs.good_records(spark, sf_dir), "records")
    return resolve.resolve_components(records)


_WORDS = (r"array_to_string(list_sort(string_split_regex(trim(lower(name), ' ' || chr(9) || chr(10) || chr(13)), "
          r"'\s+')), ' ')")
# Longest common subsequence as a fold over the characters of a; every list
# element is a list so that both folds keep one type.
_LCS = """list_reduce(
  list_transform(string_split(a, ''), lambda ch: [ord(ch)]),
  lambda line, c: list_reduce(
    list_transform(range(1, length(b) + 1), lambda j: [j::int]),
    lambda acc, j: list_append(acc, case when ord(substr(b, j[1], 1)) = c[1] then line[j[1]] + 1
      else greatest(acc[j[1]], line[j[1] + 1]) end), [0]),
  list_transform(range(0, length(b) + 1), lambda j: 0))[-1]"""
# Whether the longest common subsequence of a and b makes them alike; the distance is the cheap bound.
_ALIKE = f"""a = b or (abs(length(a) - length(b)) * 100 <= 13 * (length(a) + length(b))
  and levenshtein(a, b) * 100 <= 13 * (length(a) + length(b)) and 200 * {{lcs}} >= 87 * (length(a) + length(b)))"""


def _words(x: str) -> str:
    return _WORDS.replace("lower(name)", f"lower({x})")


@book.add("j03c_components_alike", f"""
select * from (
with recursive keys as ({KEY_ROWS}),
placed as (select * from good where province is not null and city is not null),
q as (select seq, province, city, {_words('name_key')} as a from placed where name_key <> ''),
c as (select seq, province, city, {_words('v')} as b from (select *, unnest([legal_name, operating_name]) as v from placed) where v <> ''),
dq as (select province, city, a, min(seq) as asker from q group by all),
dc as (select province, city, b, min(seq) as holder from c group by all),
pairs as materialized (select * from dq join dc using (province, city) where {_ALIKE.format(lcs=_LCS)}),
links as (
  select k.seq as a, f.holder as b from keys k
  join (select kind, value, min(seq) as holder from keys group by 1, 2) f using (kind, value)
  union all select seq, asker from q join dq using (province, city, a)
  union all select seq, holder from c join (select distinct province, city, b, holder from pairs) using (province, city, b)
  union all select asker, holder from pairs),
edges as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select seq as node, seq as label from good
  union select e.b, r.label from reach r join edges e on e.a = r.node where r.label < e.b)
select node as seq, min(label) as business_id from reach group by 1)""")
def alike_components(spark, sf_dir):
    records = materialize(inputs.good_records(spark, sf_dir), "records")
    return resolve.resolve_components(records, fuzzy=True)


def _name_pool(spark, sf_dir):
    pool = inputs.derive(spark, sf_dir, inputs.NAME_POOL)
    return pool.select("seq", "province", "city", F.lower(strip(F.col("name"))).alias("name_key"))


_SORTED_POOL = f"select seq, province, city, {_WORDS} as sorted from name_pool"


@book.add("j02_similar_names", f"""
select seq, owner, score from (
  select *, row_number() over (partition by seq order by score desc, owner) as k from (
    select seq, owner, round(200.0 * case when a = b then length(a) else {_LCS} end / (length(a) + length(b)), 6) as score
    from (
      select q.seq, c.seq as owner, q.sorted as a, c.sorted as b
      from ({_SORTED_POOL}) q join ({_SORTED_POOL}) c on q.province = c.province and q.city = c.city and c.seq < q.seq
      where abs(length(q.sorted) - length(c.sorted)) * 100 <= 13 * (length(q.sorted) + length(c.sorted)))
    where a = b or levenshtein(a, b) * 100 <= 13 * (length(a) + length(b)))
  where score >= 87)
where k = 1""")
def similar(spark, sf_dir):
    pool = materialize(_name_pool(spark, sf_dir), "names")
    candidates = pool.select(
        F.col("seq").alias("rank"), F.col("seq").alias("owner"), "province", "city",
        sim.token_sort(F.col("name_key")).alias("sorted"))
    found = match.similar_names(pool, candidates)
    return found.select("seq", "owner", F.round("score", 6).alias("score"))


@book.add("j02a_token_sort_ratio", f"""
select seq, round(200.0 * {_LCS} / (length(a) + length(b)), 6) as ratio from (
  select q.seq, q.sorted as a, c.sorted as b from ({_SORTED_POOL}) q join ({_SORTED_POOL}) c on c.seq = q.seq + 1)""")
def ratios(spark, sf_dir):
    """Each name against the next one."""
    pool = _name_pool(spark, sf_dir)
    other = pool.select((F.col("seq") - 1).alias("seq"), F.col("name_key").alias("other"))
    return pool.join(other, "seq").select(
        "seq", F.round(sim.token_sort_ratio(F.col("name_key"), F.col("other")), 6).alias("ratio"))


@book.add("t09_capped_candidates", """
select province, city, owner from (
  select province, city, seq as owner, row_number() over (partition by province, city order by seq) as k from name_pool) where k <= 50""")
def capped(spark, sf_dir):
    pool = _name_pool(spark, sf_dir)
    names = pool.select(F.col("seq").alias("owner"), "province", "city", F.col("name_key").alias("sorted"))
    return match.capped_candidates(names, 50).select("province", "city", "owner")


@book.add("w07_first_key", f"select seq, count(*) as known_keys, min(place) as best_place from ({KEY_ROWS}) group by 1")
def key_ranks(spark, sf_dir):
    rows = keys.record_keys(inputs.good_records(spark, sf_dir))
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("known_keys"), F.min("priority").alias("best_place"))


@book.add("w07_first_hit", f"""
select * from (
with keys as ({KEY_ROWS}),
owners as (select kind, value, min(seq) as business_id from keys where {SNAPSHOT} group by 1, 2),
hits as (select k.seq, o.business_id, k.kind, k.place from keys k join owners o using (kind, value) where not ({SNAPSHOT.replace('seq', 'k.seq')}))
select seq, kind as key_type, business_id, row_number() over (partition by seq order by place)::int as rank,
  count(distinct business_id) over (partition by seq) as owners from hits)""")
def ranked_hits(spark, sf_dir):
    """Every known key of a record with its owner, the strongest first, and how many owners its keys name."""
    records = inputs.good_records(spark, sf_dir)
    held = F.expr(SNAPSHOT)
    identifiers = keys.register_identifiers(records.where(held).withColumn("business_id", F.col("seq")))
    return match.ranked_hits(records.where(~held), identifiers)


@book.add("w01_accepted", """
select business_id, seq, field_name, field_value, confidence, coalesce(confidence >= seen, true) as accepted from (
  select *, max(confidence) over (partition by business_id, field_name order by seq
    rows between unbounded preceding and 1 preceding) as seen from vals)""")
def judged_values(spark, sf_dir):
    """Every value that came, accepted or turned down."""
    history = inputs.history(spark, sf_dir)
    entries = F.array_compact(F.array(*[
        F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.struct(
            F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value"), F.col(f"ok_{f}").alias("accepted")))
        for f in MERGE_FIELDS]))
    return history.select("business_id", "seq", "confidence", F.inline(entries))


@book.add("d04_provenance", "select business_id, seq, field_name, field_value, confidence from accepted")
def accepted(spark, sf_dir):
    return inputs.field_sources(spark, sf_dir).select("business_id", "seq", "field_name", "field_value", "confidence")


@book.add("w02_current_pick", "select business_id, seq, field_name, is_current_pick from history")
def current(spark, sf_dir):
    return merge.flag_current(inputs.field_sources(spark, sf_dir)).select(
        "business_id", "seq", "field_name", "is_current_pick")


@book.add("w03_changed_fields", "select seq, business_id, changed from changes")
def changed(spark, sf_dir):
    results = merge.upsert_results(inputs.history(spark, sf_dir))
    return results.select("seq", "business_id", F.array_join("changed_fields", ",").alias("changed"))


@book.add("w04_is_new", "select seq, is_new from changes")
def is_new(spark, sf_dir):
    return merge.upsert_results(inputs.history(spark, sf_dir)).select("seq", "is_new")


@book.add("d03_upsert_result", "select seq, business_id, is_new, changed from changes")
def upsert_result(spark, sf_dir):
    results = merge.upsert_results(inputs.history(spark, sf_dir))
    return results.select("seq", "business_id", "is_new", F.array_join("changed_fields", ",").alias("changed"))


GOLDEN_COLUMNS = ", ".join(f for f in MERGE_FIELDS if f != "incorporation_date")


@book.add("a11_survivorship", f"select business_id, {GOLDEN_COLUMNS}, cast(incorporation_date as date) as incorporation_date from golden")
def survivors(spark, sf_dir):
    rows = merge.with_prior(inputs.entity_records(spark, sf_dir), None)
    return merge.golden_records(rows).select("business_id", *MERGE_FIELDS)


@book.add("d05_size_update", "select business_id, size_category, size_confidence from golden")
def sizes(spark, sf_dir):
    rows = merge.with_prior(inputs.entity_records(spark, sf_dir), None)
    return merge.golden_records(rows).select("business_id", "size_category", "size_confidence")


@book.add("d01_insert_businesses", f"""
select business_id, {GOLDEN_COLUMNS}, timestamp '{inputs.AS_OF}' as first_seen_at, timestamp '{inputs.AS_OF}' as last_verified_at
from golden""")
def inserted(spark, sf_dir):
    history = inputs.history(spark, sf_dir)
    merged = merge.merge_snapshot(None, history, inputs.as_of())
    return merged.select("business_id", *GOLDEN_COLUMNS.split(", "), "first_seen_at", "last_verified_at")


@book.add("d02_merge_snapshot", f"""
select business_id, {GOLDEN_COLUMNS},
  case when business_id in (select business_id from changes where seq >= {FIRST_BATCH_SEQ} and (changed <> '' or is_new))
    then timestamp '{inputs.AS_OF}' else timestamp '2020-01-01 00:00:00' end as last_updated_at,
  case when business_id in (select business_id from entities where seq >= {FIRST_BATCH_SEQ})
    then timestamp '{inputs.AS_OF}' else timestamp '2020-01-01 00:00:00' end as last_verified_at
from golden""")
def merged(spark, sf_dir):
    records = materialize(inputs.entity_records(spark, sf_dir), "records")
    old = merge.record_history(records.where(F.col("seq") < FIRST_BATCH_SEQ))
    snapshot = materialize(merge.merge_snapshot(None, old, inputs.as_of("2020-01-01 00:00:00")), "snapshot")
    batch = _batch(records)
    prior = snapshot.join(batch.select("business_id").distinct(), "business_id", "left_semi")
    after = merge.merge_snapshot(snapshot, merge.record_history(batch, prior), inputs.as_of())
    return after.select("business_id", *GOLDEN_COLUMNS.split(", "), "last_updated_at", "last_verified_at")


@book.add("d06_change_events", f"""
select business_id, kind as event_type, case when kind = 'recently_changed' then changed end as changed from (
  select business_id, changed, unnest([
    case when is_new then 'new_today' end,
    case when is_new and incorporation_date >= date '2001-08-02' - 7 then 'new_7d' end,
    case when is_new and incorporation_date >= date '2001-08-02' - 30 then 'new_30d' end,
    case when not is_new and changed <> '' then 'recently_changed' end]) as kind
  from changes)
where kind is not null""")
def change_events(spark, sf_dir):
    found = ev.change_events(inputs.history(spark, sf_dir), inputs.as_of(inputs.ORDERS_AS_OF))
    return found.select("business_id", "event_type", F.array_join("changed_fields", ",").alias("changed"))


_STATUSES = ", ".join(f"'{s}'" for s in BUSINESS_STATUSES)


@book.add("s12_rejects", f"select seq, source_name, 'business_status' as reason from keyed where business_status not in ({_STATUSES})")
def rejects(spark, sf_dir):
    return split_valid(normalize_records(inputs.raw_business(spark, sf_dir)))[1].select("seq", "source_name", "reason")


COUNTERS = f"""
select source_name, sum(done) as records_collected, sum(created) as records_new, sum(updated) as records_updated,
  sum(failed) as errors_count, case when sum(failed) = 0 then 'success' else 'partial_failure' end as status
from (
  select source_name, 1 as done, is_new::int as created, (not is_new and changed <> '')::int as updated, 0 as failed from changes
  union all select source_name, 0, 0, 0, 1 from keyed where business_status not in ({_STATUSES}))
group by 1"""


def _counters(spark, sf_dir):
    rejected = split_valid(normalize_records(inputs.raw_business(spark, sf_dir)))[1]
    history = inputs.history(spark, sf_dir).where(~F.col("is_prior"))
    return jobs.run_counters(history, rejected)


@book.add("a10_run_counters", COUNTERS)
def counters(spark, sf_dir):
    return _counters(spark, sf_dir)


@book.add("s15_run_log", f"select *, 'collect' as job_type, timestamp '{inputs.AS_OF}' as finished_at from ({COUNTERS})")
def run_log(spark, sf_dir):
    rows = jobs.job_log(_counters(spark, sf_dir), inputs.as_of(), inputs.as_of())
    return rows.drop("started_at", "error_detail")


def _streamed(spark, sf_dir):
    """The records land in three steps and are folded in as a stream."""
    root = scratch_path(spark, "upserts")
    raw = inputs.raw_business(spark, sf_dir)
    store = TableStore(spark, f"{root}/tables")
    for step in range(3):
        raw.where(F.floor(F.col("seq") / FIRST_BATCH_SEQ) == step).write.mode("append").parquet(f"{root}/landing")
        upsert_stream(
            landed_records(spark, f"{root}/landing"), store, f"{root}/progress", lambda _: inputs.AS_OF, fuzzy=False,
        ).awaitTermination()
    return store


@book.add("k01_incremental_upsert", f"""
select distinct business_id, kind as key_type, value as key_value from ({IN_ORDER}) w
join (select seq, kind, value from ({KEY_ROWS}) union all {NAME_ROWS}) k using (seq)""")
def incremental(spark, sf_dir):
    """The key table afterwards shows under which business each record ended up."""
    return _streamed(spark, sf_dir).read("identifiers").select("business_id", "key_type", "key_value")


_LOGGED = " union all ".join(
    f"select business_id, seq, confidence, source_name, '{f}' as field_name from owned where cast({f} as varchar) <> ''" for f in MERGE_FIELDS)


@book.add("d07b_kept_sources", f"""
select * from (
with owned as (select g.*, w.business_id from good g join ({IN_ORDER}) w using (seq)),
logged as ({_LOGGED}),
judged as (select *, max(confidence) over (partition by business_id, field_name order by seq
  rows between unbounded preceding and 1 preceding) as seen from logged)
select business_id, count(distinct source_name) as source_count from judged
where seen is null or confidence >= seen group by 1)""")
def kept_sources(spark, sf_dir):
    """Sources per business as scores use them: kept by each batch next to the log, never read from it."""
    return scoring.source_counts(_streamed(spark, sf_dir).read("business_sources"))


@book.add("k02_rolling_counts", """
select window_start, window_start + interval 30 days as window_end, event_type, count(*) as n from (
  select event_type, unnest(generate_series(
    date_trunc('day', detected_at) - interval 29 days, date_trunc('day', detected_at), interval 1 day)) as window_start
  from biz_events)
group by 1, 2, 3""")
def rolling(spark, sf_dir):
    """The batch twin of the stream: the same windows over the whole table."""
    return rolling_counts(inputs.events(spark, sf_dir))


@book.add("k02b_rolling_stream", f"""
select * from (select window_start, window_start + interval 30 days as window_end, event_type, count(*) as n from (
  select event_type, unnest(generate_series(
    date_trunc('day', detected_at) - interval 29 days, date_trunc('day', detected_at), interval 1 day)) as window_start
  from biz_events) group by 1, 2, 3)
where window_end <= (select max(detected_at) from biz_events) - interval 1 day""")
def rolling_stream(spark, sf_dir):
    """The stream itself: the windows that are over for certain, one day after their end."""
    root = scratch_path(spark, "rolling")
    inputs.events(spark, sf_dir).write.parquet(f"{root}/landing")
    landed = spark.read.parquet(f"{root}/landing")
    counts = rolling_counts(spark.readStream.schema(landed.schema).parquet(f"{root}/landing"))
    counts.writeStream.format("parquet").option("path", f"{root}/counts").option(
        "checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/counts")
