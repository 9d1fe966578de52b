"""The whole run: collect, normalise, resolve, merge, events, scores, log."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ledgerloom.operators import contacts as ct
from ledgerloom.operators import events as ev
from ledgerloom.operators import jobs, merge, scoring, shared, suppression
from ledgerloom.operators.keys import new_identifiers, record_keys
from ledgerloom.operators.match import match_snapshot
from ledgerloom.operators.normalize import normalize_records, split_valid
from ledgerloom.operators.resolve import resolve_components, resolve_in_order
from ledgerloom.schemas import RAW, REJECTS
from ledgerloom.session import materialize, tune
from ledgerloom.sources.tables import GROWING_TABLES, TableStore, same_row
from ledgerloom.sources.topics import officer_contacts

log = logging.getLogger(__name__)

# A source gives its records, or its records and its rows of the reject table.
Source = Callable[[SparkSession], DataFrame | tuple[DataFrame, DataFrame]]


def moment(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


# Where a record comes from; the order of arrival is the order of these.
ARRIVAL = ["_source", "_file", "_block", "_row"]


def with_place(records: DataFrame, source: int) -> DataFrame:
    """Marks each record with its source, file, block of the file and row.

    To be applied to a scan, before any shuffle. Records of no file, or of
    several scans at once, are in the order of their partitions.
    """
    def placed(file: Column, block: Column) -> DataFrame:
        partition = F.spark_partition_id().cast("long")
        return records.select(
            "*", F.lit(source).alias("_source"), file.alias("_file"),
            F.when(file != "", block).otherwise(partition).alias("_block"), F.monotonically_increasing_id().alias("_row"))

    try:
        return placed(F.input_file_name(), F.input_file_block_start())
    except AnalysisException as error:
        if error.getCondition() != "MULTI_SOURCES_UNSUPPORTED_FOR_EXPRESSION":
            raise
        return placed(F.lit(""), F.lit(0).cast("long"))


def with_arrival_order(records: DataFrame, first: int = 0) -> DataFrame:
    """Number placed records from ``first`` without gaps, in order of arrival.

    Partitions follow file size, so the place of a record is not its partition:
    a count per block, a running sum over the blocks, and the place in the block.
    """
    block = ARRIVAL[:3]
    counts = records.groupBy(*block).agg(F.count(F.lit(1)).alias("_held"))
    # One short row per block of a file.
    before = counts.withColumn("_before", F.sum("_held").over(
        Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))).drop("_held")
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_row"))
    numbered = records.withColumn("_place", place).join(before, block)
    return numbered.withColumn(
        "seq", (F.lit(first) + F.coalesce("_before", F.lit(0)) + F.col("_place") - 1).cast("long")).drop(*ARRIVAL, "_place", "_before")


def collect(spark: SparkSession, sources: Mapping[str, Source], first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(RAW records of all sources, one status row per source, malformed lines as rows of the reject table).

    Each source is written out on its own, so one that cannot be read is
    reported and does not stop the others.
    """
    frames, rejects, outcomes = [], [spark.createDataFrame([], REJECTS)], []
    for place, (name, source) in enumerate(sources.items()):
        try:
            records, malformed = found if isinstance(found := source(spark), tuple) else (found, None)
            records = materialize(with_place(records, place), f"raw-{name}")
            if malformed is not None:
                rejects.append(materialize(malformed, f"malformed-{name}"))
            frames.append(records)
            outcomes.append((name, None))
        except Exception as error:  # any failure of a source is its status
            outcomes.append((name, str(error).split("\n", 1)[0]))
    status = jobs.source_status(outcomes, spark)
    malformed = merge.union_all(rejects)
    if not frames:
        return spark.createDataFrame([], RAW), status, malformed
    whole = with_arrival_order(merge.union_all(frames), first)
    return whole.select([F.col(f.name).cast(f.dataType) for f in RAW.fields]), status, malformed


def assign_businesses(records: DataFrame, store: TableStore, mode: str = "replay", fuzzy: bool = True) -> DataFrame:
    """(seq, business_id) of good records in one of three modes.

    replay:     as if records arrived one at a time (snapshot and batch)
    snapshot:   against the frozen snapshot; the rest become new businesses
    components: all records of the batch that share keys, or with ``fuzzy`` have
                alike names in one place, are one business

    Keys are looked up in their buckets. Alike names may be held by any business,
    so with ``fuzzy`` the name columns of all of them are read.
    """
    identifiers = store.lookup("identifiers", record_keys(records))
    businesses = store.read("businesses", buckets=None if fuzzy else [])
    if mode == "replay":
        return resolve_in_order(records, identifiers, businesses, fuzzy)
    hits = match_snapshot(records, identifiers, businesses, fuzzy).select("seq", "business_id")
    rest = records.join(hits, "seq", "left_anti")
    fresh = resolve_components(rest, fuzzy=fuzzy) if mode == "components" else rest.select(
        "seq", F.col("seq").alias("business_id"))
    return hits.unionByName(fresh)


def run_batch(
    store: TableStore,
    raw: DataFrame,
    as_of: datetime | str,
    mode: str = "replay",
    fuzzy: bool = True,
    log_all: bool = False,
    outcomes: DataFrame | None = None,
    stream: str | None = None,
    batch: int | None = None,
    malformed: DataFrame | None = None,
    most_names: int | None = None,
) -> int:
    """Fold a batch of RAW records into the store as its next version.

    The store remembers the highest ``seq`` ever seen, rejected records
    included, and the batch of a stream that this version holds. ``malformed``
    are rows of the reject table that never became records; they count as errors.
    With ``most_names``, a domain or phone held under more names, in this batch and
    those before that gave it too, matches nothing and is not registered.
    """
    tune(store.spark)
    now = moment(as_of)
    version = store.begin()

    seen = Observation()
    records = materialize(normalize_records(raw).observe(seen, F.max("seq").alias("last_seq")), "records")
    last_seq = seen.get["last_seq"]
    next_seq = max(store.next_seq(), -1 if last_seq is None else last_seq + 1)
    good, rejected = split_valid(records)
    rejected = rejected.select(REJECTS.names)
    if malformed is not None:
        rejected = rejected.unionByName(malformed.select(REJECTS.names))
    keyed = good
    if most_names is not None:
        fresh_names = shared.key_names(good)
        names = materialize(shared.add_names(store.lookup("key_names", fresh_names), fresh_names), "names")
        keyed = materialize(shared.without_shared_keys(good, shared.shared_keys(names, most_names)), "keyed")
        store.upsert("key_names", names, version)
    ids = materialize(assign_businesses(keyed, store, mode, fuzzy), "ids")
    records = materialize(good.join(ids, "seq"), "assigned")
    keyed = records if most_names is None else materialize(keyed.join(ids, "seq"), "keyed")

    # From here on only the buckets of these businesses and keys are read and written.
    touched = ids.select("business_id").distinct()
    prior = materialize(store.lookup("businesses", touched), "prior")
    history = materialize(merge.record_history(records, prior), "history")

    store.write("field_sources", merge.accepted_values(history, now, log_all), version)
    store.write("events", ev.change_events(history, now), version)
    store.write("rejects", rejected, version)
    known_keys = store.lookup("identifiers", record_keys(keyed, with_name=True))
    store.upsert("identifiers", new_identifiers(keyed, known_keys), version)

    sources = materialize(store.lookup("business_sources", touched), "sources")
    gained = merge.accepted_sources(history, log_all)
    gained = materialize(gained.join(sources, same_row(gained, sources, sources.columns), "left_anti"), "gained")
    merged = merge.merge_snapshot(prior, history, now)
    scored = scoring.rescore(merged, store.lookup("contacts", touched), sources.unionByName(gained), now)
    store.upsert("businesses", scored, version)
    store.upsert("business_sources", gained, version)

    results = merge.upsert_results(history).join(records.select("seq", "source_name"), "seq")
    log_rows = jobs.job_log(jobs.run_counters(results, rejected), now, now)
    if outcomes is not None:
        log_rows = log_rows.unionByName(jobs.failed_job_log(outcomes, now, now))
    store.write("job_runs", log_rows, version)
    store.commit(version, stream, batch, next_seq)
    return version


def run_sources(
    store: TableStore, sources: Mapping[str, Source], as_of: datetime | str, mode: str = "replay", fuzzy: bool = True,
    most_names: int | None = None,
) -> int:
    """Collect every source and fold all of it in as one version."""
    raw, outcomes, malformed = collect(store.spark, sources, store.next_seq())
    raw = materialize(raw, "raw")
    return run_batch(store, raw, as_of, mode=mode, fuzzy=fuzzy, outcomes=outcomes, malformed=malformed, most_names=most_names)


def _amend(store: TableStore, businesses: DataFrame, added: Mapping[str, DataFrame]) -> int:
    """A version in which some businesses change and rows are added to other tables."""
    version = store.begin()
    store.upsert("businesses", businesses, version)
    for name, rows in added.items():
        if name in GROWING_TABLES:
            store.write(name, rows, version)
        else:
            store.upsert(name, rows, version)
    store.commit(version)
    return version


def _add_contacts(store: TableStore, found: DataFrame, source: str, as_of: datetime | str) -> int:
    now = moment(as_of)
    rows = materialize(ct.as_contact_rows(found, source, now), "found")
    known = store.lookup("contacts", rows)
    fresh = materialize(rows.join(known.select("contact_id"), "contact_id", "left_anti").distinct(), "contacts")
    scored, _ = scoring.add_contacts(
        store.lookup("businesses", fresh), known, fresh, store.lookup("business_sources", fresh), now)
    return _amend(store, scored, {"contacts": fresh})


def enrich_websites(store: TableStore, pages: DataFrame, as_of: datetime | str, limit: int | None = None) -> int:
    """Contacts of businesses without any, from landed pages of their sites."""
    targets = ct.website_targets(store.read("businesses"), store.read("contacts"), limit)
    return _add_contacts(store, ct.site_contacts(targets, pages), ct.WEBSITE_SOURCE, as_of)


def enrich_officers(store: TableStore, payloads: DataFrame, as_of: datetime | str, limit: int | None = None) -> int:
    """Officers of businesses without any, from landed corporation JSON
    (corporation_number, payload)."""
    targets = ct.officer_targets(store.read("businesses"), store.read("contacts"), limit)
    found = officer_contacts(payloads.join(targets.select("business_id", "corporation_number"), "corporation_number"))
    return _add_contacts(store, found, ct.OFFICER_SOURCE, as_of)


def refresh_stale(store: TableStore, as_of: datetime | str) -> int:
    """Touch and rescore the stale businesses; their number, counted as they are written, is logged."""
    now = moment(as_of)
    counted = Observation()
    due = store.read("businesses").where(scoring.stale(now)).observe(counted, F.count(F.lit(1)).alias("refreshed"))
    due = materialize(due, "stale")
    log.info("%d stale businesses refreshed", counted.get["refreshed"])
    refreshed, _ = scoring.touch_stale(due, store.lookup("contacts", due), store.lookup("business_sources", due), now)
    return _amend(store, refreshed, {})


def suppress(store: TableStore, requests: DataFrame) -> int:
    """Record do-not-call requests and mark their businesses."""
    marked = suppression.mark_do_not_call(store.lookup("businesses", requests), requests)
    return _amend(store, marked, {"dnc_requests": requests})
