"""Merging records into golden records by source confidence.

A value is accepted when its confidence is not below any earlier one of the same
business and field; the last accepted value is current. Records stay wide: one
shuffle on the business serves all sixteen fields, instead of sixteen narrow
rows per record.

A business that holds very many records is cut into runs of consecutive seq. A
run is one window group, and what a run needs from earlier ones (best
confidence, last accepted value) is carried over by a table of one row per run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.measures import classify_size
from ledgerloom.operators.skew import HOT_ROWS, lookup
from ledgerloom.schemas import BUSINESSES, MERGE_FIELDS

# Records of one business that a task may sort as one group.
RUN_LENGTH = 1_000_000
PROVENANCE = ["source_name", "source_kind", "source_url"]


def _text(field: str) -> Column:
    """The value as logged and compared; '' counts as missing."""
    return F.nullif(F.col(field).cast("string"), F.lit(""))


def _confidence(field: str) -> Column:
    """Confidence this row brings for a field; NULL when it brings no value."""
    own = F.when(F.col("is_prior"), F.col("picked")[field]).otherwise(F.col("confidence"))
    return F.when(_text(field).isNotNull(), own)


def _each(expr: Callable[[str], Column], prefix: str, fields: list[str] = MERGE_FIELDS) -> list[Column]:
    return [expr(f).alias(f"{prefix}{f}") for f in fields]


def with_prior(records: DataFrame, prior: DataFrame | None, fields: list[str] = MERGE_FIELDS) -> DataFrame:
    """Records, plus the present golden record of each business as row seq -1."""
    picked = "struct<" + ",".join(f"{f}:decimal(4,2)" for f in fields) + ">"
    sizes = ["employee_count_min", "employee_count_max"]
    rows = records.select(
        "business_id", "seq", F.lit(False).alias("is_prior"), "confidence", *fields,
        F.lit(None).cast(picked).alias("picked"), *sizes, *PROVENANCE)
    if prior is None:
        return rows
    return rows.unionByName(prior.select(
        "business_id", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("is_prior"),
        F.lit(None).cast("decimal(4,2)").alias("confidence"), *fields,
        F.struct(*[F.col("picked")[f].alias(f) for f in fields]).alias("picked"),
        *[F.lit(None).cast("int").alias(c) for c in sizes],
        *[F.lit(None).cast("string").alias(c) for c in PROVENANCE]))


def hot_businesses(records: DataFrame, run_length: int = RUN_LENGTH) -> DataFrame:
    """Businesses with more records than one run: at most rows / run_length."""
    return records.groupBy("business_id").count().where(F.col("count") > run_length).select("business_id")


def record_history(
    records: DataFrame, prior: DataFrame | None = None, run_length: int = RUN_LENGTH, fields: list[str] = MERGE_FIELDS
) -> DataFrame:
    """Every row with, per field, what was accepted and what it replaced.

    Adds ``ok_<field>`` (accepted), ``was_<field>`` (last accepted value before),
    ``is_new`` (first record of its business) and ``changed_fields``.
    """
    rows = with_prior(records, prior, fields)
    hot = hot_businesses(records, run_length)
    if hot.isEmpty():
        return _named_changes(_judge(rows, ["business_id"], None, None, fields), fields)

    # The list of hot businesses is bounded by its construction.
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "business_id", "left").withColumn(
        "run", F.when(F.col("hot"), F.floor(F.col("seq") / run_length)).otherwise(0))
    key = ["business_id", "run"]
    hot_rows = rows.where("hot")
    earlier = Window.partitionBy("business_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)

    best = hot_rows.groupBy(*key).agg(
        *_each(lambda f: F.max(_confidence(f)), "top_", fields), F.count(F.lit(1)).alias("rows"))
    best = best.select(
        *key, *_each(lambda f: F.max(f"top_{f}").over(earlier), "top_", fields),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))

    first = _judge(rows, key, best, None, fields)
    last = first.where("hot").groupBy(*key).agg(
        *_each(lambda f: F.max_by(F.when(F.col(f"ok_{f}"), _text(f)),
                                  F.when(F.col(f"ok_{f}"), F.col("seq"))), "last_", fields))
    last = last.select(*key, *_each(lambda f: F.last(f"last_{f}", ignorenulls=True).over(earlier), "last_", fields))
    return _named_changes(_judge(rows, key, best, last, fields), fields).drop("hot", "run")


def _judge(
    rows: DataFrame, key: list[str], best: DataFrame | None, last: DataFrame | None, fields: list[str]
) -> DataFrame:
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    judged = rows.select(
        "*", *_each(lambda f: F.max(_confidence(f)).over(before), "seen_", fields),
        F.count(F.lit(1)).over(before).alias("rows_seen"))
    seen = {f: F.col(f"seen_{f}") for f in fields}
    count = F.col("rows_seen")
    if best is not None:
        judged = judged.join(best, key, "left")
        seen = {f: F.greatest(f"seen_{f}", f"top_{f}") for f in fields}
        count = count + F.coalesce("rows_before", F.lit(0))
    judged = judged.select(
        *rows.columns, (count == 0).alias("is_new"),
        *_each(lambda f: F.coalesce(
            _confidence(f) >= F.coalesce(seen[f], F.lit(0)), F.lit(False)), "ok_", fields))
    judged = judged.select("*", *_each(
        lambda f: F.last(F.when(F.col(f"ok_{f}"), _text(f)), ignorenulls=True).over(before), "was_", fields))
    if last is not None:
        judged = judged.join(last, key, "left").select(
            *[c for c in judged.columns if not c.startswith("was_")],
            *_each(lambda f: F.coalesce(f"was_{f}", f"last_{f}"), "was_", fields))
    return judged


def _named_changes(judged: DataFrame, fields: list[str]) -> DataFrame:
    # Functions with a lambda, array_compact among them, are interpreted row by row; set functions are compiled.
    names = F.array(*[
        F.when(F.col(f"ok_{f}") & (F.coalesce(f"was_{f}", F.lit("")) != _text(f)), F.lit(f))
        for f in fields])
    changed = F.when(F.col("is_new") | F.col("is_prior"), F.array().cast("array<string>")).otherwise(
        F.array_except(names, F.array(F.lit(None).cast("string"))))
    return judged.withColumn("changed_fields", changed)


def accepted_values(history: DataFrame, as_of: Column, log_all: bool = False) -> DataFrame:
    """Provenance rows: one per accepted (``log_all``: per non-empty) value."""
    # An accepted value is never missing, so what is not logged is left out after the unfolding.
    entries = F.array(*[
        F.struct(F.lit(f).alias("field_name"), (_text(f) if log_all else F.when(F.col(f"ok_{f}"), _text(f))).alias("field_value"))
        for f in MERGE_FIELDS])
    return history.where(~F.col("is_prior")).select(
        "business_id", F.inline(entries), *PROVENANCE, "confidence", "seq", as_of.alias("retrieved_at")).where(
        F.col("field_value").isNotNull())


def accepted_sources(history: DataFrame, log_all: bool = False) -> DataFrame:
    """(business_id, source_name) of the rows ``accepted_values`` logs, without unfolding their fields."""
    logged = reduce(or_, [_text(f).isNotNull() if log_all else F.col(f"ok_{f}") for f in MERGE_FIELDS])
    return history.where(~F.col("is_prior") & logged).select("business_id", "source_name").distinct()


def upsert_results(history: DataFrame) -> DataFrame:
    """Per record: business, whether it created it, and the fields it changed."""
    return history.where(~F.col("is_prior")).select("seq", "business_id", "is_new", "changed_fields")


def flag_current(field_sources: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark the current value of each (business, field).

    Confidence never falls along the accepted values, so the last one is
    current; with a log of all values the strongest one is.
    """
    order = F.struct("confidence", "seq")
    key = ["business_id", "field_name"]
    pick = field_sources.groupBy(*key).agg(F.max(order).alias("pick"), F.count(F.lit(1)).alias("held"))
    return (
        lookup(field_sources, pick, key, "held", "seq", hot_rows)
        .withColumn("is_current_pick", order == F.col("pick"))
        .drop("pick")
    )


def golden_records(rows: DataFrame) -> DataFrame:
    """Current value and confidence of every field, size and counts per business.

    ``rows`` as made by ``with_prior``. One aggregation, combined before the
    shuffle: the value is the latest one of the highest confidence.
    """
    def pick(field: str) -> Column:
        conf = _confidence(field)
        return F.max(F.when(conf.isNotNull(), F.struct(
            conf.alias("confidence"), F.col("seq").alias("seq"), F.col(field).alias("value"))))

    size = classify_size(F.col("employee_count_min"), F.col("employee_count_max"))
    sized = size["size_category"].isNotNull()
    best = rows.groupBy("business_id").agg(
        *_each(pick, "pick_"),
        F.max_by(F.when(sized, size), F.when(sized, F.col("seq"))).alias("size"),
    )
    return best.select(
        "business_id",
        *[F.col(f"pick_{f}")["value"].alias(f) for f in MERGE_FIELDS],
        F.struct(*[F.col(f"pick_{f}")["confidence"].alias(f) for f in MERGE_FIELDS]).alias("picked"),
        F.col("size")["size_category"].alias("size_category"),
        F.col("size")["size_confidence"].alias("size_confidence"),
    )


def merge_snapshot(snapshot: DataFrame | None, history: DataFrame, as_of: Column) -> DataFrame:
    """Golden records after the batch: merged, created and untouched ones.

    Scores are left as they were; ``rescore`` brings them up to date.
    """
    rows = history
    golden = golden_records(rows)
    any_change = (F.size("changed_fields") > 0) | F.col("is_new")
    touched = rows.where(~F.col("is_prior")).groupBy("business_id").agg(F.max(any_change).alias("changed"))
    fresh = golden.join(touched, "business_id")
    if snapshot is None:
        snapshot = history.sparkSession.createDataFrame([], BUSINESSES)
    old = snapshot.select(*[F.col(c).alias(f"old_{c}") for c in snapshot.columns])
    both = old.join(fresh, F.col("old_business_id") == F.col("business_id"), "full_outer")
    is_touched = F.col("business_id").isNotNull()
    values = {
        "business_id": F.coalesce("business_id", "old_business_id"),
        **{c: F.when(is_touched, F.col(c)).otherwise(F.col(f"old_{c}")) for c in [*MERGE_FIELDS, "picked"]},
        "size_category": F.coalesce("size_category", "old_size_category"),
        "size_confidence": F.coalesce("size_confidence", "old_size_confidence", F.lit("estimated")),
        "quality_score": F.coalesce("old_quality_score", F.lit(0).cast("decimal(5,2)")),
        "lead_ready": F.coalesce("old_lead_ready", F.lit(False)),
        "do_not_call": F.coalesce("old_do_not_call", F.lit(False)),
        "do_not_call_reason": F.col("old_do_not_call_reason"),
        "do_not_call_at": F.col("old_do_not_call_at"),
        "first_seen_at": F.coalesce("old_first_seen_at", as_of),
        "last_verified_at": F.when(is_touched, as_of).otherwise(F.col("old_last_verified_at")),
        "last_updated_at": F.when(F.coalesce("changed", F.lit(False)), as_of).otherwise(
            F.col("old_last_updated_at")),
        "created_at": F.coalesce("old_created_at", as_of),
    }
    return both.select(*[expr.alias(name) for name, expr in values.items()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
