"""Run log, run counters, alerts and source statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.leads import message_rows

RECENT_JOBS = 10
JOB_PAGE = 50
JOB_COLUMNS = [
    "source_name", "job_type", "status", "records_collected", "records_new", "records_updated",
    "errors_count", "started_at", "finished_at", "error_detail",
]


def run_counters(results: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per source: collected, new, updated, errors and the resulting status.

    results: source_name, is_new, changed_fields; rejects: source_name.
    """
    zero = F.lit(0).cast("long")
    done = results.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("records_collected"),
        F.count_if("is_new").alias("records_new"),
        F.count_if(~F.col("is_new") & (F.size("changed_fields") > 0)).alias("records_updated"),
        zero.alias("errors_count"))
    failed = rejects.groupBy("source_name").agg(
        zero.alias("records_collected"), zero.alias("records_new"), zero.alias("records_updated"),
        F.count(F.lit(1)).alias("errors_count"))
    counts = ["records_collected", "records_new", "records_updated", "errors_count"]
    return done.unionByName(failed).groupBy("source_name").agg(
        *[F.sum(c).alias(c) for c in counts]
    ).withColumn("status", F.when(F.col("errors_count") == 0, "success").otherwise("partial_failure"))


def job_log(counters: DataFrame, started_at: Column, finished_at: Column, job_type: str = "collect") -> DataFrame:
    """Run-log rows of a finished run."""
    return counters.select(
        "source_name", F.lit(job_type).alias("job_type"), "status", started_at.alias("started_at"),
        finished_at.alias("finished_at"), "records_collected", "records_new", "records_updated",
        "errors_count", F.lit(None).cast("string").alias("error_detail"))


def source_status(outcomes: list[tuple[str, str | None]], spark) -> DataFrame:
    """One row per configured source: success, or failed with its error."""
    return spark.createDataFrame(
        [(name, "success" if error is None else "failed", error) for name, error in outcomes],
        "source_name string, status string, error_detail string")


def failed_job_log(outcomes: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """Run-log rows of the sources that could not be opened at all."""
    zero = F.lit(0).cast("long")
    return outcomes.where(F.col("status") == "failed").select(
        "source_name", F.lit("collect").alias("job_type"), "status", started_at.alias("started_at"),
        finished_at.alias("finished_at"), zero.alias("records_collected"), zero.alias("records_new"),
        zero.alias("records_updated"), F.lit(1).cast("long").alias("errors_count"), "error_detail")


def filter_jobs(jobs: DataFrame, status: str | None = None, since: Column | None = None) -> DataFrame:
    if status:
        jobs = jobs.where(F.col("status") == status)
    if since is not None:
        jobs = jobs.where(F.col("started_at") >= since)
    return jobs


def latest_jobs(jobs: DataFrame, limit: int = RECENT_JOBS) -> DataFrame:
    tie = [F.desc("id")] if "id" in jobs.columns else [F.col("source_name")]
    return jobs.orderBy(F.desc("started_at"), *tie).limit(limit)


def failure_alert(jobs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Alert rows for the jobs that failed in the last minutes, newest first."""
    failed = filter_jobs(jobs, "failed", as_of - F.expr(f"interval {minutes} minutes"))
    text = F.concat(
        F.lit("• "), F.col("source_name"), F.lit(" ("), F.col("job_type"), F.lit(") — "),
        F.col("errors_count").cast("string"), F.lit(" error(s) at "),
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(": "),
        F.coalesce(F.nullif("error_detail", F.lit("")), F.lit("see logs")))
    lines = failed.select("id", "started_at", text.alias("line"))
    return message_rows(lines, F.lit(":rotating_light: *Lead-gen pipeline failure(s)*"), F.desc("started_at"), F.desc("id"))


def businesses_per_source(field_sources: DataFrame) -> DataFrame:
    return (
        field_sources.select("source_name", "business_id").distinct()
        .groupBy("source_name").agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "source_name")
    )


def source_growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Businesses per source before and after a run, and the difference."""
    old = before.select("source_name", F.col("cnt").alias("cnt_before"))
    new = after.select("source_name", F.col("cnt").alias("cnt_after"))
    joined = old.join(new, "source_name", "full_outer").na.fill(0, ["cnt_before", "cnt_after"])
    return joined.withColumn("added", F.col("cnt_after") - F.col("cnt_before"))
