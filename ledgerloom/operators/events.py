"""New-business and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Ages, in days, up to which a new business gets a window event.
WINDOW_DAYS = {"new_7d": 7, "new_30d": 30}


def change_events(history: DataFrame, as_of: Column) -> DataFrame:
    """Events of the batch's records.

    The first record of a business gives new_today, and the window events its
    incorporation date allows; a later one gives recently_changed when it
    changed anything.
    """
    age = F.datediff(as_of, F.col("incorporation_date"))
    new = F.col("is_new")
    kinds = F.array_compact(F.array(
        F.when(new, F.lit("new_today")),
        *[F.when(new & (age <= days), F.lit(kind)) for kind, days in WINDOW_DAYS.items()],
        F.when(~new & (F.size("changed_fields") > 0), F.lit("recently_changed")),
    ))
    return (
        history.where(~F.col("is_prior"))
        .select("business_id", F.explode(kinds).alias("event_type"), as_of.alias("detected_at"),
                "changed_fields")
        .withColumn("changed_fields", F.when(F.col("event_type") == "recently_changed", F.col("changed_fields")))
    )


def recent_event_counts(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return (
        events.where(F.col("detected_at") >= as_of - F.expr(f"interval {days} days"))
        .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    )


def latest_events(events: DataFrame, per_business: int = 20) -> DataFrame:
    """The newest events of each business.

    The bound on the row number reaches Spark's group limit, so each map task
    keeps its newest rows per business before the shuffle.
    """
    newest = Window.partitionBy("business_id").orderBy(F.col("detected_at").desc(), F.col("event_id").desc())
    return events.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= per_business)
