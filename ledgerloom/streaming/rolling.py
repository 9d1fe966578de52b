"""Rolling event counts over a stream of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_counts(
    events: DataFrame, width: str = "30 days", step: str = "1 day", lateness: str = "1 day"
) -> DataFrame:
    """Events per type in sliding windows; works on streams and on tables.

    An event counts once, in the pane of its step; windows add up panes, a row a
    step and type, and no event is copied into every window that holds it.
    ``width`` is a multiple of ``step``.
    """
    panes = events.withWatermark("detected_at", lateness).groupBy(
        F.window("detected_at", step).alias("pane"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        panes.groupBy(F.window(F.window_time("pane"), width, step).alias("window"), "event_type").agg(F.sum("n").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n")
    )
