"""Do-not-call marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: the reason noted when a request gives none.
DEFAULT_REASON = "Requested by business"


def latest_requests(requests: DataFrame) -> DataFrame:
    """The newest request of each business."""
    order = F.struct("requested_at", "note", "channel")
    return requests.groupBy("business_id").agg(
        F.max("requested_at").alias("requested_at"),
        F.max_by(F.coalesce("note", F.lit(DEFAULT_REASON)), order).alias("note"))


def mark_do_not_call(businesses: DataFrame, requests: DataFrame) -> DataFrame:
    """Flag, reason and time on every business that asked not to be called."""
    asked = latest_requests(requests).select(
        "business_id", F.col("note").alias("asked_reason"), F.col("requested_at").alias("asked_at"))
    hit = F.col("asked_at").isNotNull()
    marked = businesses.join(asked, "business_id", "left").withColumns({
        "do_not_call": F.col("do_not_call") | hit,
        "do_not_call_reason": F.coalesce("asked_reason", "do_not_call_reason"),
        "do_not_call_at": F.coalesce("asked_at", "do_not_call_at"),
    })
    return marked.select(businesses.columns)
