"""Engagement of an event stream in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What an event counts as: the value's whole part for engagement, one hundred impressions for a view.
ENGAGEMENTS = {"likes": "click", "shares": "signup", "comments": "purchase"}
IMPRESSIONS_PER_VIEW = 100


def engagement_windows(events: DataFrame, width: str = "10 minutes", lateness: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Per tumbling window: impressions, likes, shares, comments, events and the engagement rate in percent.

    ``events`` (``time``, ``event_type``, ``value``) is a table or a stream; on a stream a window is given out once no
    event up to ``lateness`` behind the newest one can fall into it, later events are left out and its state goes. Null
    values count as 0, events without time are left out, a window without impressions has a null rate. A window is summed
    in every task before the shuffle, so one that holds most events is no hot key.
    """
    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.floor(F.coalesce("value", F.lit(0.0))))), F.lit(0))

    timed = events.select(F.col(time).cast("timestamp").alias("_time"), "event_type", "value").where("_time is not null")
    summed = timed.withWatermark("_time", lateness).groupBy(F.window("_time", width).alias("_window")).agg(
        (F.count_if(F.col("event_type") == "view") * IMPRESSIONS_PER_VIEW).alias("impressions"),
        *[of(kind).alias(name) for name, kind in ENGAGEMENTS.items()],
        F.count(F.lit(1)).alias("n_events"),
    )
    engaged = sum((F.col(name) for name in ENGAGEMENTS), F.lit(0))
    rate = F.try_divide(engaged * 100.0, F.col("impressions"))
    return summed.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "impressions", *ENGAGEMENTS,
        "n_events", rate.alias("engagement_rate"))
