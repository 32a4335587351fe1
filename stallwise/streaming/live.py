"""Daily KPIs and funnel counts kept up to date from streams.

The measures are those of the batch operators. Distinct sessions cannot be
counted exactly on a stream without keeping every session; here sessions are
deduplicated within the watermark, which is exact for sessions shorter than it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.sources.schemas import STAGES


def live_daily_kpis(orders: DataFrame, late: str = "1 day", sla: float = M.SLA_MINUTES) -> DataFrame:
    """Core KPIs per day of event time. A day is final once the watermark has passed its end.

    Watermarks need a timestamp with time zone; a naive one is read in the session's zone.
    """
    return (
        orders.withColumn("order_ts", F.col("order_ts").cast("timestamp"))
        .withWatermark("order_ts", late)
        .groupBy(F.window("order_ts", "1 day"))
        .agg(
            M.orders().alias("orders"),
            M.gmv_delivered().alias("gmv"),
            M.aov().alias("aov"),
            M.cancellation_pct().alias("cancellation_rate_pct"),
            M.delivery_pct().alias("delivery_rate_pct"),
            M.sla_pct_all(sla).alias("sla_45_pct"),
        )
        .select(F.col("window.start").alias("order_date"), "*")
        .drop("window")
    )


def live_funnel(events: DataFrame, late: str = "1 day", stages: Iterable[str] = tuple(STAGES)) -> DataFrame:
    """Sessions per stage and day, a session counted once per stage."""
    return (
        events.filter(F.col("event_name").isin(*stages))
        .withColumn("event_ts", F.col("event_ts").cast("timestamp"))
        .withWatermark("event_ts", late)
        .dropDuplicatesWithinWatermark(["session_id", "event_name"])
        .groupBy(F.window("event_ts", "1 day"), "event_name")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select(F.col("window.start").alias("date"), F.col("event_name").alias("stage"), "sessions")
    )
