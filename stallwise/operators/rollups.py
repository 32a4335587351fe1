"""Daily series kept as partial aggregates that are merged, and maintained a day at a time.

A day's orders become one row of sums and counts. Every daily measure, and every measure of
a period, follows from these rows, so a day that arrives or changes costs a scan of its own
orders only: its row is computed anew and the others are kept. The kept table has one row per
calendar day and is replaced whole (``sources.versions``), so readers never see half of it.

Averages are kept as sum and count. Money is summed in cents, so its sums are exact; sums of
ETA minutes are exact for whole minutes.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.functions.numeric import cents, half_up, money, ratio
from stallwise.operators.scope import Period
from stallwise.sources import versions

SUMS = (
    "orders", "delivered_orders", "cancelled_sum", "cancelled_n", "delivered_sum", "delivered_n",
    "revenue_cents", "delivered_cents", "on_time", "on_time_n", "eta_sum", "eta_n",
)


def daily_parts(orders: DataFrame, sla: float = M.SLA_MINUTES) -> DataFrame:
    """One row per day (the day without a time is null) with everything the daily measures are made of."""
    on_time = M.on_time(sla).cast("int")
    return orders.groupBy(F.to_date("order_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"),
        M.delivered_orders().alias("delivered_orders"),
        F.sum("cancelled").alias("cancelled_sum"),
        F.count("cancelled").alias("cancelled_n"),
        F.sum("delivered").alias("delivered_sum"),
        F.count("delivered").alias("delivered_n"),
        F.sum(cents("revenue")).alias("revenue_cents"),
        M.delivered_cents().alias("delivered_cents"),
        F.sum(on_time).alias("on_time"),
        F.count(on_time).alias("on_time_n"),
        F.sum("eta_minutes").alias("eta_sum"),
        F.count("eta_minutes").alias("eta_n"),
    )


def merged(parts: DataFrame, *by: Column | str) -> DataFrame:
    """Partial aggregates of longer periods."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def refresh(
    spark: SparkSession, name: str, orders: DataFrame, days: Iterable[date] | None = None, folder: str | None = None
) -> DataFrame:
    """The kept parts, after those of ``days`` were computed anew from ``orders``; all days at first, or without ``days``.

    Only orders of these days are read. Days without orders lose their row.
    """
    if days is None or versions.current_version(spark, name) is None:
        versions.replace_table(daily_parts(orders), name, folder=folder)
    else:
        days = sorted(set(days))
        kept = spark.table(name).where(F.col("day").isNull() | ~F.col("day").isin(days))
        anew = [daily_parts(period.filter(orders, "order_ts")) for period in _runs(days)]
        versions.replace_table(reduce(DataFrame.unionByName, anew, kept), name, folder=folder)
    return spark.table(name)


def _runs(days: list[date]) -> list[Period]:
    """The runs of days that follow each other."""
    runs: list[Period] = []
    for day in days:
        if runs and runs[-1].last == day - timedelta(days=1):
            runs[-1] = Period(runs[-1].first, day)
        else:
            runs.append(Period(day, day))
    return runs


def _pct(part: str, whole: str) -> Column:
    return ratio(F.col(part), F.col(whole)) * F.lit(100.0)


def daily_kpis(parts: DataFrame) -> DataFrame:
    """``kpis.daily_kpis`` from daily parts."""
    gmv = money(F.col("delivered_cents"))
    return parts.select(
        F.col("day").cast("timestamp_ntz").alias("order_date"),
        "orders",
        gmv.alias("gmv"),
        ratio(gmv, F.col("delivered_orders")).alias("aov"),
        _pct("cancelled_sum", "cancelled_n").alias("cancellation_rate_pct"),
        _pct("delivered_sum", "delivered_n").alias("delivery_rate_pct"),
        _pct("on_time", "on_time_n").alias("sla_45_pct"),
    ).orderBy("order_date")


def daily_series(parts: DataFrame) -> DataFrame:
    """``kpis.daily_series`` from daily parts."""
    return parts.where("day IS NOT NULL").select(
        F.col("day").alias("date"),
        "orders",
        money(F.col("revenue_cents")).alias("gmv"),
        _pct("cancelled_sum", "cancelled_n").alias("cancellation_rate"),
        ratio(F.col("eta_sum"), F.col("eta_n")).alias("avg_eta"),
    )


def kpi_summary(parts: DataFrame) -> DataFrame:
    """``kpis.kpi_summary`` from daily parts."""
    whole = merged(parts)
    values = {
        "delivery_rate_pct": _pct("delivered_sum", "delivered_n"),
        "cancellation_rate_pct": _pct("cancelled_sum", "cancelled_n"),
        "avg_eta_minutes": ratio(F.col("eta_sum"), F.col("eta_n")),
        "revenue_per_order": ratio(money(F.col("delivered_cents")), F.col("orders")),
        "total_revenue": money(F.col("revenue_cents")),
    }
    return whole.select(
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"),
        F.col("delivered_sum").alias("delivered_orders"),
        *(half_up(value, 2).alias(name) for name, value in values.items()),
    )
