"""Headline numbers, daily series and demand by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions import measures as M
from stallwise.functions.numeric import cents, half_up, ratio


def kpi_summary(orders: DataFrame) -> DataFrame:
    """One row of headline numbers, rounded to two decimals."""
    return orders.agg(
        M.orders().alias("orders"),
        F.sum("delivered").alias("delivered_orders"),
        M.delivery_pct().alias("delivery_rate_pct"),
        M.cancellation_pct().alias("cancellation_rate_pct"),
        M.avg_eta().alias("avg_eta_minutes"),
        M.revenue_per_order().alias("revenue_per_order"),
        M.gmv_all().alias("total_revenue"),
    ).select(
        "orders",
        "delivered_orders",
        *(
            half_up(c, 2).alias(c)
            for c in (
                "delivery_rate_pct",
                "cancellation_rate_pct",
                "avg_eta_minutes",
                "revenue_per_order",
                "total_revenue",
            )
        ),
    )


def daily_kpis(orders: DataFrame, sla: float = M.SLA_MINUTES) -> DataFrame:
    """Core KPIs per day; the on-time rate is over all orders."""
    return (
        orders.groupBy(calendar.day("order_ts").alias("order_date"))
        .agg(
            M.orders().alias("orders"),
            M.gmv_delivered().alias("gmv"),
            M.aov().alias("aov"),
            M.cancellation_pct().alias("cancellation_rate_pct"),
            M.delivery_pct().alias("delivery_rate_pct"),
            M.sla_pct_all(sla).alias("sla_45_pct"),
        )
        .orderBy("order_date")
    )


def _trailing(rows: int):
    # Runs over daily aggregates: one row per calendar day, whatever the volume.
    return Window.orderBy("date").rowsBetween(1 - rows, 0)


def rolling_7d_orders(orders: DataFrame, rows: int = 7) -> DataFrame:
    """Orders per day with the average over the last rows; a day without orders is no row."""
    daily = orders.groupBy(calendar.day("order_ts").alias("date")).agg(M.orders().alias("orders"))
    return daily.select(
        F.col("date").alias("order_date"), "orders", F.avg("orders").over(_trailing(rows)).alias("rolling_7d_orders")
    ).orderBy("order_date")


def daily_series(orders: DataFrame) -> DataFrame:
    """Orders, GMV over all rows, cancellation rate and mean ETA per date."""
    return (
        orders.filter(F.col("order_ts").isNotNull())
        .groupBy(F.to_date("order_ts").alias("date"))
        .agg(
            M.orders().alias("orders"),
            M.gmv_all().alias("gmv"),
            M.cancellation_pct().alias("cancellation_rate"),
            M.avg_eta().alias("avg_eta"),
        )
    )


def daily_trends_7d(orders: DataFrame, rows: int = 7) -> DataFrame:
    """Daily series with their trailing averages; shorter windows at the start."""
    window = _trailing(rows)
    return (
        daily_series(orders)
        .select(
            "*",
            F.avg("orders").over(window).alias("orders_7d"),
            # Cents keep the window sum exact.
            (F.avg(cents("gmv")).over(window) / F.lit(100.0)).alias("gmv_7d"),
            F.avg("cancellation_rate").over(window).alias("cancel_7d"),
            F.avg("avg_eta").over(window).alias("eta_7d"),
        )
        .orderBy("date")
    )


def first_max(value: Column, key: Column, payload: Column) -> Column:
    """``payload`` of the row with the greatest value, the smallest key winning ties; null values don't count.

    Structs compare field by field, so the smallest key of the negated value is it.
    """
    order = F.struct((-value).alias("v"), key.alias("k"))
    return F.min_by(payload, F.when(value.isNotNull(), order))


def peak_and_worst_day(orders: DataFrame) -> DataFrame:
    """The day with most orders and the day with the highest cancellation rate, earliest on ties."""

    def pick(measure: str) -> Column:
        value = F.col(measure).cast("double")
        return first_max(value, F.col("date"), F.struct("date", value.alias("value")))

    picked = daily_series(orders).agg(pick("orders").alias("peak"), pick("cancellation_rate").alias("worst"))
    return picked.select(
        F.inline(
            F.array(
                F.struct(F.lit("peak_demand").alias("kind"), "peak.date", "peak.value"),
                F.struct(F.lit("worst_cancellation").alias("kind"), "worst.date", "worst.value"),
            )
        )
    ).filter(F.col("date").isNotNull())


def repeat_customer_rate(orders: DataFrame, min_orders: int = 2) -> DataFrame:
    """Share of customers with a completed order who have at least ``min_orders``."""
    customers = orders.filter(M.delivered()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return customers.agg(
        (ratio(F.count_if(F.col("n") >= min_orders), F.count(F.lit(1))) * F.lit(100.0)).alias(
            "repeat_customer_rate_pct"
        )
    )


def peak_hour_demand(orders: DataFrame) -> DataFrame:
    """Orders and AOV per hour of day, busiest first."""
    return (
        orders.groupBy(calendar.hour("order_ts").alias("order_hour"))
        .agg(M.orders().alias("orders"), M.aov().alias("aov"))
        .orderBy(F.desc("orders"), "order_hour")
    )


def hourly_demand(orders: DataFrame, hour: str = "hour") -> DataFrame:
    """Orders and GMV per hour, with the busiest one marked (earliest on ties)."""
    hourly = (
        orders.filter(F.col(hour).isNotNull())
        .groupBy(F.col(hour).cast("long").alias("hour"))
        .agg(M.orders().alias("orders"), M.gmv_all().alias("gmv"))
    )
    # At most 24 rows.
    rank = F.row_number().over(Window.orderBy(F.desc("orders"), "hour"))
    return hourly.withColumn("is_peak", rank == 1).orderBy("hour")
