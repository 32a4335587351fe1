"""Customer segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions import measures as M
from stallwise.functions.numeric import cents, money
from stallwise.operators.ranking import values_at, with_tiles
from stallwise.sources.staging import stage


def rfm_segments(orders: DataFrame, tiles: int = 5) -> DataFrame:
    """Recency, frequency and monetary tiles per customer, and the segment they imply.

    Customers with equal values are told apart by user id, so scores do not
    change from run to run. Orders without a user count as one customer, the
    last in order.
    """
    last = F.lit((1 << 63) - 1)
    base = (
        orders.filter(M.delivered())
        .groupBy("user_id")
        .agg(
            F.max("order_ts").cast("timestamp_ntz").alias("last_order"),
            F.count(F.lit(1)).alias("frequency"),
            F.coalesce(F.sum(cents("revenue")), F.lit(0).cast("long")).alias("monetary_cents"),
        )
        .withColumn("recency", F.coalesce(calendar.micros("last_order"), last))
        .withColumn("key", F.coalesce(F.col("user_id").cast("long"), last))
    )
    scored = with_tiles(
        stage(base, "rfm"),
        "key",
        {"recency_score": "recency", "frequency_score": "frequency", "monetary_score": "monetary_cents"},
        tiles,
    )
    f, m = F.col("frequency_score"), F.col("monetary_score")
    segment = (
        F.when((f >= 4) & (m >= 4), "Champions")
        .when((f >= 3) & (m >= 3), "Loyal")
        .when(F.col("recency_score") <= 2, "At Risk")
        .otherwise("Standard")
    )
    return scored.select(
        "user_id",
        "last_order",
        "frequency",
        money(F.col("monetary_cents")).alias("monetary"),
        "recency_score",
        "frequency_score",
        "monetary_score",
        segment.alias("segment"),
    )


def customer_segments(orders: DataFrame) -> DataFrame:
    """Completed orders, revenue and behavioural segment per customer.

    High value means at least the median revenue of all customers, one-timers included.
    """
    base = (
        orders.filter(M.delivered() & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum(cents("revenue")).alias("revenue_cents"),
            F.max("order_ts").alias("last_order"),
        )
    )
    customers = stage(base, "customers")
    # The median lies between the two middle ranks; doubling keeps it whole cents.
    middle = values_at(customers, "revenue_cents", lambda rows: [(rows + 1) // 2, rows // 2 + 1] if rows else [])
    n = F.col("orders")
    segment = (
        F.when((n >= 4) & (F.col("revenue_cents") * 2 >= F.lit(sum(middle))), "Loyal high-value")
        .when(n.between(2, 3), "Repeat")
        .when(n == 1, "New / one-time")
        .otherwise("Occasional")
    )
    return customers.select(
        "user_id", "orders", money(F.col("revenue_cents")).alias("revenue"), "last_order", segment.alias("segment")
    )


def behavioral_segments(orders: DataFrame) -> DataFrame:
    """Customers per behavioural segment, largest first."""
    return (
        customer_segments(orders)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "segment")
    )


def customers_with_orders(orders: DataFrame, at_least: int = 3) -> DataFrame:
    """Customers with at least so many orders."""
    return (
        orders.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count("order_id").alias("orders"))
        .filter(F.col("orders") >= at_least)
    )
