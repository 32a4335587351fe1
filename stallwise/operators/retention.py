"""Cohort retention.

Orders are reduced to one row per user holding the set of periods with a
completed order, as many as there are periods at most. One shuffle by user does
it, a hot user is merged before it, the cohort is the least of the set, and
counting users needs no DISTINCT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions import measures as M
from stallwise.functions.numeric import ratio


def _active_periods(orders: DataFrame, grain: str) -> DataFrame:
    """(user_id, periods): first dates of the periods in which a user had a completed order."""
    return (
        orders.filter(M.delivered() & F.col("user_id").isNotNull() & F.col("order_ts").isNotNull())
        .groupBy("user_id")
        .agg(F.collect_set(calendar.period_date("order_ts", grain)).alias("periods"))
    )


def _cells(users: DataFrame, *keep: str) -> DataFrame:
    """One row per user and active period, next to the user's first one."""
    return users.select(*keep, F.array_min("periods").alias("cohort"), F.explode("periods").alias("active"))


def cohort_retention(orders: DataFrame, grain: str = "month", users_as: str = "active_users") -> DataFrame:
    """Users active so many periods after the one of their first completed order."""
    return (
        _cells(_active_periods(orders, grain))
        .groupBy(
            F.col("cohort").cast("timestamp_ntz").alias(f"cohort_{grain}"),
            calendar.periods_between(F.col("cohort"), F.col("active"), grain).alias(f"{grain}_number"),
        )
        .agg(F.count(F.lit(1)).alias(users_as))
        .orderBy(f"cohort_{grain}", f"{grain}_number")
    )


def cohort_activity(orders: DataFrame) -> DataFrame:
    """Users by cohort month and order month as labels.

    The cohort is the first completed order among the rows given: inside a
    filtered period that need not be the customer's first ever.
    """
    return (
        _cells(_active_periods(orders, "month"))
        .groupBy(calendar.month_label("cohort").alias("cohort"), calendar.month_label("active").alias("order_month"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("cohort", "order_month")
    )


def retention_by_segment(orders: DataFrame, users: DataFrame, segment: str, grain: str = "month") -> DataFrame:
    """Cohort retention per user segment, with the cohort's size and the share still active.

    Users meet their attribute after the reduction, as one row each.
    """
    active = _active_periods(orders, grain)
    number = calendar.periods_between(F.col("cohort"), F.col("active"), grain)
    labelled = active.join(users.select("user_id", F.col(segment).alias("segment")), "user_id", "left")
    counts = (
        _cells(labelled, "segment")
        .groupBy(
            "segment",
            F.col("cohort").cast("timestamp_ntz").alias(f"cohort_{grain}"),
            number.alias(f"{grain}_number"),
        )
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    # Every user is active in the cohort's own period, so that cell is its size.
    size = F.max(F.when(F.col(f"{grain}_number") == 0, F.col("active_users"))).over(
        Window.partitionBy("segment", f"cohort_{grain}")
    )
    return counts.withColumn("cohort_size", size).withColumn(
        "retention_pct", ratio(F.col("active_users"), F.col("cohort_size")) * F.lit(100.0)
    )
