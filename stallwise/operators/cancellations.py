"""Cancellation breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.functions.numeric import ratio
from stallwise.functions.totals import grand_totals
from stallwise.operators.kpis import first_max


def cancellation_by(orders: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Cancellation rate and volume per value of a column; rows without one are a group only if ``keep_null``."""
    rows = orders if keep_null else orders.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(M.cancellation_pct().alias("cancellation_rate"), F.count(F.lit(1)).alias("orders"))


def worst_cancellation_segment(orders: DataFrame, column: str) -> DataFrame:
    """The segment with the highest rate, the first in order on ties."""
    best = first_max(F.col("cancellation_rate"), F.col(column), F.struct(column, "cancellation_rate", "orders"))
    return cancellation_by(orders, column).agg(best.alias("s")).filter(F.col("s").isNotNull()).select("s.*")


def severity_impact_rank(orders: DataFrame, column: str) -> DataFrame:
    """Segments by the cancellations they cause (rate × volume) and their share of all of them.

    Orders without a segment are one, so the shares add up.
    """
    segments = orders.groupBy(column).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("cancelled").alias("cancelled_orders")
    )
    total = grand_totals(segments, "orders", "cancelled_orders")
    return segments.select(
        column,
        "orders",
        (ratio(F.col("cancelled_orders"), F.col("orders")) * F.lit(100.0)).alias("cancellation_rate"),
        "cancelled_orders",
        (ratio(F.col("cancelled_orders"), total.getField("cancelled_orders")) * F.lit(100.0)).alias(
            "share_of_cancellations_pct"
        ),
    ).orderBy(F.desc("cancelled_orders"), column)
