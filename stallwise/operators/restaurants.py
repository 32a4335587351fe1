"""Restaurant scorecards.

Orders are always aggregated per restaurant before meeting the restaurant table:
the join then sees one row per restaurant, however popular it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.functions.numeric import half_up
from stallwise.operators.ranking import interpolated_quantiles
from stallwise.sources.staging import stage


def restaurant_scorecard_sql(orders: DataFrame, sla: float = M.SLA_MINUTES) -> DataFrame:
    """Scorecard per restaurant id, orders without one included; on-time rate over all orders."""
    return (
        orders.groupBy("restaurant_id")
        .agg(
            M.orders().alias("orders"),
            M.gmv_delivered().alias("gmv"),
            M.delivery_pct().alias("delivery_rate_pct"),
            M.sla_pct_all(sla).alias("sla_45_pct"),
            M.avg_eta().alias("avg_eta_minutes"),
            M.cancellation_pct().alias("cancellation_rate_pct"),
        )
        .orderBy(F.desc("gmv"), "restaurant_id")
    )


def restaurant_performance(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Scorecard with cuisine and rating, rounded, best revenue first."""
    scores = orders.groupBy("restaurant_id").agg(
        F.count("order_id").alias("orders"),
        half_up(M.avg_eta(), 2).alias("avg_eta"),
        half_up(M.cancellation_pct(), 2).alias("cancellation_pct"),
        half_up(M.gmv_all(), 2).alias("revenue"),
    )
    return (
        scores.join(restaurants, "restaurant_id")
        .select(
            "restaurant_id",
            "cuisine",
            half_up("rating", 2).alias("rating"),
            "orders",
            "avg_eta",
            "cancellation_pct",
            "revenue",
        )
        .orderBy(F.desc("revenue"), "restaurant_id")
    )


def top3_restaurants_by_cuisine(orders: DataFrame, restaurants: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best restaurants of each cuisine by GMV."""
    gmv = orders.groupBy("restaurant_id").agg(M.gmv_delivered().alias("gmv"))
    window = Window.partitionBy("cuisine").orderBy(F.desc("gmv"), "restaurant_id")
    # A filter on row_number lets Spark cut each partition to k rows before the shuffle.
    return (
        gmv.join(restaurants.select("restaurant_id", "cuisine"), "restaurant_id")
        .select("cuisine", "restaurant_id", "gmv", F.row_number().over(window).alias("rn"))
        .filter(F.col("rn") <= k)
        .withColumn("rn", F.col("rn").cast("long"))
        .orderBy("cuisine", "rn")
    )


def restaurant_status(orders: DataFrame, restaurants: DataFrame, q: float = 0.9) -> DataFrame:
    """Scorecard with a status flag.

    A restaurant needs attention when its cancellation rate or its mean ETA
    reaches that measure's own quantile among all restaurants. Restaurants
    without a catalogue entry have no cuisine and drop out.
    """
    scores = orders.groupBy("restaurant_id").agg(
        F.count("order_id").alias("orders"),
        M.gmv_all().alias("gmv"),
        M.cancellation_pct().alias("cancellation_rate"),
        M.avg_eta().alias("avg_eta"),
    )
    catalogue = restaurants.filter(F.col("cuisine").isNotNull()).select("restaurant_id", "cuisine", "rating")
    card = stage(scores.join(catalogue, "restaurant_id"), "restaurants")
    limits = interpolated_quantiles(card, ["cancellation_rate", "avg_eta"], q)
    # A measure nobody has a value for has no limit, and a missing value reaches none.
    reached = [F.coalesce(F.col(c) >= F.lit(limit).cast("double"), F.lit(False)) for c, limit in limits.items()]
    return card.select(
        "restaurant_id",
        "cuisine",
        "orders",
        "gmv",
        "cancellation_rate",
        "avg_eta",
        "rating",
        F.when(reduce(Column.__or__, reached), "Needs attention").otherwise("Healthy").alias("status"),
    )


def restaurant_top30(orders: DataFrame, restaurants: DataFrame, n: int = 30, q: float = 0.9) -> DataFrame:
    """The ``n`` restaurants with most GMV, rounded for display."""
    return (
        restaurant_status(orders, restaurants, q)
        .orderBy(F.desc("gmv"), "restaurant_id")
        .limit(n)
        .select(
            "restaurant_id",
            "cuisine",
            "orders",
            half_up("gmv", 0).alias("gmv"),
            half_up("avg_eta", 1).alias("avg_eta"),
            half_up("cancellation_rate", 1).alias("cancellation_rate"),
            "rating",
            "status",
        )
    )
