"""Questions asked of the metrics: who contributes, what changed, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions import measures as M
from stallwise.functions.numeric import money, ratio
from stallwise.functions.totals import grand_totals
from stallwise.operators.scope import Scope, period_totals


def top_n_restaurants(orders: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` restaurants with most GMV; orders without a restaurant count as one, last on ties."""
    totals = orders.groupBy("restaurant_id").agg(M.gmv_delivered().alias("gmv"))
    return totals.orderBy(F.desc("gmv"), F.col("restaurant_id").asc_nulls_last()).limit(n)


def wow_growth(orders: DataFrame) -> DataFrame:
    """Orders and GMV per week with their change against the week before."""
    weekly = (
        orders.filter(F.col("order_ts").isNotNull())
        .groupBy(calendar.period_start("order_ts", "week").alias("week"))
        .agg(M.orders().alias("orders"), M.gmv_delivered().alias("gmv"))
    )
    # One row per calendar week. A missing week is not the week before.
    order = Window.orderBy("week")
    adjacent = F.datediff("week", F.lag("week").over(order)) == 7

    def growth(c: str):
        before = F.when(adjacent, F.lag(c).over(order))
        return ((ratio(F.col(c), before) - F.lit(1.0)) * F.lit(100.0)).alias(f"{c}_wow_pct")

    return weekly.select("*", growth("orders"), growth("gmv")).orderBy("week")


def gmv_contribution(orders: DataFrame, column: str) -> DataFrame:
    """GMV per segment and its share of the total."""
    segments = orders.groupBy(column).agg(M.delivered_cents().alias("cents"))
    total = grand_totals(segments, "cents")
    return segments.select(
        column,
        money(F.col("cents")).alias("gmv"),
        (ratio(F.col("cents"), total.getField("cents")) * F.lit(100.0)).alias("share_pct"),
    ).orderBy(F.desc("gmv"), column)


def rate_change_contribution(orders: DataFrame, column: str, scope: Scope = Scope("last_90_days")) -> DataFrame:
    """Which segments moved the cancellation rate between a period and the one before.

    A segment contributes its cancelled orders over all orders, now minus before;
    contributions add up to the overall change in percentage points. Each is
    split into a mix part (its share of orders moved) and a rate part (its own
    rate moved).
    """
    current = scope.bounds(orders)
    rows = scope.apply(orders, current.with_previous()).withColumn("now", current.contains("order_ts"))
    cancelled = F.col("cancelled") == 1
    counts = rows.groupBy(column).agg(
        F.count_if(F.col("now")).alias("n1"),
        F.count_if(~F.col("now")).alias("n0"),
        F.count_if(F.col("now") & cancelled).alias("c1"),
        F.count_if(~F.col("now") & cancelled).alias("c0"),
    )
    total = grand_totals(counts, "n1", "n0", "c1", "c0")
    n1, n0 = total.getField("n1"), total.getField("n0")
    segments = counts.select(
        "*",
        ratio(F.col("n1"), n1).alias("w1"),
        ratio(F.col("n0"), n0).alias("w0"),
        (ratio(F.col("c1"), n1) * F.lit(100.0) - ratio(F.col("c0"), n0) * F.lit(100.0)).alias("contribution_pp"),
    )
    rate0 = F.coalesce(ratio(F.col("c0"), F.col("n0")), ratio(F.col("c1"), F.col("n1")))
    mix = (F.col("w1") - F.col("w0")) * rate0 * F.lit(100.0)
    return segments.select(
        column,
        F.col("n1").alias("orders"),
        F.col("n0").alias("prev_orders"),
        F.col("c1").alias("cancelled_orders"),
        F.col("c0").alias("prev_cancelled_orders"),
        "contribution_pp",
        mix.alias("mix_pp"),
        (F.col("contribution_pp") - mix).alias("rate_pp"),
    )


def gmv_decomposition(orders: DataFrame, restaurants: DataFrame | None = None, scope: Scope = Scope()) -> DataFrame:
    """GMV change between periods as a volume and an AOV effect, which add up to it.

    Volume moves at the previous AOV, AOV at the current volume of delivered orders.
    """
    totals = period_totals(orders, restaurants, scope, M.SLA_MINUTES)
    gmv, previous = money(F.col("cents")), money(F.col("prev_cents"))
    previous_aov = F.coalesce(ratio(previous, F.col("prev_delivered")), F.lit(0.0))
    volume = (F.col("delivered") - F.col("prev_delivered")) * previous_aov
    return totals.select(
        gmv.alias("gmv"),
        previous.alias("prev_gmv"),
        (gmv - previous).alias("gmv_change"),
        volume.alias("volume_effect"),
        (gmv - previous - volume).alias("aov_effect"),
    )
