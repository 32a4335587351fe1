"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds a request must meet, as (name, SQL condition) with nulls failing.
ORDER_FEATURE_RULES = {
    "distance_km": "distance_km > 0 AND distance_km <= 30",
    "items": "items BETWEEN 1 AND 20",
    "basket_value": "basket_value > 0",
    "hour": "hour BETWEEN 0 AND 23",
    "weekend": "weekend BETWEEN 0 AND 1",
}
PRICING_RULES = {
    "reference_price": "reference_price > 0",
    "base_demand": "base_demand > 0",
    "unit_cost": "unit_cost > 0",
}
MARGIN_RULE = {"min_margin": "min_margin >= 0 AND min_margin < 1"}


def _count_checks(frame: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row per check, all counted in one pass."""
    names = list(checks)
    totals = frame.agg(
        F.count(F.lit(1)).alias("rows"), *(F.count_if(checks[name]).alias(f"v{i}") for i, name in enumerate(names))
    )
    return totals.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("check"), F.col("rows"), F.col(f"v{i}").alias("violations"))
                    for i, name in enumerate(names)
                )
            )
        )
    )


def invariant_violations(
    orders: DataFrame, experiments: DataFrame | None = None, restaurants: DataFrame | None = None
) -> DataFrame:
    """Rows breaking what the metrics rely on."""
    delivered, cancelled = F.col("delivered"), F.col("cancelled")
    result = _count_checks(
        orders,
        {
            "delivered_is_not_cancelled": delivered + cancelled != 1,
            "revenue_only_when_delivered": (delivered != 1) & (F.col("revenue") != 0),
        },
    )
    if experiments is not None:
        result = result.unionByName(
            _count_checks(experiments, {"cancelled_only_when_converted": (cancelled == 1) & (F.col("converted") != 1)})
        )
    if restaurants is not None:
        per_id = restaurants.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n"))
        result = result.unionByName(
            per_id.agg(
                F.lit("one_row_per_restaurant").alias("check"),
                F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("violations"),
            )
        )
    return result


def violations(frame: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks. A null breaks its rule."""
    broken = [
        F.when(~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False)), F.lit(name))
        for name, rule in rules.items()
    ]
    return frame.withColumn("violations", F.array_compact(F.array(*broken)))


def validate_order_features(orders: DataFrame, traffic: Mapping[str, int], weather: Mapping[str, int]) -> DataFrame:
    """Model inputs against their bounds and known categories."""
    known = {"traffic": F.col("traffic").isin(*traffic), "weather": F.col("weather").isin(*weather)}
    return violations(orders, {**ORDER_FEATURE_RULES, **known})


def validate_pricing_inputs(products: DataFrame) -> DataFrame:
    """Pricing inputs against their bounds; the margin is checked where it is a column."""
    return violations(products, {**PRICING_RULES, **(MARGIN_RULE if "min_margin" in products.columns else {})})


def grain_check(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def join_fanout(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` before and after an inner join on ``key``.

    Both sides are counted per key first, so the joined rows are never made.
    """
    per_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    per_right = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    zero = F.lit(0).cast("long")
    return (
        per_left.join(per_right, key, "left")
        .agg(
            F.coalesce(F.sum("l"), zero).alias("rows_before"),
            F.coalesce(F.sum(F.col("l") * F.coalesce("r", zero)), zero).alias("rows_after"),
            F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("l"))), zero).alias("unmatched"),
        )
        .withColumn("fans_out", F.col("rows_after") > F.col("rows_before") - F.col("unmatched"))
    )
