"""Derived order columns and model features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions.labels import lookup, ordinal
from stallwise.functions.numeric import half_up
from stallwise.sources.schemas import TRAFFIC_ORDINAL, WEATHER_ORDINAL
from stallwise.sources.staging import stage

# Surge per condition, delay points per level, travel-time weights, cancellation curve.
SURGE_PEAK, SURGE_TRAFFIC, SURGE_WEATHER = 0.04, 0.07, 0.05
TRAFFIC_POINTS = {"Low": 0, "Medium": 7, "High": 16}
WEATHER_POINTS = {"Clear": 0, "Cloudy": 3, "Rain": 9}
TRAVEL_BASE, TRAVEL_PER_KM, TRAVEL_TRAFFIC, TRAVEL_WEATHER = 8.0, 3.1, 0.45, 0.35
CANCEL_MIDPOINT, CANCEL_SCALE = 48.0, 8.0
MISSING = -1.0  # below the range of every numeric input and category
SPLIT_BITS, BIN_BITS = 60, 16
FEATURES = ("distance_km", "items", "basket_value", "hour", "weekend", "traffic", "weather")


def order_time_features(orders: DataFrame) -> DataFrame:
    """Add hour of day, weekend flag and peak-hour flag."""
    return (
        orders.withColumn("hour", F.hour("order_ts"))
        .withColumn("weekend", calendar.weekend("order_ts"))
        .withColumn("peak", calendar.peak("hour"))
    )


def surge_pricing(orders: DataFrame, high_traffic: str = "High", rain: str = "Rain") -> DataFrame:
    """Add surge factor, listed price and revenue, money to the cent. Needs the peak flag."""

    def when(condition: Column, share: float) -> Column:
        return F.when(condition, F.lit(share)).otherwise(F.lit(0.0))

    surge = (
        F.lit(1.0)
        + when(F.col("peak") == 1, SURGE_PEAK)
        + when(F.col("traffic") == high_traffic, SURGE_TRAFFIC)
        + when(F.col("weather") == rain, SURGE_WEATHER)
    )
    price = F.col("basket_value") * F.col("surge")
    paid = half_up(price * (F.lit(1.0) - F.col("discount_pct")), 2)
    return (
        orders.withColumn("surge", surge)
        .withColumn("listed_price", half_up(price, 2))
        .withColumn("revenue", F.when(F.col("delivered") == 1, paid).otherwise(F.lit(0.0)))
    )


def eta_penalties(
    orders: DataFrame,
    traffic_points: Mapping[str, int] = TRAFFIC_POINTS,
    weather_points: Mapping[str, int] = WEATHER_POINTS,
) -> DataFrame:
    """Add delay points, expected travel minutes and the cancellation curve at the order's ETA."""
    return (
        orders.withColumn("traffic_penalty", lookup("traffic", traffic_points, 0))
        .withColumn("weather_penalty", lookup("weather", weather_points, 0))
        .withColumn(
            "travel",
            F.lit(TRAVEL_BASE)
            + F.lit(TRAVEL_PER_KM) * F.col("distance_km")
            + F.lit(TRAVEL_TRAFFIC) * F.col("traffic_penalty")
            + F.lit(TRAVEL_WEATHER) * F.col("weather_penalty"),
        )
        .withColumn(
            "cancel_prob",
            F.lit(1.0)
            / (F.lit(1.0) + F.exp(-(F.col("eta_minutes") - F.lit(CANCEL_MIDPOINT)) / F.lit(CANCEL_SCALE))),
        )
    )


def model_features(
    orders: DataFrame,
    traffic: Mapping[str, int] = TRAFFIC_ORDINAL,
    weather: Mapping[str, int] = WEATHER_ORDINAL,
    keep: tuple[str, ...] = ("order_id", "eta_minutes", "cancelled"),
    strict: bool = True,
) -> DataFrame:
    """The seven numeric model inputs of every order, next to the key and labels.

    A missing numeric input becomes ``MISSING``, a value of its own to a tree. An
    unknown category fails the job, or becomes ``MISSING`` unless ``strict``.
    """

    def number(column: str) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(MISSING)).alias(column)

    def category(column: str, levels: Mapping[str, int]) -> Column:
        value = ordinal(column, levels) if strict else lookup(column, levels, MISSING)
        return value.cast("double").alias(column)

    return orders.select(
        *(c for c in keep if c in orders.columns),
        *(number(c) for c in FEATURES if c not in ("traffic", "weather")),
        category("traffic", traffic),
        category("weather", weather),
    )


def split_key(key: str, seed: int) -> Column:
    """Order of a row in a random split: 60 bits of a digest, the same on every engine and run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def train_test_split(
    rows: DataFrame, key: str = "order_id", test_share: float = 0.2, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add ``is_test``: the rows with the smallest digests, ``test_share`` of them exactly.

    Membership hangs on the key alone, so retries and repartitioning cannot move a
    row. With ``stratify`` every class gives its share, the null class too.

    The digest of the last test row is found per class without gathering the class:
    counts by the digest's leading bits say which bin holds it, and only that bin,
    one in ``2 ** BIN_BITS``, is put in order. These digests, one a class, are staged:
    each use of the result scans the rows once and looks for none of them again.
    """
    group = F.lit(0) if stratify is None else F.col(stratify)
    staged = rows.withColumn("split_key", split_key(key, seed)).withColumn("split_group", group)
    staged = stage(staged.withColumn("split_bin", F.shiftright("split_key", SPLIT_BITS - BIN_BITS)), "split")
    bins = staged.groupBy("split_group", "split_bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("split_group").orderBy("split_bin").rowsBetween(W.unboundedPreceding, 0)
    share = F.sum("n").over(W.partitionBy("split_group")) * F.lit(test_share)
    wanted = F.ceil(share) if stratify is None else F.bround(share)
    bins = bins.withColumns({"wanted": wanted.cast("long"), "upto": F.sum("n").over(ahead)})
    last = bins.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).select(
        F.col("split_group").alias("g"), F.col("split_bin").alias("b"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("nth")
    )
    inside = staged.join(last, staged["split_group"].eqNullSafe(last["g"]) & (staged["split_bin"] == last["b"]))
    turn = F.row_number().over(W.partitionBy("split_group").orderBy("split_key"))
    cuts = inside.withColumn("turn", turn).where(F.col("turn") == F.col("nth"))
    cuts = stage(cuts.select(F.col("split_group").alias("cut_group"), F.col("split_key").alias("cut")), "cuts")
    marked = staged.join(cuts, staged["split_group"].eqNullSafe(cuts["cut_group"]), "left")
    is_test = F.coalesce(F.col("split_key") <= F.col("cut"), F.lit(False))
    return marked.select(*(staged[c] for c in rows.columns), is_test.alias("is_test"))
