"""Marketplace tables derived from the generic order, supplier and event tables.

The supplied test tables carry no restaurants, ETAs or variants, so other
columns play those roles. Operators only ever see the canonical columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions.labels import lookup
from stallwise.functions.numeric import cents, money
from stallwise.operators.scope import Period

# Roles given to the test tables' own categories.
FUNNEL = {"view": "View", "click": "Click", "signup": "Sign-up", "purchase": "Purchase"}
TRAFFIC_LEVELS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
WEATHER_LEVELS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
HIGH_TRAFFIC, MEDIUM_TRAFFIC = "1-URGENT", "2-HIGH"
RAIN, CLOUDY = "MACHINERY", "BUILDING"
UNIT_COST_SHARE = {0: 0.10, 1: 0.13, 2: 0.45, 3: 1.10}


# Columns of the test tables. A declared schema spares a look into the files.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all orders, for scopes that look up the first and last."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("order_ts"))


def order_facts(
    spark: SparkSession, sf_dir: str, weather: bool = False, within: Period | None = None
) -> DataFrame:
    """One row per order, of one period on request.

    Order lines are aggregated to the order before the join, with a period only
    those of its orders. Where no line column is used Catalyst drops that join,
    the aggregate's key being unique. Customer keys carry no such proof, so that
    join is made only on request.
    """
    raw, raw_lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if within is not None:
        raw = within.filter(raw, "o_orderdate")
        raw_lines = raw_lines.join(raw, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    facts = facts_of(raw, raw_lines)
    if weather:
        segments = users(spark, sf_dir).withColumnRenamed("acquisition_channel", "weather")
        facts = facts.join(segments, "user_id", "left")
    return facts


def facts_of(raw: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """One row per order, from the orders and their lines."""
    lines = (
        raw_lines
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(
            F.min("l_suppkey").alias("restaurant_id"),
            F.count(F.lit(1)).alias("items"),
            F.max("l_quantity").alias("eta_minutes"),
            money(F.sum(cents("l_extendedprice"))).alias("basket_value"),
            money(F.avg(cents("l_discount"))).alias("discount_pct"),
            F.avg(cents("l_tax")).alias("distance_km"),
        )
    )
    cancelled = F.col("o_orderstatus") == "P"
    orders = raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("o_orderpriority").alias("traffic"),
        cancelled.cast("int").alias("cancelled"),
        (~cancelled).cast("int").alias("delivered"),
        F.when(cancelled, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("revenue"),
    )
    return orders.join(lines, "order_id", "left")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("acquisition_channel")
    )


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("restaurant_id"),
            F.col("r_name").alias("cuisine"),
            F.col("s_acctbal").alias("rating"),
        )
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one day form a session."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        "user_id",
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("event_name"),
        "value",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases (delivered) and errors (cancelled) as orders with a time of day."""
    bought, failed = F.col("event_type") == "purchase", F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "error"))
        .select(
            F.col("event_id").alias("order_id"),
            "user_id",
            F.col("ts").alias("order_ts"),
            calendar.hour("ts").alias("hour"),
            failed.cast("int").alias("cancelled"),
            bought.cast("int").alias("delivered"),
            F.when(bought, F.col("value")).otherwise(F.lit(0.0)).alias("revenue"),
        )
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def seen(kind: str):
        return F.max((F.col("event_type") == kind).cast("int"))

    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.min("ts").alias("browse_ts"),
            *(seen(kind).alias(kind) for kind in ("view", "click", "signup", "purchase", "error")),
            money(
                F.sum(F.when(F.col("event_type") == "purchase", cents("value")).otherwise(F.lit(0).cast("long")))
            ).alias("gmv"),
        )
        .withColumn("session_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")))
    )


def experiments(spark: SparkSession, sf_dir: str, by_channel: bool = False) -> DataFrame:
    """One row per session; even users are the control group."""
    sessions = _sessions(spark, sf_dir).select(
        "session_id",
        "user_id",
        F.when(F.col("user_id") % 2 == 0, F.lit("Control")).otherwise(F.lit("Treatment")).alias("variant"),
        F.col("purchase").alias("converted"),
        "gmv",
        (F.col("purchase") * F.col("error")).alias("cancelled"),
    )
    return sessions.join(users(spark, sf_dir), "user_id", "left") if by_channel else sessions


def browse_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the furthest stages reached; each stage needs the one before."""
    menu = F.col("view") == 1
    cart = menu & (F.col("click") == 1)
    checkout = cart & (F.col("signup") == 1)
    return _sessions(spark, sf_dir).select(
        F.concat(F.lit("B"), F.col("session_id")).alias("session_id"),
        "user_id",
        "browse_ts",
        F.col("user_id").alias("restaurant_id"),
        F.lit(None).cast("string").alias("traffic"),
        menu.alias("menu_ok"),
        cart.alias("cart_ok"),
        checkout.alias("checkout_ok"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were sold: list price, quantity as demand, and four levels of unit cost."""
    demand = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(F.sum("l_quantity").alias("base_demand"))
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_retailprice").alias("reference_price"),
        (F.col("p_retailprice") * lookup((F.col("p_partkey") % 4).cast("int"), UNIT_COST_SHARE)).alias("unit_cost"),
    )
    return parts.join(demand, "product_id")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every model input, null where an order has no lines."""
    return order_facts(spark, sf_dir, weather=True).select(
        "*", F.hour("order_ts").alias("hour"), calendar.weekend("order_ts").alias("weekend")
    )
