"""Declared schemas of the marketplace tables.

Types are stated, never inferred: inference would scan every CSV twice and may
change a column's type with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table and column names of the marketplace data model.
SCHEMAS = {
    "users": "user_id bigint, signup_date date, acquisition_channel string",
    "restaurants": "restaurant_id bigint, cuisine string, rating double, prep_capacity bigint",
    "riders": "rider_id bigint, experience_months bigint",
    "orders": (
        "order_id bigint, user_id bigint, restaurant_id bigint, rider_id bigint, order_ts timestamp_ntz, hour int,"
        " weekend int, traffic string, weather string, distance_km double, items int, basket_value double,"
        " listed_price double, discount_pct double, eta_minutes double, cancelled int, delivered int, revenue double"
    ),
    "events": (
        "session_id string, user_id bigint, event_ts timestamp_ntz, event_name string, restaurant_id bigint,"
        " cuisine string, traffic string"
    ),
    "experiments": (
        "experiment_id string, session_id string, variant string, converted int, gmv double, cancelled int"
    ),
}


def conform(frame: DataFrame, name: str) -> DataFrame:
    """Exactly the columns of a table in their declared order and type, null where the frame has none."""
    return frame.select(
        *(
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(SCHEMAS[name])
        )
    )


# Date columns that tables written by day are partitioned by, next to their timestamps.
DAY_COLUMNS = {"order_ts": "order_date", "event_ts": "event_date"}

REQUIRED = ("orders", "restaurants")

# Funnel stages in journey order with their labels.
STAGES = {
    "session_start": "Session start",
    "menu_view": "Menu view",
    "add_to_cart": "Add to cart",
    "checkout": "Checkout",
    "order": "Order",
}

# Ordinals of the two categorical model features.
TRAFFIC_ORDINAL = {"Low": 0, "Medium": 1, "High": 2}
WEATHER_ORDINAL = {"Clear": 0, "Cloudy": 1, "Rain": 2}
