"""Event journeys built from orders and browse sessions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.calendar import plus_minutes
from stallwise.functions.labels import padded_id
from stallwise.operators import timeline
from stallwise.operators.scope import Period
from stallwise.operators.spread import spread_join

# Minutes of each stage relative to the order, and to the start of a browse session.
ORDER_OFFSETS = {"session_start": -8, "menu_view": -6, "add_to_cart": -4, "checkout": -2, "order": 0}
BROWSE_OFFSETS = {"session_start": 0, "menu_view": 3, "add_to_cart": 6, "checkout": 9}
BROWSE_FLAGS = {"menu_view": "menu_ok", "add_to_cart": "cart_ok", "checkout": "checkout_ok"}

EVENT_COLUMNS = ("session_id", "user_id", "event_ts", "event_name", "restaurant_id", "cuisine", "traffic")


def with_cuisine(facts: DataFrame, restaurants: DataFrame, spread: bool = False) -> DataFrame:
    """Facts with their restaurant's cuisine, null where it has none.

    The join runs before rows multiply. Spark broadcasts the restaurants when their size allows it;
    otherwise AQE splits the partition of a hot restaurant, or with ``spread`` the plan does,
    after a look at which are hot.
    """
    places = restaurants.select("restaurant_id", "cuisine")
    if spread:
        return spread_join(facts, places, "restaurant_id")
    return facts.join(places, "restaurant_id", "left")


def _leading_to(period: Period | None, facts: DataFrame, ts: str, offsets: Mapping[str, int]) -> DataFrame:
    """Facts that may have events in the period, cut before they are expanded so that the scan skips the others."""
    if period is None or period.first is None:
        return facts if period is None else period.filter(facts, ts)
    start = plus_minutes(F.lit(period.first.isoformat()).cast("timestamp_ntz"), F.lit(-max(offsets.values())))
    after = (period.last + timedelta(days=1)).isoformat()
    end = plus_minutes(F.lit(after).cast("timestamp_ntz"), F.lit(-min(offsets.values())))
    return facts.filter((F.col(ts) >= start) & (F.col(ts) < end))


def order_journey_events(
    orders: DataFrame,
    restaurants: DataFrame,
    offsets: Mapping[str, int] = ORDER_OFFSETS,
    period: Period | None = None,
) -> DataFrame:
    """The events that led to each order: one row per stage, minutes before the order.

    With a period only the orders that may have an event in it are expanded.
    """
    orders = _leading_to(period, orders, "order_ts", offsets)
    steps = F.array(
        *(F.struct(F.lit(name).alias("event_name"), F.lit(m).alias("minutes")) for name, m in offsets.items())
    )
    return (
        with_cuisine(orders, restaurants)
        .select("*", F.inline(steps))
        .withColumn("session_id", padded_id("S", "order_id"))
        .withColumn("event_ts", plus_minutes("order_ts", F.col("minutes")))
        .select(*EVENT_COLUMNS)
    )


def browse_session_events(
    sessions: DataFrame,
    restaurants: DataFrame,
    offsets: Mapping[str, int] = BROWSE_OFFSETS,
    period: Period | None = None,
) -> DataFrame:
    """The events of sessions without an order, up to the furthest stage reached."""
    sessions = _leading_to(period, sessions, "browse_ts", offsets)
    steps = F.array(
        *(
            F.struct(
                F.lit(name).alias("event_name"),
                F.lit(m).alias("minutes"),
                (F.col(BROWSE_FLAGS[name]) if name in BROWSE_FLAGS else F.lit(True)).alias("reached"),
            )
            for name, m in offsets.items()
        )
    )
    return (
        with_cuisine(sessions, restaurants)
        .select("*", F.inline(steps))
        .filter("reached")
        .withColumn("event_ts", plus_minutes("browse_ts", F.col("minutes")))
        .select(*EVENT_COLUMNS)
    )


def journey_timeline(
    orders: DataFrame | None,
    browsing: DataFrame | None,
    restaurants: DataFrame,
    in_order: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """The events of orders and browse sessions in (event_ts, session_id) order, shuffled before they multiply.

    With ``in_order`` off, partitions follow that order but are not sorted inside. One of the tables may be None.
    """
    kinds = (ORDER_OFFSETS, BROWSE_OFFSETS)
    reached = [F.col(BROWSE_FLAGS[name]) if name in BROWSE_FLAGS else None for name in BROWSE_OFFSETS]
    keep = ("user_id", "restaurant_id", "cuisine", "traffic")
    rows, times = [], []
    for into, columns, prepare in ((rows, keep, lambda f: with_cuisine(f, restaurants)), (times, (), lambda f: f)):
        if orders is not None:
            name = padded_id("S", "order_id")
            into.append(timeline.sessions(prepare(orders), name, "order_ts", 0, [None] * len(ORDER_OFFSETS), columns))
        if browsing is not None:
            into.append(timeline.sessions(prepare(browsing), F.col("session_id"), "browse_ts", 1, reached, columns))
    arranged = timeline.ordered_events if in_order else timeline.placed_events
    both = reduce(DataFrame.unionByName, rows)
    return arranged(both, kinds, times=reduce(DataFrame.unionByName, times), ranges=ranges).select(*EVENT_COLUMNS)


def journey_union(order_events: DataFrame, browse_events: DataFrame) -> DataFrame:
    """Both kinds of sessions as one event table."""
    return order_events.unionByName(browse_events)
