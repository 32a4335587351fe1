from __future__ import annotations

from datetime import date, datetime

import pytest

from stallwise.operators import funnel, journeys
from stallwise.operators.scope import Scope
from stallwise.sources import sinks
from stallwise.sources.schemas import SCHEMAS, STAGES


@pytest.fixture
def make_events(spark):
    def make(counts: dict[str, int]):
        at = datetime(2025, 1, 1)
        rows = [
            (f"S{i}", i, at, stage, 1, "Thai", "Low") for stage, n in counts.items() for i in range(n) for _ in (0, 1)
        ]
        return spark.createDataFrame(rows, SCHEMAS["events"])

    return make


def test_adjacent_stage_conversion(make_events):
    events = make_events(dict(zip(STAGES, (100, 80, 44, 30, 24))))
    rows = funnel.event_funnel(events).collect()
    assert [r.sessions for r in rows] == [100, 80, 44, 30, 24]
    assert [r.conversion for r in rows] == pytest.approx([100, 80, 55, 100 * 30 / 44, 80])
    assert [r.overall_conversion for r in rows] == pytest.approx([100, 80, 44, 30, 24])
    assert [r.drop_off for r in rows] == pytest.approx([0, 20, 45, 100 - 100 * 30 / 44, 20])
    assert funnel.largest_leak(funnel.event_funnel(events)).first().stage == "add_to_cart"
    assert funnel.label_stages(funnel.event_funnel(events)).first().stage == "Session start"


def test_missing_stages(make_events):
    rows = funnel.event_funnel(make_events({"checkout": 3, "menu_view": 6, "other": 9})).collect()
    assert [r.sessions for r in rows] == [0, 6, 0, 3, 0]
    # some of none, none of some, some of none, none of some
    assert [r.conversion for r in rows] == [100.0, None, 0.0, None, 0.0]
    assert rows[0].overall_conversion is None


def test_no_events(make_events):
    rows = funnel.event_funnel(make_events({"menu_view": 1}).limit(0)).collect()
    assert [(r.sessions, r.conversion) for r in rows] == [(0, 100.0)] * 5


def test_open_funnel_may_exceed_the_stage_before(make_events):
    rows = funnel.event_funnel(make_events({"session_start": 2, "menu_view": 3})).collect()
    assert rows[1].conversion == 150.0


def test_journey_across_midnight_loses_stages_at_the_edge(make_orders, make_restaurants):
    orders = make_orders({"order_ts": datetime(2025, 1, 2, 0, 3), "order_id": 7})
    events = journeys.order_journey_events(orders, make_restaurants((1, "Thai", 4.0)))
    day = Scope("custom", date(2025, 1, 2), date(2025, 1, 2))
    rows = funnel.event_funnel(day.apply(events, day.bounds(events), ts="event_ts")).collect()
    assert [r.sessions for r in rows] == [0, 0, 0, 1, 1]


def test_order_journey(make_orders, make_restaurants):
    events = journeys.order_journey_events(
        make_orders({"order_id": 7, "restaurant_id": 9}), make_restaurants((1, "Thai", 4.0))
    ).orderBy("event_ts")
    rows = events.collect()
    assert [r.event_name for r in rows] == list(STAGES)
    assert [12 * 60 - (r.event_ts.hour * 60 + r.event_ts.minute) for r in rows] == [8, 6, 4, 2, 0]
    assert {(r.session_id, r.cuisine) for r in rows} == {("S0000007", None)}


def test_browse_journey_stops_at_the_furthest_stage(spark, make_restaurants):
    at = datetime(2025, 1, 1)
    sessions = spark.createDataFrame(
        [("B1", 1, at, 1, "Low", True, True, False), ("B2", 2, at, 1, "Low", False, False, False)],
        "session_id string, user_id bigint, browse_ts timestamp_ntz, restaurant_id bigint, traffic string,"
        " menu_ok boolean, cart_ok boolean, checkout_ok boolean",
    )
    events = journeys.browse_session_events(sessions, make_restaurants((1, "Thai", 4.0)))
    found = sorted((r.session_id, r.event_ts.minute, r.event_name) for r in events.collect())
    assert found == [
        ("B1", 0, "session_start"),
        ("B1", 3, "menu_view"),
        ("B1", 6, "add_to_cart"),
        ("B2", 0, "session_start"),
    ]


def test_events_are_written_by_day_in_order(spark, make_events, tmp_path):
    events = make_events(dict.fromkeys(STAGES, 20))
    sinks.write_events(events, str(tmp_path / "events"))
    assert [p.name for p in tmp_path.glob("events/event_date=*")] == ["event_date=2025-01-01"]
    back = spark.read.parquet(str(tmp_path / "events"))
    assert back.count() == events.count()


def test_hot_restaurant_is_split_when_the_catalogue_is_too_big_to_broadcast(spark, make_restaurants):
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        orders = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("order_id"),
            # One restaurant has a third of all orders.
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500).cast("bigint").alias("restaurant_id"),
        )
        places = spark.range(500).select(F.col("id").alias("restaurant_id"), F.lit("Thai").alias("cuisine"))
        joined = journeys.with_cuisine(orders, places)
        assert joined.agg(F.count("cuisine")).first()[0] == 60_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
