from __future__ import annotations

from datetime import date, datetime

import pytest

from stallwise.operators import diagnostics, scope
from stallwise.operators.scope import Period, Scope
from stallwise.sources import sinks

JAN = Scope("custom", date(2025, 1, 1), date(2025, 1, 31))


def test_preset_is_anchored_on_the_data_and_clamped(make_orders):
    orders = make_orders({"order_ts": datetime(2025, 1, 10)}, {"order_ts": datetime(2025, 1, 20, 23, 59)})
    assert Scope("last_30_days").bounds(orders) == Period(date(2025, 1, 10), date(2025, 1, 20))
    orders = make_orders({"order_ts": datetime(2024, 1, 1)}, {"order_ts": datetime(2025, 1, 30)})
    assert Scope("last_30_days").bounds(orders) == Period(date(2025, 1, 1), date(2025, 1, 30))


def test_previous_period_has_the_same_length():
    assert Period(date(2025, 1, 1), date(2025, 1, 30)).previous() == Period(date(2024, 12, 2), date(2024, 12, 31))
    assert Period(date(2025, 1, 5), date(2025, 1, 5)).previous() == Period(date(2025, 1, 4), date(2025, 1, 4))
    assert Period().previous().empty


def test_both_ends_are_included(make_orders):
    stamps = [
        datetime(2024, 12, 31, 23, 59, 59),
        datetime(2025, 1, 1),
        datetime(2025, 1, 31, 23, 59, 59, 999999),
        datetime(2025, 2, 1),
    ]
    kept = JAN.filter(make_orders(*({"order_ts": t} for t in stamps)))
    assert sorted(r.order_id for r in kept.collect()) == [2, 3]


def test_pinned_scope_keeps_its_dates(make_orders):
    orders = make_orders({"order_ts": datetime(2025, 1, 10)}, {"order_ts": datetime(2025, 1, 20)})
    pinned = Scope("last_30_days", traffic="Low").pinned(orders)
    assert pinned == Scope("custom", date(2025, 1, 10), date(2025, 1, 20), traffic="Low")
    assert Scope().pinned(orders) == Scope("custom", date(2025, 1, 10), date(2025, 1, 20))
    assert Scope("last_30_days").pinned(orders.limit(0)).bounds(orders.limit(0)).empty


def test_bad_scopes():
    with pytest.raises(ValueError):
        Scope("last_year")
    with pytest.raises(ValueError):
        Scope("custom")


def test_dashboard_sla_is_over_delivered(make_orders):
    row = scope.period_snapshot(
        make_orders(
            {"eta_minutes": 35.0, "revenue": 300.0},
            {"eta_minutes": 60.0, "cancelled": 1},
            {"eta_minutes": 42.0, "revenue": 500.0},
            {"eta_minutes": 51.0, "revenue": 400.0},
        )
    ).first()
    assert (row.cancel, row.delivery) == (25.0, 75.0)
    assert row.sla == pytest.approx(200 / 3)
    assert (row.gmv, row.aov) == (1200.0, 400.0)


def test_nothing_delivered(make_orders):
    row = scope.period_snapshot(make_orders({"cancelled": 1})).first()
    assert (row.orders, row.gmv, row.aov, row.sla, row.cancel) == (1, 0.0, 0.0, 0.0, 100.0)


def test_empty_period(make_orders):
    later = Scope("custom", date(2030, 1, 1), date(2030, 1, 2))
    row = scope.period_over_period(make_orders({}), scope=later).first()
    assert (row.orders, row.gmv, row.aov, row.sla) == (0, 0.0, 0.0, 0.0)
    assert row.cancel is None and row.prev_orders is None and row.gmv_delta_pct is None
    empty = make_orders({}).limit(0)
    assert scope.period_snapshot(empty, scope=Scope("last_30_days")).first().orders == 0


def test_deltas(make_orders):
    orders = make_orders(
        *({"order_ts": datetime(2025, 1, 1), "cancelled": int(i < 64)} for i in range(100)),
        *({"order_ts": datetime(2025, 1, 2), "cancelled": int(i < 58), "revenue": 200.0} for i in range(100)),
    )
    row = scope.period_over_period(orders, scope=Scope("custom", date(2025, 1, 2), date(2025, 1, 2))).first()
    assert row.cancel_delta_pp == pytest.approx(-6.0)
    assert row.orders_delta_pct == 0.0
    assert row.aov_delta_pct == pytest.approx(100.0)


def test_full_period_has_no_previous_one(make_orders):
    row = scope.period_over_period(make_orders({})).first()
    assert row.orders == 1 and row.prev_orders is None and row.cancel_delta_pp is None


def test_zero_previous_value_has_no_relative_change(make_orders):
    orders = make_orders({"order_ts": datetime(2025, 1, 1), "cancelled": 1}, {"order_ts": datetime(2025, 1, 2)})
    row = scope.period_over_period(orders, scope=Scope("custom", date(2025, 1, 2), date(2025, 1, 2))).first()
    assert row.prev_orders == 1 and row.gmv_delta_pct is None and row.cancel_delta_pp == -100.0


def test_cuisine_and_traffic(make_orders, make_restaurants):
    orders = make_orders(
        {"restaurant_id": 1},
        {"restaurant_id": 1, "traffic": "High"},
        {"restaurant_id": 2},
        {"restaurant_id": 3},
        {"restaurant_id": None},
    )
    places = make_restaurants((1, "Pizza", 4.0), (2, "Pizza", 4.0), (3, "Thai", 4.0))
    only = Scope(cuisine="Pizza", traffic="Low")
    assert sorted(r.order_id for r in only.filter(orders, places).collect()) == [1, 3]
    assert scope.period_snapshot(orders, places, only).first().orders == 2
    with pytest.raises(ValueError):
        only.filter(orders)


def test_cuisine_totals_join_aggregates_not_orders(make_orders, make_restaurants):
    frame = scope.period_snapshot(make_orders({}), make_restaurants((1, "Pizza", 4.0)), Scope(cuisine="Pizza"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftSemi")
    assert "Aggregate [restaurant_id" in plan[join:]


def test_period_filter_reaches_the_scan(spark, make_orders, tmp_path):
    make_orders({}).write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    plan = Scope("last_30_days").filter(orders)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(order_ts" in plan and "LessThan(order_ts" in plan


def test_days_out_of_the_period_are_not_opened(spark, make_orders, tmp_path):
    stamps = [datetime(2025, m, 5, 10) for m in range(1, 7)]
    sinks.write_orders(make_orders(*({"order_ts": t} for t in stamps)), str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    assert Scope("last_90_days").bounds(orders) == Period(date(2025, 3, 8), date(2025, 6, 5))
    kept = Scope("last_90_days").filter(orders)
    assert kept.count() == 3
    plan = kept._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan
    row = scope.period_over_period(orders, scope=Scope("last_90_days")).first()
    assert (row.orders, row.prev_orders) == (3, 3)


def test_filter_values_are_sorted(make_orders, make_restaurants):
    rows = scope.filter_values(
        make_orders({"traffic": "Low"}, {"traffic": "High"}), make_restaurants((1, "Thai", 1.0), (2, "Pizza", 1.0))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("cuisine", "Pizza"),
        ("cuisine", "Thai"),
        ("traffic", "High"),
        ("traffic", "Low"),
    ]


def test_change_is_explained_completely(make_orders):
    d1, d2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    orders = make_orders(
        *({"order_ts": d1, "traffic": "Low", "cancelled": int(i < 2)} for i in range(10)),
        *({"order_ts": d2, "traffic": "Low", "cancelled": int(i < 3)} for i in range(6)),
        *({"order_ts": d2, "traffic": "High", "cancelled": int(i < 1)} for i in range(4)),
    )
    day = Scope("custom", date(2025, 1, 2), date(2025, 1, 2))
    rows = {r.traffic: r for r in diagnostics.rate_change_contribution(orders, "traffic", day).collect()}
    assert sum(r.contribution_pp for r in rows.values()) == pytest.approx(40.0 - 20.0)
    for r in rows.values():
        assert r.mix_pp + r.rate_pp == pytest.approx(r.contribution_pp)
    gmv = diagnostics.gmv_decomposition(orders, scope=day).first()
    assert gmv.volume_effect + gmv.aov_effect == pytest.approx(gmv.gmv_change)
    assert gmv.volume_effect == pytest.approx(-200.0)


def test_week_without_a_neighbour_has_no_growth(make_orders):
    stamps = [datetime(2025, 1, 6), datetime(2025, 1, 13), datetime(2025, 1, 14), datetime(2025, 2, 3)]
    rows = diagnostics.wow_growth(make_orders(*({"order_ts": t} for t in stamps))).collect()
    assert [r.orders_wow_pct for r in rows] == [None, 100.0, None]
