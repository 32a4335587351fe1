from __future__ import annotations

from datetime import date, datetime

import pytest

from stallwise.operators import kpis


def test_summary_rates(spark, make_orders):
    row = kpis.kpi_summary(
        make_orders({"revenue": 300.0}, {"cancelled": 1, "revenue": 0.0}, {"revenue": 500.0}, {"revenue": 400.0})
    ).first()
    assert (row.orders, row.delivered_orders) == (4, 3)
    assert (row.delivery_rate_pct, row.cancellation_rate_pct) == (75.0, 25.0)
    assert (row.revenue_per_order, row.total_revenue) == (300.0, 1200.0)


def test_daily_kpis_without_deliveries(make_orders):
    row = kpis.daily_kpis(make_orders({"cancelled": 1})).first()
    assert row.order_date == datetime(2025, 1, 1)
    assert row.aov is None
    assert (row.gmv, row.cancellation_rate_pct, row.sla_45_pct) == (0.0, 100.0, 0.0)


def test_daily_sla_is_over_all_orders(make_orders):
    row = kpis.daily_kpis(
        make_orders({"eta_minutes": 35.0}, {"cancelled": 1}, {"eta_minutes": None}, {"eta_minutes": 51.0})
    ).first()
    assert row.sla_45_pct == 25.0


def test_rolling_average_counts_rows_not_days(make_orders):
    days = [1, 1, 2, 3, 4, 5, 6, 20]
    rows = kpis.rolling_7d_orders(make_orders(*({"order_ts": datetime(2025, 1, d)} for d in days))).collect()
    assert [r.orders for r in rows] == [2, 1, 1, 1, 1, 1, 1]
    assert rows[0].rolling_7d_orders == 2.0
    # The gap before the 20th is not a run of empty days.
    assert rows[-1].rolling_7d_orders == pytest.approx(8 / 7)


def test_trends(make_orders):
    rows = kpis.daily_trends_7d(
        make_orders(
            {"order_ts": datetime(2025, 1, 1), "eta_minutes": 20.0},
            {"order_ts": datetime(2025, 1, 2), "eta_minutes": 40.0, "cancelled": 1},
        )
    ).collect()
    assert rows[1].date == date(2025, 1, 2)
    assert (rows[1].gmv, rows[1].gmv_7d, rows[1].cancel_7d, rows[1].eta_7d) == (0.0, 50.0, 50.0, 30.0)


def test_peak_day_ties_go_to_the_earliest(make_orders):
    orders = make_orders(*({"order_ts": datetime(2025, 1, d)} for d in (3, 2, 2, 3, 1)))
    found = {r.kind: r for r in kpis.peak_and_worst_day(orders).collect()}
    assert (found["peak_demand"].date, found["peak_demand"].value) == (date(2025, 1, 2), 2.0)
    assert (found["worst_cancellation"].date, found["worst_cancellation"].value) == (date(2025, 1, 1), 0.0)


def test_no_orders(make_orders):
    empty = make_orders({}).limit(0)
    assert kpis.peak_and_worst_day(empty).count() == 0
    assert kpis.hourly_demand(empty).count() == 0
    assert kpis.repeat_customer_rate(empty).first().repeat_customer_rate_pct is None


def test_repeat_rate_counts_delivered_orders_only(make_orders):
    orders = make_orders({"user_id": 1}, {"user_id": 1, "cancelled": 1}, {"user_id": 2}, {"user_id": 2})
    assert kpis.repeat_customer_rate(orders).first().repeat_customer_rate_pct == 50.0


def test_busiest_hour(make_orders):
    rows = kpis.hourly_demand(make_orders({"hour": 9}, {"hour": 20}, {"hour": 20}, {"hour": None})).collect()
    assert [(r.hour, r.orders, r.is_peak) for r in rows] == [(9, 1, False), (20, 2, True)]
