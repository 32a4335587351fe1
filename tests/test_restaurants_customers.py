from __future__ import annotations

from datetime import datetime

import pytest

from stallwise.operators import cancellations, customers, diagnostics, restaurants, retention


def test_sql_scorecard_keeps_orders_without_restaurant(make_orders, make_restaurants):
    orders = make_orders({"restaurant_id": None}, {"restaurant_id": 1})
    assert {r.restaurant_id for r in restaurants.restaurant_scorecard_sql(orders).collect()} == {None, 1}
    status = restaurants.restaurant_status(orders, make_restaurants((1, "Thai", 4.0), (2, "Thai", 4.0))).collect()
    assert [r.restaurant_id for r in status] == [1]


def test_status_flags_the_worst_tenth(make_orders, make_restaurants):
    orders = make_orders(
        *({"restaurant_id": r, "eta_minutes": 20.0 + r, "cancelled": int(r == 3)} for r in range(1, 12))
    )
    places = make_restaurants(*((r, "Thai", 4.0) for r in range(1, 12)))
    rows = {r.restaurant_id: r for r in restaurants.restaurant_status(orders, places).collect()}
    # The 90th percentile of the rates is 0, which every restaurant reaches.
    assert all(r.status == "Needs attention" for r in rows.values())
    calm = orders.withColumn("cancelled", orders.restaurant_id.cast("int"))
    rows = {r.restaurant_id: r.status for r in restaurants.restaurant_status(calm, places).collect()}
    assert [k for k, v in rows.items() if v != "Healthy"] and {k for k, v in rows.items() if v != "Healthy"} == {10, 11}


def test_status_without_eta_or_orders(make_orders, make_restaurants):
    places = make_restaurants((1, "Thai", 4.0))
    row = restaurants.restaurant_status(make_orders({"eta_minutes": None}), places).first()
    assert row.avg_eta is None and row.status == "Needs attention"
    assert restaurants.restaurant_status(make_orders({}).limit(0), places).count() == 0


def test_top_restaurants_per_cuisine_break_ties_by_id(make_orders, make_restaurants):
    orders = make_orders(*({"restaurant_id": r} for r in (4, 3, 2, 1, 5)))
    places = make_restaurants(*((r, "Thai" if r < 5 else "Pizza", 4.0) for r in range(1, 6)))
    rows = restaurants.top3_restaurants_by_cuisine(orders, places).collect()
    assert [(r.cuisine, r.restaurant_id, r.rn) for r in rows] == [
        ("Pizza", 5, 1),
        ("Thai", 1, 1),
        ("Thai", 2, 2),
        ("Thai", 3, 3),
    ]


def test_orders_are_aggregated_before_the_restaurant_join(make_orders, make_restaurants):
    frame = restaurants.restaurant_performance(make_orders({}), make_restaurants((1, "Thai", 4.0)))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [restaurant_id" in plan[plan.index("Join Inner") :]


def test_top_30_and_top_n(make_orders, make_restaurants):
    orders = make_orders(*({"restaurant_id": r, "revenue": 10.0 * r + 0.5} for r in range(1, 41)))
    places = make_restaurants(*((r, "Thai", 4.0) for r in range(1, 41)))
    rows = restaurants.restaurant_top30(orders, places).collect()
    assert len(rows) == 30 and rows[0].restaurant_id == 40 and rows[0].gmv == 401.0
    assert [r.restaurant_id for r in diagnostics.top_n_restaurants(orders, 2).collect()] == [40, 39]


def user_orders(make_orders, **counts):
    rows = []
    for name, (n, revenue) in counts.items():
        rows += [{"user_id": int(name[1:]), "revenue": revenue / n} for _ in range(n)]
    return make_orders(*rows)


def test_behavioral_segments(make_orders):
    orders = user_orders(make_orders, u1=(1, 100.0), u2=(2, 100.0), u3=(3, 900.0), u4=(4, 400.0), u5=(5, 50.0))
    found = {r.user_id: r.segment for r in customers.customer_segments(orders).collect()}
    assert found == {1: "New / one-time", 2: "Repeat", 3: "Repeat", 4: "Loyal high-value", 5: "Occasional"}
    counts = {r.segment: r.customers for r in customers.behavioral_segments(orders).collect()}
    assert counts == {"Repeat": 2, "New / one-time": 1, "Loyal high-value": 1, "Occasional": 1}


def test_even_number_of_customers_takes_the_middle(make_orders):
    # Median 250: 240 is below it, 260 above.
    orders = user_orders(make_orders, u1=(4, 240.0), u2=(4, 260.0))
    assert {r.user_id: r.segment for r in customers.customer_segments(orders).collect()} == {
        1: "Occasional",
        2: "Loyal high-value",
    }


def test_segments_of_nobody(make_orders):
    nobody = make_orders({"cancelled": 1})
    assert customers.behavioral_segments(nobody).count() == 0
    assert customers.rfm_segments(nobody).count() == 0


def test_rfm_with_fewer_customers_than_tiles(make_orders):
    orders = make_orders(*({"user_id": u, "order_ts": datetime(2025, 1, u)} for u in (1, 2, 3)))
    rows = sorted(customers.rfm_segments(orders).collect())
    assert [(r.recency_score, r.frequency_score, r.monetary_score) for r in rows] == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
    assert [r.segment for r in rows] == ["At Risk", "At Risk", "Loyal"]


def test_rfm_ties_follow_the_user_id(make_orders):
    rows = sorted(customers.rfm_segments(make_orders(*({"user_id": u} for u in range(1, 11)))).collect())
    assert [r.frequency_score for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r.segment for r in rows[-4:]] == ["Champions"] * 4


def test_orders_without_user_are_one_customer(make_orders):
    orders = make_orders({"user_id": None}, {"user_id": None}, *({"user_id": u} for u in (1, 2, 3, 4)))
    rows = customers.rfm_segments(orders).collect()
    scores = {r.user_id: (r.frequency, r.recency_score, r.frequency_score) for r in rows}
    assert scores == {1: (1, 1, 1), 2: (1, 2, 2), 3: (1, 3, 3), 4: (1, 4, 4), None: (2, 5, 5)}


def test_customers_with_orders_counts_every_order(make_orders):
    orders = make_orders({"cancelled": 1}, {}, {}, {"user_id": 2})
    assert [tuple(r) for r in customers.customers_with_orders(orders).collect()] == [(1, 3)]


def test_cohorts(make_orders):
    orders = make_orders(
        {"user_id": 1, "order_ts": datetime(2024, 12, 31), "cancelled": 1},
        {"user_id": 1, "order_ts": datetime(2025, 1, 31)},
        {"user_id": 1, "order_ts": datetime(2025, 1, 2)},
        {"user_id": 1, "order_ts": datetime(2025, 3, 1)},
        {"user_id": 2, "order_ts": datetime(2025, 1, 5)},
    )
    cells = [tuple(r) for r in retention.cohort_retention(orders).collect()]
    jan = datetime(2025, 1, 1)
    assert cells == [(jan, 0, 2), (jan, 2, 1)]
    activity = [tuple(r) for r in retention.cohort_activity(orders).collect()]
    assert activity == [("2025-01", "2025-01", 2), ("2025-01", "2025-03", 1)]


def test_retention_by_segment(spark, make_orders):
    orders = make_orders(
        {"user_id": 1, "order_ts": datetime(2025, 1, 2)},
        {"user_id": 2, "order_ts": datetime(2025, 1, 2)},
        {"user_id": 2, "order_ts": datetime(2025, 2, 2)},
        {"user_id": 3, "order_ts": datetime(2025, 1, 2)},
    )
    users = spark.createDataFrame([(1, "Ads"), (2, "Ads")], "user_id bigint, acquisition_channel string")
    rows = retention.retention_by_segment(orders, users, "acquisition_channel").collect()
    cells = {(r.segment, r.month_number): (r.active_users, r.cohort_size, r.retention_pct) for r in rows}
    assert cells == {("Ads", 0): (2, 2, 100.0), ("Ads", 1): (1, 2, 50.0), (None, 0): (1, 1, 100.0)}


def test_worst_segment_ties_and_nulls(make_orders):
    orders = make_orders(
        {"traffic": "Medium", "cancelled": 1}, {"traffic": "High", "cancelled": 1}, {"traffic": None, "cancelled": 1}
    )
    assert cancellations.worst_cancellation_segment(orders, "traffic").first().traffic == "High"
    assert cancellations.cancellation_by(orders, "traffic").count() == 2
    assert cancellations.worst_cancellation_segment(orders.limit(0), "traffic").count() == 0


def test_severity(make_orders):
    orders = make_orders({"traffic": "High", "cancelled": 1}, *({"cancelled": int(i < 3)} for i in range(9)))
    rows = cancellations.severity_impact_rank(orders, "traffic").collect()
    assert [(r.traffic, r.cancelled_orders, r.share_of_cancellations_pct) for r in rows] == [
        ("Low", 3, 75.0),
        ("High", 1, 25.0),
    ]
    shares = diagnostics.gmv_contribution(orders, "traffic").collect()
    assert sum(r.share_pct for r in shares) == pytest.approx(100.0)
