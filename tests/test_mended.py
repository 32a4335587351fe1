"""Null metrics and groups, degenerate price grids, wide funnels, many classes, pruned scans and invalid inputs."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.operators import cancellations, customers, diagnostics, features, funnel, kpis, models, pricing, quality
from stallwise.plans.workload import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_a_null_metric_is_never_the_greatest(make_orders):
    orders = make_orders(
        {"traffic": "A", "cancelled": None, "delivered": 0, "order_ts": datetime(2025, 1, 1)},
        {"traffic": "B", "cancelled": 1, "order_ts": datetime(2025, 1, 2)},
        {"traffic": "B", "cancelled": 0, "order_ts": datetime(2025, 1, 2)},
    )
    worst = cancellations.worst_cancellation_segment(orders, "traffic").first()
    assert (worst.traffic, worst.cancellation_rate) == ("B", 50.0)
    days = {r.kind: r.date.day for r in kpis.peak_and_worst_day(orders).collect()}
    assert days == {"peak_demand": 2, "worst_cancellation": 2}


def test_orders_without_a_restaurant_are_a_group(make_orders):
    orders = make_orders({"restaurant_id": None, "cancelled": 1}, {"restaurant_id": 1, "cancelled": 1}, {"restaurant_id": 1})
    rows = {r.restaurant_id: r.orders for r in cancellations.cancellation_by(orders, "restaurant_id", keep_null=True).collect()}
    assert rows == {None: 1, 1: 2}
    assert cancellations.cancellation_by(orders, "restaurant_id").count() == 1
    ranked = cancellations.severity_impact_rank(orders, "restaurant_id").collect()
    assert sum(r.share_of_cancellations_pct for r in ranked) == 100.0 and len(ranked) == 2
    assert {r.restaurant_id for r in diagnostics.top_n_restaurants(orders).collect()} == {None, 1}


def products(spark, *rows):
    return spark.createDataFrame(rows, "product_id int, reference_price double, base_demand double, unit_cost double")


def test_a_price_that_may_not_change(spark):
    frame = products(spark, (1, 100.0, 10.0, 50.0))
    best = pricing.optimize_price(frame, max_change=0.0).first()
    assert (best.recommended_price, best.expected_demand, best.expected_contribution) == (100.0, 10.0, 500.0)
    assert pricing.price_grid(frame, max_change=0.0).count() == pricing.GRID_STEPS


def test_a_product_that_cannot_be_priced_gets_nulls(spark):
    frame = products(spark, (1, 0.0, 10.0, 5.0), (2, None, 10.0, 5.0), (3, 100.0, 10.0, 50.0))
    best = {r.product_id: r.recommended_price for r in pricing.optimize_price(frame).collect()}
    assert best[1] is None and best[2] is None and best[3] == pytest.approx(120.0)


def test_funnel_of_more_stages_than_a_long_has_bits(spark):
    names = [f"s{i}" for i in range(130)]
    rows = [(f"x{i % 7}", name) for i, name in enumerate(names)] + [("y", names[63]), ("y", names[126])]
    found = funnel.event_funnel(spark.createDataFrame(rows, "session_id string, event_name string"), names).collect()
    assert [r.sessions for r in found] == [2 if i in (63, 126) else 1 for i in range(130)]


def test_split_of_many_classes(spark):
    rows = spark.range(6000).select(F.col("id").alias("order_id"), F.when(F.col("id") >= 20, F.col("id") % 150).alias("c"))
    split = features.train_test_split(rows, stratify="c")
    assert split.columns == ["order_id", "c", "is_test"] and split.count() == 6000
    for r in split.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test")).collect():
        assert r.test == round(r.n * 0.2)
    assert features.train_test_split(rows.limit(0)).count() == 0


def test_orders_with_missing_inputs_are_scored(spark):
    orders = spark.createDataFrame(
        [(i, float(20 + i % 30), i % 2, float(1 + i % 9) if i % 3 else None, i % 4 + 1, 100.0, i % 24, 0, "Low" if i % 10 else "?", "Rain") for i in range(200)],
        "order_id bigint, eta_minutes double, cancelled int, distance_km double, items int, basket_value double,"
        " hour int, weekend int, traffic string, weather string",
    )
    rows = features.model_features(orders, strict=False)
    assert rows.count() == 200 and rows.where("distance_km = -1").count() == 67 and rows.where("traffic = -1").count() == 20
    model, metric = models.train_eta(rows, rounds=3)
    assert metric.first().test_rows == 40
    checked = quality.validate_order_features(orders, {"Low": 0}, {"Rain": 2})
    scored = models.score_valid(model, checked, rows, models.score_eta)
    assert scored.count() == 200
    assert scored.where("(predicted_eta_minutes IS NULL) = (size(violations) > 0)").count() == 200


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_period_queries_read_the_lines_of_their_orders_only(spark):
    text = plan(QUERIES["period_snapshot"](spark, SF_DIR))
    assert "LeftSemi" in text


def test_the_journey_funnel_pushes_its_dates_into_the_order_scan(spark):
    text = plan(QUERIES["journey_funnel"](spark, SF_DIR))
    scans = [line for line in text.splitlines() if "o_orderdate" in line and "PushedFilters" in line]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in line for line in scans)


def test_measures_of_empty_tables(make_orders):
    none = make_orders({}).limit(0)
    assert customers.customers_with_orders(none).count() == 0
    assert none.agg(M.gmv_delivered().alias("gmv")).first().gmv == 0.0
