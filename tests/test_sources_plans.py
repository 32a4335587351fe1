from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stallwise.operators import customers, features, kpis, models, quality
from stallwise.operators.scope import Scope
from stallwise.plans import batch, reports
from stallwise.sources import sinks, staging, tables
from stallwise.sources.schemas import SCHEMAS, TRAFFIC_ORDINAL, WEATHER_ORDINAL

ORDERS = 600


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """A small complete data set, written as CSV and read back."""
    path = tmp_path_factory.mktemp("market")
    i = F.col("id")

    def pick(values, by):
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    start = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    minutes = (i * 7919 % (60 * 24 * 60)).cast("int")
    cancelled = (i % 11 == 0).cast("int")
    basket = F.lit(120.0) + i * 37 % 900
    distance = F.round(F.lit(0.5) + i * 13 % 135 / 10, 2)
    traffic = pick(["Low", "Medium", "High"], i * 5 + i % 7)
    orders = spark.range(1, ORDERS + 1).select(
        i.alias("order_id"),
        (i * 31 % 90 + 1).alias("user_id"),
        (i * 17 % 20 + 1).alias("restaurant_id"),
        (i % 5 + 1).alias("rider_id"),
        (start + F.make_dt_interval(mins=minutes)).alias("order_ts"),
        F.hour(start + F.make_dt_interval(mins=minutes)).alias("hour"),
        (i % 2).cast("int").alias("weekend"),
        traffic.alias("traffic"),
        pick(["Clear", "Cloudy", "Rain"], i).alias("weather"),
        distance.alias("distance_km"),
        (i % 6 + 1).cast("int").alias("items"),
        basket.alias("basket_value"),
        basket.alias("listed_price"),
        F.lit(0.0).alias("discount_pct"),
        (F.lit(20.0) + distance * 3).alias("eta_minutes"),
        cancelled.alias("cancelled"),
        (1 - cancelled).alias("delivered"),
        F.when(cancelled == 1, 0.0).otherwise(basket).alias("revenue"),
    )
    restaurants = spark.range(1, 21).select(
        i.alias("restaurant_id"),
        pick(["Thai", "Pizza"], i).alias("cuisine"),
        F.lit(4.0).alias("rating"),
        i.alias("prep_capacity"),
    )
    experiments = spark.range(200).select(
        F.lit("x").alias("experiment_id"),
        i.cast("string").alias("session_id"),
        pick(["Control", "Treatment"], i).alias("variant"),
        (i % 3 == 0).cast("int").alias("converted"),
        F.lit(1.0).alias("gmv"),
        F.lit(0).alias("cancelled"),
    )
    for name, frame in (("orders", orders), ("restaurants", restaurants), ("experiments", experiments)):
        sinks.write_table(frame, f"{path}/{name}.csv", "csv")
    return tables.load_csv(spark, str(path))


def test_csv_has_the_declared_types(market):
    for name, frame in market.frames.items():
        assert frame.schema == StructType.fromDDL(SCHEMAS[name])
    row = market["orders"].filter("order_id = 1").first()
    assert row.order_ts == datetime(2025, 1, 1) + timedelta(minutes=7919)
    assert market["orders"].filter("order_ts IS NULL OR revenue IS NULL").count() == 0


def test_parquet_round_trip(spark, market, tmp_path):
    for name, frame in market.frames.items():
        sinks.write_table(frame, f"{tmp_path}/{name}.parquet")
    again = tables.load_parquet(spark, str(tmp_path))
    assert again["orders"].count() == ORDERS
    assert set(again.frames) == set(market.frames)


def test_optional_and_required_tables(spark, market, tmp_path):
    assert "events" not in market
    with pytest.raises(tables.MissingTable, match="events"):
        market["events"]
    with pytest.raises(tables.MissingTable, match="restaurants"):
        tables.load_parquet(spark, str(tmp_path))


def test_adhoc_sql(market):
    row = market.sql("SELECT count(*) AS n FROM orders WHERE traffic = :level", level="Low").first()
    assert row.n == market["orders"].filter("traffic = 'Low'").count()


def test_reports_are_queryable(spark, market):
    names = reports.register(reports.sql_pack(market), "pack_")
    names += reports.register(reports.reports(market, Scope("last_30_days", cuisine="Thai")), "scoped_")
    assert "scoped_event_funnel" not in names and "scoped_experiment_readout" in names
    assert spark.sql("SELECT sum(orders) AS n FROM pack_daily_kpis").first().n == ORDERS
    scoped = spark.sql("SELECT orders FROM scoped_period_over_period").first().orders
    assert scoped == spark.sql("SELECT sum(orders) AS n FROM scoped_hourly_demand").first().n > 0


def test_saved_table(spark, market):
    sinks.save_as_table(market["orders"].select("order_id", "user_id"), "orders_by_user", "user_id", 4)
    plan = (
        customers.customers_with_orders(spark.table("orders_by_user"))._jdf.queryExecution().executedPlan().toString()
    )
    assert "Exchange" not in plan
    spark.sql("DROP TABLE orders_by_user")


def test_batch_run(spark, market, tmp_path):
    batch.run(market, str(tmp_path), rounds=2)
    metrics = {r.metric: r.value for r in spark.read.json(f"{tmp_path}/metrics").collect()}
    assert metrics["eta_mae"] < 15 and 0 <= metrics["cancel_auc"] <= 1
    assert spark.read.parquet(f"{tmp_path}/sql_pack/daily_kpis").count() > 30
    assert spark.read.parquet(f"{tmp_path}/reports/experiment_summary").count() == 2
    model = models.load_model(f"{tmp_path}/models/cancel_model")
    rows = features.model_features(market["orders"])
    risk = models.score_cancellation_risk(model, rows).select("cancellation_probability")
    assert risk.filter("cancellation_probability BETWEEN 0 AND 1").count() == ORDERS


def test_batch_run_stops_on_broken_data(market, tmp_path):
    broken = market["orders"].withColumn("delivered", F.lit(1))
    with pytest.raises(batch.BrokenInvariant, match="delivered_is_not_cancelled: 54 of 600"):
        batch.run(tables.TableSet(market.spark, {**market.frames, "orders": broken}), str(tmp_path))


def test_eta_model_learns(market):
    rows = features.model_features(market["orders"])
    model, metric = models.train_eta(rows, rounds=20)
    naive = rows.agg(F.avg(F.abs(F.col("eta_minutes") - F.lit(40.0)))).first()[0]
    assert metric.first().value < naive / 2
    assert models.score_eta(model, rows).filter("predicted_eta_minutes IS NULL").count() == 0


def test_split_is_exact_and_stable(market):
    rows = features.model_features(market["orders"])
    once = features.train_test_split(rows)
    again = features.train_test_split(rows.repartition(7))
    chosen = {r.order_id for r in once.filter("is_test").collect()}
    assert len(chosen) == ORDERS / 5
    assert chosen == {r.order_id for r in again.filter("is_test").collect()}
    counts = features.train_test_split(rows, stratify="cancelled").filter("is_test").groupBy("cancelled").count()
    assert dict(map(tuple, counts.collect())) == {0: round(546 * 0.2), 1: round(54 * 0.2)}


def test_unknown_category_stops_feature_building(market):
    odd = market["orders"].withColumn("traffic", F.lit("Jam"))
    with pytest.raises(Exception, match="unknown category: Jam"):
        features.model_features(odd).collect()


def test_validation(spark):
    schema = "distance_km double, items int, basket_value double, hour int, weekend int, traffic string, weather string"
    rows = [
        (5.0, 2, 100.0, 12, 0, "Low", "Rain"),
        (0.0, 21, 0.0, 24, 2, "Jam", "Fog"),
        (30.0, 20, 0.01, 0, 1, "High", "Clear"),
        (None, 1, 1.0, 1, 1, None, "Clear"),
    ]
    checked = quality.validate_order_features(spark.createDataFrame(rows, schema), TRAFFIC_ORDINAL, WEATHER_ORDINAL)
    assert [r.violations for r in checked.collect()] == [
        [],
        ["distance_km", "items", "basket_value", "hour", "weekend", "traffic", "weather"],
        [],
        ["distance_km", "traffic"],
    ]
    priced = spark.createDataFrame(
        [(1.0, 1.0, 1.0, 0.0), (0.0, 1.0, -1.0, 1.0)],
        "reference_price double, base_demand double, unit_cost double, min_margin double",
    )
    assert [r.violations for r in quality.validate_pricing_inputs(priced).collect()] == [
        [],
        ["reference_price", "unit_cost", "min_margin"],
    ]


def test_invariants_and_grain(spark, make_orders, make_restaurants):
    orders = make_orders({}, {"delivered": 0, "cancelled": 0, "revenue": 5.0}, {"cancelled": 1, "revenue": 5.0})
    trial = spark.createDataFrame([(1, 1), (0, 1)], "converted int, cancelled int")
    places = make_restaurants((1, "Thai", 1.0), (1, "Pizza", 1.0), (2, "Thai", 1.0))
    found = {r.check: (r.rows, r.violations) for r in quality.invariant_violations(orders, trial, places).collect()}
    assert found == {
        "delivered_is_not_cancelled": (3, 1),
        "revenue_only_when_delivered": (3, 2),
        "cancelled_only_when_converted": (2, 1),
        "one_row_per_restaurant": (3, 1),
    }
    assert [tuple(r) for r in quality.grain_check(places, ["restaurant_id"]).collect()] == [(1, 2)]
    fan = quality.join_fanout(orders, places, "restaurant_id").first()
    assert (fan.rows_before, fan.rows_after, fan.unmatched, fan.fans_out) == (3, 6, 0, True)
    fan = quality.join_fanout(make_orders({"restaurant_id": 3}, {"restaurant_id": 2}), places, "restaurant_id").first()
    assert (fan.rows_before, fan.rows_after, fan.unmatched, fan.fans_out) == (2, 1, 1, False)


def test_derived_order_columns(spark):
    at = datetime(2025, 3, 8, 20, 30)
    orders = spark.createDataFrame(
        [
            (at, "High", "Rain", 100.0, 0.1, 1, 2.0, 48.0),
            (at.replace(day=7, hour=9), "Low", "Clear", 100.0, 0.0, 0, 2.0, 56.0),
        ],
        "order_ts timestamp_ntz, traffic string, weather string, basket_value double, discount_pct double,"
        " delivered int, distance_km double, eta_minutes double",
    )
    timed = features.order_time_features(orders)
    assert [(r.hour, r.weekend, r.peak) for r in timed.collect()] == [(20, 1, 1), (9, 0, 0)]
    priced = features.surge_pricing(timed).collect()
    assert [r.listed_price for r in priced] == [116.0, 100.0]
    assert [r.revenue for r in priced] == [104.4, 0.0]
    delayed = features.eta_penalties(orders).collect()
    assert [r.travel for r in delayed] == pytest.approx([8 + 6.2 + 7.2 + 3.15, 8 + 6.2])
    assert [r.cancel_prob for r in delayed] == pytest.approx([0.5, 1 / (1 + 2.718281828459045**-1)])


def test_staged_rows_lie_in_the_shared_folder_until_cleared(spark):
    frame = staging.stage(spark.range(3).withColumn("day", F.lit(date(2025, 1, 1))), "probe")
    assert sorted(r.id for r in frame.collect()) == [0, 1, 2]
    assert {r.day for r in frame.collect()} == {date(2025, 1, 1)}
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in frame.inputFiles())


def test_shared_folder_comes_from_the_session():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    named = Session(**{"spark.checkpoint.dir": "/shared", "spark.sql.warehouse.dir": "/warehouse"})
    assert staging.shared_folder(named) == "/shared"
    assert staging.shared_folder(Session(**{"spark.sql.warehouse.dir": "/warehouse/"})) == "/warehouse/staging"
