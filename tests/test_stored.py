"""What is stored and reused: bitmaps, daily parts, bucketed base tables, fitted models; and joins on hot keys."""

from __future__ import annotations

import random
import re
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallwise.operators import bitmaps, funnel, journeys, kpis, models, registry, rollups, spread
from stallwise.operators.scope import Period
from stallwise.plans import workload
from stallwise.sources import base, sinks, standins, tables, versions

SF = "/root/testdata/sf0.001"
START = datetime(2025, 1, 1)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    draw = random.Random(3)
    rows = [
        (f"s{draw.randrange(40)}", draw.choice([*range(-5, 30), 70_000, 10**12]), START + timedelta(hours=draw.randrange(400)),
         draw.choice(["view", "click", "buy", "other"]))
        for _ in range(600)
    ]
    rows += [(None, None, START, "view"), ("s1", 1, None, "view"), ("s1", 1, START, None)]
    return spark.createDataFrame(rows, "session_id string, user_id bigint, event_ts timestamp_ntz, event_name string")


# Bitmaps


@pytest.mark.parametrize("first, last", [(None, None), (date(2025, 1, 3), date(2025, 1, 5)), (date(2024, 1, 1), date(2024, 1, 2))])
def test_funnel_of_any_period(spark, events, first, last):
    numbers = bitmaps.number_keys(events, "session_id")
    assert numbers.count() == numbers.select("number").distinct().count() == 40
    daily = bitmaps.daily_bitmaps(events.join(numbers, "session_id"), "number")
    inside = events.where("event_ts IS NOT NULL")
    if first:
        inside = inside.where(F.to_date("event_ts").between(F.lit(first), F.lit(last)))
    stages = ["view", "click", "buy", "never"]
    assert bitmaps.funnel_from_bitmaps(daily, stages, first, last).collect() == funnel.event_funnel(inside, stages).collect()


def test_new_keys_are_numbered_after_the_known(spark, events):
    early = events.where("event_ts < '2025-01-04'")
    known = bitmaps.number_keys(early, "session_id")
    both = bitmaps.number_keys(events, "session_id", known=known)
    assert both.count() == both.select("number").distinct().count() == 40
    assert both.join(known, ["session_id", "number"]).count() == known.count()
    top = known.agg(F.max("number")).first()[0]
    assert both.join(known, "session_id", "left_anti").where(F.col("number") <= top).count() == 0
    # The old days' bitmaps hold with the new numbers.
    old = bitmaps.daily_bitmaps(early.join(known, "session_id"), "number")
    new = bitmaps.daily_bitmaps(events.where("event_ts >= '2025-01-04'").join(both, "session_id"), "number")
    whole = bitmaps.distinct_counts(old.unionByName(new), name="n").first().n
    assert whole == events.where("event_ts IS NOT NULL").select("session_id").dropna().distinct().count()


@pytest.mark.parametrize("days", [1, 3, 40])
def test_trailing_users(spark, events, days):
    daily = bitmaps.daily_bitmaps(events, "user_id", by=("event_name",))
    found = {r.day: r.users for r in bitmaps.trailing_distinct(daily, days, "users").collect()}
    rows = [(r.event_ts.date(), r.user_id) for r in events.where("event_ts IS NOT NULL AND user_id IS NOT NULL").collect()]
    for day in {d for d, _ in rows}:
        assert found[day] == len({u for d, u in rows if timedelta(0) <= day - d < timedelta(days)})
    assert set(found) == {d for d, _ in rows}


def test_bitmaps_of_nothing(spark, events):
    daily = bitmaps.daily_bitmaps(events.limit(0), "user_id")
    assert bitmaps.distinct_counts(daily, name="n").first().n == 0
    assert bitmaps.trailing_distinct(daily).count() == 0
    assert [r.sessions for r in bitmaps.funnel_from_bitmaps(daily, ["view", "click"]).collect()] == [0, 0]


def test_period_reads_no_event(spark, events, tmp_path):
    bitmaps.daily_bitmaps(events, "user_id").write.partitionBy("day").parquet(str(tmp_path / "daily"))
    stored = spark.read.parquet(str(tmp_path / "daily"))
    text = plan(bitmaps.funnel_from_bitmaps(stored, ["view"], date(2025, 1, 3), date(2025, 1, 4)))
    assert "event_ts" not in text and re.search(r"PartitionFilters: \[[^\]]*day", text)


# Daily parts


@pytest.fixture
def table(spark):
    name = f"stored_{uuid.uuid4().hex}"
    yield name
    for made in (name, f"{name}_orders", f"{name}_lines"):
        spark.sql(f"DROP VIEW IF EXISTS {made}")
        versions.forget_versions(spark, made, keep=0)


def days_of_orders(make_orders, days, per_day=5, **more):
    return make_orders(
        *(
            {"order_ts": START + timedelta(days=d, hours=h), "cancelled": (d + h) % 3 == 0 and 1 or 0, "eta_minutes": 30.0 + h * d, **more}
            for d in days
            for h in range(per_day)
        )
    )


def test_measures_from_parts_equal_those_from_orders(spark, make_orders, table):
    orders = days_of_orders(make_orders, range(9)).unionByName(make_orders({"order_ts": None, "eta_minutes": None}))
    parts = rollups.refresh(spark, table, orders)
    assert rollups.daily_kpis(parts).collect() == kpis.daily_kpis(orders).collect()
    assert rollups.kpi_summary(parts).collect() == kpis.kpi_summary(orders).collect()
    assert sorted(rollups.daily_series(parts).collect()) == sorted(kpis.daily_series(orders).collect())
    none = orders.limit(0)
    assert rollups.kpi_summary(rollups.daily_parts(none)).collect() == kpis.kpi_summary(none).collect()


def test_only_the_given_days_are_computed_anew(spark, make_orders, table):
    orders = days_of_orders(make_orders, range(6))
    rollups.refresh(spark, table, orders)
    changed = orders.withColumn("revenue", F.col("revenue") + 1)
    two = [date(2025, 1, 2), date(2025, 1, 5)]
    parts = rollups.refresh(spark, table, changed, two)
    before = {r.day: r.revenue_cents for r in rollups.daily_parts(orders).collect()}
    after = {r.day: r.revenue_cents for r in rollups.daily_parts(changed).collect()}
    found = {r.day: r.revenue_cents for r in parts.collect()}
    assert found == {day: (after if day in two else before)[day] for day in before}
    # A day whose orders are gone loses its row.
    parts = rollups.refresh(spark, table, orders.where("order_ts >= '2025-01-03'"), [date(2025, 1, 1)])
    assert sorted(r.day for r in parts.collect()) == sorted(set(before) - {date(2025, 1, 1)})


def test_a_new_day_scans_its_own_orders(spark, make_orders, table, tmp_path):
    orders = days_of_orders(make_orders, range(6))
    sinks.write_orders(orders, str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    rollups.refresh(spark, table, stored)
    days = [date(2025, 1, d) for d in (4, 5, 31)]
    assert rollups._runs(days) == [Period(days[0], days[1]), Period(days[2], days[2])]
    # The other days' files are gone: they are not asked for.
    for folder in (tmp_path / "orders").glob("order_date=*"):
        if "2025-01-04" not in folder.name:
            folder.rename(tmp_path / folder.name)
    parts = rollups.refresh(spark, table, stored, days[:1])
    assert rollups.daily_kpis(parts).collect() == kpis.daily_kpis(orders).collect()


# Bucketed base tables


def test_base_tables_join_without_a_shuffle(spark, table):
    raw = [standins.table(spark, SF, name) for name in ("orders", "lineitem")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = base.write_base(*raw, table, buckets=4).load(spark)
        facts = standins.facts_of(*stored).select("order_id", "restaurant_id", "basket_value", "revenue")
        text = plan(facts)
        assert "Exchange" not in text and "Join" in text
        plain = standins.order_facts(spark, SF).select(*facts.columns)
        assert "Exchange" in plan(plain)
        assert sorted(facts.collect()) == sorted(plain.collect())
        files = [f for f in stored[1].inputFiles()]
        assert len(files) == 4  # a file a bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Hot keys


@pytest.fixture
def plain_plans(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ROWS = 6000


@pytest.fixture
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(ROWS).select(F.col("id").alias("order_id"), key.cast("long").alias("user_id"), (F.col("id") * 2).alias("v"))


def test_hot_user_and_nulls_are_spread(spark, hot, plain_plans):
    users = spark.range(400).select(F.col("id").alias("user_id"), F.concat(F.lit("c"), F.col("id") % 4).alias("channel"))
    joined = spread.spread_join(hot, users, "user_id")
    usual = hot.join(users, "user_id", "left")
    assert joined.columns == usual.columns
    assert sorted(joined.collect(), key=str) == sorted(usual.collect(), key=str)
    sizes = {r.p: r.n for r in usual.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) > ROWS / 3  # what it is for
    keyed = joined.where("user_id IS NOT NULL")
    sizes = {r.p: r.n for r in keyed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * (ROWS * 2 / 3) / 8
    # Rows without a key go round the exchange.
    text = plan(joined)
    assert text.index("Union") < text.index("Exchange") and text.count("Exchange") == 2


@pytest.mark.parametrize("how", ["left", "inner"])
def test_repeated_and_missing_dimension_rows(spark, hot, plain_plans, how):
    users = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (None, "d")], "user_id bigint, channel string")
    joined = spread.spread_join(hot, users, "user_id", how)
    assert sorted(joined.collect(), key=str) == sorted(hot.join(users, "user_id", how).collect(), key=str)


def test_heavy_keys_are_few_and_their_parts_bounded(spark, hot):
    heavy = spread.heavy_keys(hot, "user_id", partitions=8)
    assert list(heavy) == [7] and 4 <= heavy[7] <= 5
    assert spread.heavy_keys(hot.limit(0), "user_id", 8) == {}
    even = spark.range(1000).select(F.col("id").alias("user_id"))
    assert spread.heavy_keys(even, "user_id", 8) == {}
    many = spread.heavy_keys(hot, "user_id", partitions=4000)
    assert sum(many.values()) <= 8000


def test_strings_as_keys_and_clashing_columns(spark, plain_plans):
    facts = spark.createDataFrame([("x", 1)] * 50 + [(None, 2), ("y", 3)], "k string, channel int")
    places = spark.createDataFrame([("x", "a"), ("z", "b")], "k string, channel string")
    rows = spread.spread_join(facts, places, "k").collect()
    assert len(rows) == 52 and sum(r[2] == "a" for r in rows) == 50


def test_cuisine_of_a_hot_restaurant(spark, make_orders, make_restaurants, plain_plans):
    orders = make_orders(*({"restaurant_id": None if n % 3 == 0 else 1 if n % 3 == 1 else n} for n in range(300)))
    places = make_restaurants(*((n, f"c{n % 7}", 4.0) for n in range(200)))
    columns = sorted(journeys.with_cuisine(orders, places).columns)
    usual, spreads = (journeys.with_cuisine(orders, places, spread=s).select(columns) for s in (False, True))
    assert sorted(usual.collect(), key=str) == sorted(spreads.collect(), key=str)
    assert "Union" in plan(spreads)


# Models


def test_fingerprint_hangs_on_rows_alone(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3.5), (2, None, 3.5)], "i bigint, s string, x double")
    known = registry.fingerprint(rows)
    assert registry.fingerprint(rows.orderBy(F.desc("i")).repartition(3)) == known
    assert registry.fingerprint(rows.select("x", "s", "i")) == known
    others = [
        rows.distinct(), rows.unionByName(rows.limit(1)), rows.withColumn("x", F.col("x") + 1), rows.limit(0),
        rows.withColumnRenamed("x", "y"), rows.withColumn("i", F.col("i").cast("int")),
        spark.createDataFrame([(1, None, None), (2, "a", 3.5), (2, None, 3.5)], rows.schema),
    ]
    assert len({known, *map(registry.fingerprint, others)}) == len(others) + 1


def test_a_model_is_fitted_once_for_its_rows(spark, tmp_path):
    rows = workload._features(spark, SF)
    fits = []

    def train(frame):
        fits.append(1)
        return models.train_eta(frame, rounds=2)

    one = registry.fitted(rows, "eta", train, {"rounds": 2}, str(tmp_path))
    two = registry.fitted(rows.repartition(5), "eta", train, {"rounds": 2}, str(tmp_path))
    assert (one.fresh, two.fresh, len(fits), one.path) == (True, False, 1, two.path)
    assert [tuple(r) for r in one.metrics.collect()] == [tuple(r) for r in two.metrics.collect()]
    assert models.score_eta(one.model, rows).exceptAll(models.score_eta(two.model, rows)).count() == 0
    assert registry.fitted(rows, "eta", train, {"rounds": 3}, str(tmp_path)).fresh
    assert registry.fitted(rows.where("order_id > 5"), "eta", train, {"rounds": 2}, str(tmp_path)).fresh
    assert len(fits) == 3 and not [p for p in tmp_path.iterdir() if p.name.startswith(".") and p.is_dir()]


def test_a_failed_fit_leaves_nothing_behind(spark, tmp_path):
    rows = workload._features(spark, SF)

    def broken(_):
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        registry.fitted(rows, "eta", broken, folder=str(tmp_path))
    assert registry.fitted(rows, "eta", lambda r: models.train_eta(r, rounds=1), folder=str(tmp_path)).fresh


@pytest.mark.parametrize("seed", range(3))
def test_rank_auc(spark, seed):
    draw = random.Random(seed)
    rows = [(round(draw.random(), draw.choice([1, 4])), int(draw.random() < 0.3)) for _ in range(200)] + [(None, 1), (0.5, None)]
    frame = spark.createDataFrame(rows, "score double, label int")
    known = [r for r in rows if None not in r]
    ones, zeros = [s for s, y in known if y], [s for s, y in known if not y]
    truth = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert spark.range(1).select(models.rank_auc(frame, "score", "label").alias("auc")).first().auc == pytest.approx(truth)
    one = frame.where("label = 1")
    assert spark.range(1).select(models.rank_auc(one, "score", "label").alias("auc")).first().auc is None


@pytest.mark.parametrize("kind", ["eta", "cancel"])
def test_a_constant_model_fails_the_checks(spark, monkeypatch, kind):
    score = {"eta": "predicted_eta_minutes", "cancel": "cancellation_probability"}[kind]

    def constant(_, rows):
        mean = {"eta": 38.0, "cancel": 0.3}[kind]
        return rows.withColumn(score, F.lit(mean))

    short = {"eta": models.train_eta, "cancel": models.train_cancel}[kind]
    monkeypatch.setitem(workload.TRAIN, kind, lambda rows: short(rows, rounds=1))
    monkeypatch.setitem(workload.SCORE, kind, constant)
    monkeypatch.setattr(models, "PARAMETERS", {"rounds": 1, "kind": kind})
    assert workload.QUERIES["score_eta" if kind == "eta" else "score_cancellation_risk"](spark, SF).where("NOT near").count() > 0
    if kind == "cancel":
        monkeypatch.setattr(models, "score_cancellation_risk", constant)
        assert workload.QUERIES["cancel_model_metrics"](spark, SF).where("NOT sound").count() == 1


# Broken rows


def test_broken_rows_are_set_apart(spark, tmp_path):
    header = "user_id,signup_date,acquisition_channel"
    lines = ["1,2025-01-01,Ads", "x,2025-01-01,Ads", "2,2025-13-01,Ads", "3,2025-01-02", "4,2025-01-03,Ads,more", "5,,", '6,2025-01-04,"a,b"']
    (tmp_path / "users.csv").write_text("\n".join([header, *lines]) + "\n")
    orders = spark.createDataFrame([(1,)], "order_id bigint")
    for name in ("orders", "restaurants"):
        frame = tables.SCHEMAS[name]
        sinks.write_table(spark.createDataFrame([], frame), f"{tmp_path}/{name}.csv", "csv")
    assert orders.count() == 1
    loaded, rejected = tables.load_csv_checked(spark, str(tmp_path))
    assert sorted(r.user_id for r in loaded["users"].collect()) == [1, 5, 6]
    assert loaded["users"].dtypes == tables.load_csv(spark, str(tmp_path))["users"].dtypes
    found = rejected.collect()
    assert sorted(r.line for r in found) == sorted(lines[1:5])
    assert {r.table for r in found} == {"users"} and all(r.file.endswith("users.csv") for r in found)
    # The same rows whatever columns are asked for.
    assert loaded["users"].select("acquisition_channel").count() == 3
    assert rejected.groupBy("table").count().collect()[0]["count"] == 4
    assert loaded["orders"].count() == 0 and "riders" not in loaded


def test_missing_required_table(spark, tmp_path):
    with pytest.raises(tables.MissingTable):
        tables.load_csv_checked(spark, str(tmp_path))
