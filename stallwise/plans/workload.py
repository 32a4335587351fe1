"""Every operator as a named query over the stand-in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import partial, reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.operators import (
    bitmaps,
    cancellations,
    customers,
    diagnostics,
    experiments,
    features,
    funnel,
    journeys,
    kpis,
    models,
    pricing,
    quality,
    registry,
    restaurants,
    retention,
    rollups,
    scope,
    spread,
)
from stallwise.operators.scope import Period, Scope
from stallwise.sources import base, sinks, staging, versions
from stallwise.sources import standins as src
from stallwise.sources.schemas import SCHEMAS, conform
from stallwise.sources.tables import TableSet, load_csv, load_csv_checked, load_parquet

Query = Callable[[SparkSession, str], DataFrame]

LAST_30 = Scope("last_30_days")
LAST_90 = Scope("last_90_days")
WEEK = Scope("custom", date(2024, 1, 8), date(2024, 1, 14))
ASIA_URGENT = Scope("last_90_days", cuisine="ASIA", traffic="1-URGENT")

# Delay points of the stand-in categories.
TRAFFIC_POINTS = {src.MEDIUM_TRAFFIC: 7, src.HIGH_TRAFFIC: 16}
WEATHER_POINTS = {src.CLOUDY: 3, src.RAIN: 9}


def rounded(frame: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns whose last bits differ between math libraries, rounded for comparison."""
    return frame.withColumns({c: F.round(c, places) for c in columns})


def _orders(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.order_facts(spark, sf), *args, **kwargs)


def _catalogue(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.order_facts(spark, sf), src.restaurants(spark, sf), *args, **kwargs)


def _period(operator, scope: Scope) -> Query:
    """An operator that looks at a period and the one before: only those orders, and their lines, are read."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        pinned = scope.pinned(src.order_dates(spark, sf))
        within = pinned.bounds(src.order_dates(spark, sf)).with_previous()
        return operator(src.order_facts(spark, sf, within=within), src.restaurants(spark, sf), scope=pinned)

    return query


def _attempts(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.attempts(spark, sf), *args, **kwargs)


def _sessions(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.experiments(spark, sf), *args, **kwargs)


def _by_channel(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.experiments(spark, sf, by_channel=True), *args, **kwargs)


def _products(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(src.products(spark, sf), *args, **kwargs)


def _then(query: Query, step, *args, **kwargs) -> Query:
    return lambda spark, sf: step(query(spark, sf), *args, **kwargs)


def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.event_funnel(src.session_events(spark, sf), src.FUNNEL)


def _funnel_scoped(spark: SparkSession, sf: str) -> DataFrame:
    events = src.session_events(spark, sf)
    return funnel.event_funnel(WEEK.apply(events, WEEK.bounds(events, "event_ts"), ts="event_ts"), src.FUNNEL)


def _cohort_activity(spark: SparkSession, sf: str) -> DataFrame:
    return retention.cohort_activity(LAST_90.filter(src.order_facts(spark, sf)))


def _retention_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    return retention.retention_by_segment(
        src.order_facts(spark, sf), src.users(spark, sf), "acquisition_channel"
    )


def _order_events(spark: SparkSession, sf: str, period: Period | None = None) -> DataFrame:
    return journeys.order_journey_events(src.order_facts(spark, sf), src.restaurants(spark, sf), period=period)


def _browse_events(spark: SparkSession, sf: str, period: Period | None = None) -> DataFrame:
    return journeys.browse_session_events(src.browse_sessions(spark, sf), src.restaurants(spark, sf), period=period)


def _journeys(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.journey_timeline(
        src.order_facts(spark, sf), src.browse_sessions(spark, sf), src.restaurants(spark, sf)
    )


def _journey_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The five-stage funnel of one cuisine at one traffic level in one year."""
    year = Scope("custom", date(2000, 1, 1), date(2000, 12, 31), cuisine="ASIA", traffic="1-URGENT")
    period = Period(year.start, year.end)
    events = journeys.journey_union(_order_events(spark, sf, period), _browse_events(spark, sf, period))
    return funnel.event_funnel(year.apply(events, period, ts="event_ts"))


def _surge(spark: SparkSession, sf: str) -> DataFrame:
    timed = features.order_time_features(src.order_facts(spark, sf, weather=True))
    priced = features.surge_pricing(timed, src.HIGH_TRAFFIC, src.RAIN)
    return rounded(
        priced.select("order_id", "hour", "weekend", "peak", "surge", "listed_price", "revenue"), "surge", places=4
    )


def _penalties(spark: SparkSession, sf: str) -> DataFrame:
    facts = src.order_facts(spark, sf, weather=True)
    delayed = features.eta_penalties(facts, TRAFFIC_POINTS, WEATHER_POINTS)
    return rounded(
        delayed.select("order_id", "traffic_penalty", "weather_penalty", "travel", "cancel_prob"),
        "travel", "cancel_prob",
    )


def _time_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.order_time_features(src.attempts(spark, sf)).select("order_id", "hour", "weekend", "peak")


def _invariants(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invariant_violations(
        src.order_facts(spark, sf), src.experiments(spark, sf), src.restaurants(spark, sf)
    )


def _order_validation(spark: SparkSession, sf: str) -> DataFrame:
    checked = quality.validate_order_features(
        src.order_features(spark, sf), src.TRAFFIC_LEVELS, src.WEATHER_LEVELS
    )
    return checked.select("order_id", F.array_join("violations", ",").alias("violations"))


def _pricing_validation(spark: SparkSession, sf: str) -> DataFrame:
    checked = quality.validate_pricing_inputs(src.products(spark, sf))
    return checked.select("product_id", F.array_join("violations", ",").alias("violations"))


def _grain(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grain_check(src.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _fanout(spark: SparkSession, sf: str) -> DataFrame:
    orders = src.order_facts(spark, sf).select("order_id")
    lines = src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return quality.join_fanout(orders, lines, "order_id")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.model_features(src.order_features(spark, sf), src.TRAFFIC_LEVELS, src.WEATHER_LEVELS)


def _split(spark: SparkSession, sf: str, stratify: str | None = None) -> DataFrame:
    rows = _features(spark, sf).select("order_id", "cancelled")
    return features.train_test_split(rows, stratify=stratify)


TRAIN = {"eta": models.train_eta, "cancel": models.train_cancel}
SCORE = {"eta": models.score_eta, "cancel": models.score_cancellation_risk}
# What a score must lie in: minutes up to twice the longest stand-in ETA, and probabilities.
SCORE_RANGE = {"eta": (0.0, 100.0), "cancel": (0.0, 1.0)}
# The stand-in risk of cancellation by delay points, and the seed of its labels.
RISK_BASE, RISK_PER_POINT, RISK_SEED = 0.05, 0.036, 7
# How far a model's AUC may lie under that of the true risk, and means of scores from those of labels, in groups
# of so many rows at least.
AUC_SLACK = 0.05
GROUP_SLACK = {"eta": 3.0, "cancel": 0.15}
GROUP_ROWS = 50
GROUP = {"eta": ("items", "eta_minutes"), "cancel": ("traffic", "cancelled")}


def _risky(spark: SparkSession, sf: str) -> DataFrame:
    """Model features with labels that hang on them: an order is cancelled with a risk that its traffic and weather set."""
    orders = features.eta_penalties(src.order_features(spark, sf), TRAFFIC_POINTS, WEATHER_POINTS)
    risk = F.lit(RISK_BASE) + F.lit(RISK_PER_POINT) * (F.col("traffic_penalty") + F.col("weather_penalty"))
    drawn = features.split_key("order_id", RISK_SEED) / F.lit(2.0**features.SPLIT_BITS) < F.col("risk")
    labelled = orders.withColumn("risk", risk).withColumn("cancelled", drawn.cast("int"))
    keep = ("order_id", "eta_minutes", "cancelled", "risk")
    return features.model_features(labelled, src.TRAFFIC_LEVELS, src.WEATHER_LEVELS, keep)


def _learned(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, registry.Fitted]:
    """The rows a model is learned from, and the model: fitted once for these rows.

    The rows are read many times, so orders and lines are joined once and their features staged.
    """
    rows = staging.stage(_features(spark, sf) if kind == "eta" else _risky(spark, sf), "features")
    return rows, registry.fitted(rows, kind, TRAIN[kind], models.PARAMETERS)


def _eta_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The rows the ETA model was tested on, and whether it beats the mean."""
    _, found = _learned(spark, sf, "eta")
    return found.metrics.select("metric", "test_rows", F.col("skilled").alias("sound"))


def _cancel_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The rows the cancellation model was tested on, the AUC that their true risk has, and whether the model comes near.

    Both AUCs are rank sums, taken apart from the trainer's evaluator, which has to agree.
    """
    rows, found = _learned(spark, sf, "cancel")
    test = features.train_test_split(rows, seed=models.SEED, stratify="cancelled").where("is_test")
    scored = models.score_cancellation_risk(found.model, test)
    known, own = models.rank_auc(test, "risk", "cancelled"), models.rank_auc(scored, "cancellation_probability", "cancelled")
    sound = (own >= known - F.lit(AUC_SLACK)) & (F.abs(own - F.col("value")) < F.lit(0.01))
    return found.metrics.select("metric", "test_rows", known.alias("known_auc"), sound.alias("sound"))


def _scored(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Every order with a score: its part in the split, and whether the score lies in range and, on the mean of the
    orders of its group, near what was to be learned."""
    rows, found = _learned(spark, sf, kind)
    scored = SCORE[kind](found.model, rows)
    group, label = GROUP[kind]
    score = scored.columns[-1]
    means = scored.where(F.col(label).isNotNull()).groupBy(F.col(group).alias("group"))
    off = F.abs(F.avg(score) - F.avg(label)) > F.lit(GROUP_SLACK[kind])
    means = means.agg((~off | (F.count(F.lit(1)) < GROUP_ROWS)).alias("near"))
    split = features.train_test_split(rows.select("order_id", "cancelled"))
    in_range = F.col(score).between(*SCORE_RANGE[kind])
    checked = scored.join(means, F.col(group) == F.col("group"), "left")
    checked = checked.select("order_id", in_range.alias("in_range"), F.coalesce("near", F.lit(True)).alias("near"))
    return checked.join(split.select("order_id", "is_test"), "order_id")


def _score_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that meet the input rules are scored, by a model learned from such orders; the others keep their violations."""
    checked = quality.validate_order_features(src.order_features(spark, sf), src.TRAFFIC_LEVELS, src.WEATHER_LEVELS)
    keep = ("order_id", "eta_minutes", "cancelled", "violations")
    rows = features.model_features(checked, src.TRAFFIC_LEVELS, src.WEATHER_LEVELS, keep, strict=False)
    staged = staging.stage(rows, "features")
    checked, rows = staged.select("order_id", "violations"), staged.drop("violations")
    valid = rows.join(checked.where(F.size("violations") == 0).select("order_id"), "order_id", "left_semi")
    valid = staging.stage(valid, "valid")
    found = registry.fitted(valid, "eta", models.train_eta, models.PARAMETERS)
    scored = models.score_valid(found.model, checked, rows, models.score_eta)
    return scored.select(
        "order_id", F.array_join("violations", ",").alias("violations"),
        F.col("predicted_eta_minutes").isNotNull().alias("scored"),
    )


def _model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved, loaded and applied: every order gets the score of the model that was saved."""
    rows, found = _learned(spark, sf, "cancel")
    path = staging.fresh_path(spark, "model")
    models.save_model(found.model, path)
    both = [models.score_cancellation_risk(m, rows) for m in (found.model, models.load_model(path))]
    score = "cancellation_probability"
    again = both[1].select("order_id", F.col(score).alias("again"))
    return both[0].join(again, "order_id").select("order_id", F.col(score).eqNullSafe(F.col("again")).alias("same"))


def _model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Which of some tables a short model is fitted on: not on one whose rows it has met, in whatever order."""
    rows, folder = staging.stage(_features(spark, sf), "features"), staging.fresh_path(spark, "registry")
    tables = {
        "first": rows,
        "same rows in another order": rows.orderBy(F.desc("order_id")),
        "one row less": rows.where(F.col("order_id") != rows.agg(F.max("order_id")).scalar()),
        "one value changed": rows.withColumn("items", F.col("items") + (F.col("order_id") == 1).cast("int")),
        "first again": rows,
    }
    found = []
    for name, table in tables.items():
        fitted = registry.fitted(table, "eta", partial(models.train_eta, rounds=1), {"rounds": 1}, folder)
        found.append(fitted.metrics.select(F.lit(name).alias("table"), "test_rows", F.lit(fitted.fresh).alias("fitted")))
    return reduce(DataFrame.unionByName, found)


def _optional_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A data set without its optional tables: which are there, and how many rows they have."""
    path = staging.fresh_path(spark, "tables")
    for name, frame in {"orders": src.order_facts(spark, sf), "restaurants": src.restaurants(spark, sf)}.items():
        sinks.write_table(conform(frame, name), f"{path}/{name}.parquet")
    tables = load_parquet(spark, path)
    rows = [
        (tables[name].agg(F.count(F.lit(1)).alias("rows")) if name in tables else spark.range(1).select(F.lit(None).cast("long").alias("rows")))
        .select(F.lit(name).alias("name"), F.lit(name in tables).alias("present"), "rows")
        for name in SCHEMAS
    ]
    return reduce(DataFrame.unionByName, rows)


def _replaced_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view over delivered orders, replaced by one over all of them."""
    facts = src.order_facts(spark, sf)
    for frame in (facts.filter(M.delivered()), facts):
        TableSet(spark, {"replaced_orders": frame}).register()
    return spark.table("replaced_orders").groupBy("traffic").agg(F.count(F.lit(1)).alias("orders"))


def _replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of delivered orders is replaced by one of all orders while it is read; a third write fails half way.

    Orders by traffic level as the first reader sees them, and as the table shows them in the end.
    """
    name, folder = f"replaced_orders_{uuid.uuid4().hex}", staging.fresh_path(spark, "versions")
    facts = src.order_facts(spark, sf).select("order_id", "traffic", "delivered")
    versions.replace_table(facts.filter(M.delivered()), name, folder=folder)
    reader = spark.table(name)
    versions.replace_table(facts, name, folder=folder)
    unwritable = F.when(F.col("order_id") % 2 == 0, F.raise_error(F.lit("unwritable"))).otherwise(F.col("traffic"))
    try:
        versions.replace_table(facts.withColumn("traffic", unwritable), name, folder=folder)
    except PySparkException as failure:
        if "unwritable" not in str(failure):
            raise
    first = reader.groupBy("traffic").agg(F.count(F.lit(1)).alias("first_reader"))
    return spark.table(name).groupBy("traffic").agg(F.count(F.lit(1)).alias("orders")).join(first, "traffic", "left")


def _adhoc(spark: SparkSession, sf: str) -> DataFrame:
    tables = TableSet(spark, {"orders": src.order_facts(spark, sf), "restaurants": src.restaurants(spark, sf)})
    return tables.sql(
        """
        SELECT r.cuisine, count(*) AS orders, count(DISTINCT o.user_id) AS customers
        FROM orders o JOIN restaurants r USING (restaurant_id)
        WHERE o.eta_minutes <= :limit
        GROUP BY r.cuisine
        """,
        limit=45,
    )


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    """The data set written as CSV files, loaded from them and summarised."""
    path = staging.fresh_path(spark, "csv")
    frames = {"orders": src.order_facts(spark, sf), "restaurants": src.restaurants(spark, sf)}
    for name, frame in frames.items():
        sinks.write_table(conform(frame, name), f"{path}/{name}.csv", "csv")
    return restaurants.restaurant_performance(*map(load_csv(spark, path).__getitem__, ("orders", "restaurants")))


def _events_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Events written by day, and the funnel of some days, which opens their folders only."""
    path = staging.fresh_path(spark, "events")
    placed = journeys.journey_timeline(None, src.browse_sessions(spark, sf), src.restaurants(spark, sf), in_order=False)
    sinks.write_placed_by_day(placed, path, "event_ts", "session_id")
    events = spark.read.schema(SCHEMAS["events"]).parquet(path)
    return funnel.event_funnel(WEEK.apply(events, WEEK.bounds(events, "event_ts"), ts="event_ts"))


def _metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """Headline metrics written as JSON lines and read back."""
    path = staging.fresh_path(spark, "metrics")
    metrics = kpis.kpi_summary(src.order_facts(spark, sf))
    sinks.write_metrics(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


def _quarantined(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV with a broken value in some rows: which orders are loaded, and which are set apart."""
    path = staging.fresh_path(spark, "broken")
    orders = conform(src.order_facts(spark, sf), "orders")
    text = orders.select(*(F.col(c).cast("string").alias(c) for c in orders.columns))
    key = F.col("order_id").cast("long")
    broken = text.withColumns(
        {
            "eta_minutes": F.when(key % 50 == 1, F.lit("soon")).otherwise(F.col("eta_minutes")),
            "order_ts": F.when(key % 70 == 2, F.lit("2025-13-45 99:00:00")).otherwise(F.col("order_ts")),
            "user_id": F.when(key % 90 == 3, F.lit("99999999999999999999")).otherwise(F.col("user_id")),
        }
    )
    sinks.write_table(broken, f"{path}/orders.csv", "csv")
    sinks.write_table(conform(src.restaurants(spark, sf), "restaurants"), f"{path}/restaurants.csv", "csv")
    loaded, rejected = load_csv_checked(spark, path)
    kept = loaded["orders"].select("order_id", F.lit(True).alias("loaded"))
    first = F.split("line", ",")[0].cast("long").alias("order_id")
    return kept.unionByName(rejected.where("table = 'orders'").select(first, F.lit(False).alias("loaded")))


def _orders_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their value by the channel of their user; users of many orders are spread over tasks."""
    facts = src.order_facts(spark, sf).select("order_id", "user_id", "revenue")
    joined = spread.spread_join(facts, src.users(spark, sf), "user_id")
    return joined.groupBy("acquisition_channel").agg(M.orders().alias("orders"), M.gmv_all().alias("gmv"))


def _session_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    events = src.session_events(spark, sf)
    numbers = bitmaps.number_keys(events, "session_id")
    numbered = events.select("session_id", "event_ts", "event_name").join(numbers, "session_id")
    return staging.stage(bitmaps.daily_bitmaps(numbered, "number"), "bitmaps")


def _bitmap_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel of a week from stored bitmaps of sessions by day."""
    return bitmaps.funnel_from_bitmaps(_session_bitmaps(spark, sf), src.FUNNEL, WEEK.start, WEEK.end)


def _active_users(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users of each day and the six before it, from stored bitmaps of users by day."""
    events = src.session_events(spark, sf)
    daily = staging.stage(bitmaps.daily_bitmaps(events, "user_id", by=()), "bitmaps")
    return bitmaps.trailing_distinct(daily, 7, "active_users")


def _rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    """Daily parts kept for all days but the last, which is then added by a scan of its own orders."""
    name, folder = f"daily_parts_{uuid.uuid4().hex}", staging.fresh_path(spark, "rollup")
    facts = src.order_facts(spark, sf)
    last = src.order_dates(spark, sf).agg(F.max("order_ts")).first()[0]
    rollups.refresh(spark, name, facts.where(F.col("order_ts") < F.lit(last.date().isoformat()).cast("timestamp_ntz")), folder=folder)
    within = Period(last.date(), last.date())
    return rollups.refresh(spark, name, src.order_facts(spark, sf, within=within), [last.date()], folder)


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The order table from base tables that were written once, in buckets of the order."""
    raw = [src.table(spark, sf, name) for name in ("orders", "lineitem")]
    name, folder = f"base_{uuid.uuid4().hex}", staging.fresh_path(spark, "base")
    return src.facts_of(*base.write_base(*raw, name, buckets=8, folder=folder).load(spark))


QUERIES: dict[str, Query] = {
    # Headline and daily series
    "kpi_summary": _orders(kpis.kpi_summary),
    "daily_kpis": _orders(kpis.daily_kpis),
    "repeat_customer_rate": _orders(kpis.repeat_customer_rate),
    "rolling_7d_orders": _orders(kpis.rolling_7d_orders),
    "daily_trends_7d": _then(_orders(kpis.daily_trends_7d), rounded, "cancel_7d", "eta_7d"),
    "daily_kpis_rolled_up": _then(_rolled_up, rollups.daily_kpis),
    "kpi_summary_rolled_up": _then(_rolled_up, rollups.kpi_summary),
    "daily_kpis_bucketed": _then(_bucketed, kpis.daily_kpis),
    "peak_and_worst_day": _orders(kpis.peak_and_worst_day),
    "peak_hour_demand": _attempts(kpis.peak_hour_demand),
    "hourly_demand": _attempts(kpis.hourly_demand),
    # Scope and comparison
    "period_snapshot": _period(scope.period_snapshot, LAST_30),
    "period_snapshot_full": _catalogue(scope.period_snapshot),
    "period_over_period": _period(scope.period_over_period, LAST_30),
    "period_over_period_scoped": _period(scope.period_over_period, ASIA_URGENT),
    "filter_values": _catalogue(scope.filter_values),
    # Restaurants
    "restaurant_scorecard_sql": _orders(restaurants.restaurant_scorecard_sql),
    "restaurant_performance": _catalogue(restaurants.restaurant_performance),
    "top3_restaurants_by_cuisine": _catalogue(restaurants.top3_restaurants_by_cuisine),
    "restaurant_status": _catalogue(restaurants.restaurant_status),
    "restaurant_top30": _catalogue(restaurants.restaurant_top30),
    "top_n_restaurants": _orders(diagnostics.top_n_restaurants),
    # Customers and retention
    "rfm_segments": _orders(customers.rfm_segments),
    "behavioral_segments": _orders(customers.behavioral_segments),
    "customer_segments": _orders(customers.customer_segments),
    "orders_by_channel": _orders_by_channel,
    "customers_with_3plus_orders": _orders(customers.customers_with_orders),
    "cohort_retention": _orders(retention.cohort_retention),
    "cohort_retention_carry": _orders(retention.cohort_retention, users_as="retained_customers"),
    "cohort_by_week": _orders(retention.cohort_retention, grain="week"),
    "cohort_activity": _cohort_activity,
    "retention_by_segment": _retention_by_channel,
    # Funnel and journeys
    "event_funnel": _funnel,
    "event_funnel_scoped": _funnel_scoped,
    "funnel_from_bitmaps": _bitmap_funnel,
    "active_users_7d": _active_users,
    "journey_funnel": _journey_funnel,
    "funnel_display": _then(_funnel, funnel.label_stages, src.FUNNEL),
    "largest_leak": _then(_funnel, funnel.largest_leak),
    "order_journey_events": _order_events,
    "browse_session_events": _browse_events,
    "journey_union": _journeys,
    # Cancellations
    "cancellation_by_hour": _attempts(cancellations.cancellation_by, "hour"),
    "cancellation_by_traffic": _orders(cancellations.cancellation_by, "traffic"),
    "cancellation_by_restaurant": _orders(cancellations.cancellation_by, "restaurant_id", keep_null=True),
    "worst_cancellation_segment": _orders(cancellations.worst_cancellation_segment, "traffic"),
    "severity_impact_rank": _orders(cancellations.severity_impact_rank, "restaurant_id"),
    # Experiments
    "experiment_summary": _sessions(experiments.experiment_summary),
    "experiment_display": _sessions(experiments.experiment_display),
    "experiment_readout": _then(_sessions(experiments.experiment_readout), rounded, "z", "p_value"),
    "experiment_by_segment": _then(
        _by_channel(experiments.experiment_by_segment, "acquisition_channel"), rounded, "z", "p_value", "p_adjusted"
    ),
    "experiment_guardrails": _sessions(experiments.experiment_guardrails),
    "experiment_ci": _then(_sessions(experiments.experiment_ci), rounded, "ci_low", "ci_high"),
    "experiment_power": _by_channel(experiments.experiment_power, "acquisition_channel"),
    # Pricing
    "price_grid": _then(
        _products(pricing.price_grid), rounded, "price", "demand", "revenue", "contribution", places=4
    ),
    "optimize_price": _then(
        _products(pricing.optimize_price),
        rounded, "recommended_price", "expected_demand", "expected_revenue", "expected_contribution", places=4,
    ),
    # Derived columns and quality
    "order_time_features": _time_features,
    "surge_pricing": _surge,
    "eta_penalties": _penalties,
    "invariant_violations": _invariants,
    "validate_order_features": _order_validation,
    "validate_pricing_inputs": _pricing_validation,
    "grain_check": _grain,
    "join_fanout": _fanout,
    # What changed and why
    "wow_growth": _orders(diagnostics.wow_growth),
    "gmv_contribution": _orders(diagnostics.gmv_contribution, "traffic"),
    "rate_change_contribution": _then(
        _orders(diagnostics.rate_change_contribution, "traffic"), rounded, "contribution_pp", "mix_pp", "rate_pp"
    ),
    "gmv_decomposition": _then(
        _period(diagnostics.gmv_decomposition, LAST_90), rounded, "volume_effect", "aov_effect"
    ),
    # Sources and sinks
    "adhoc_sql": _adhoc,
    "csv_round_trip": _csv,
    "csv_quarantine": _quarantined,
    "events_by_day": _events_by_day,
    "metrics_json": _metrics_json,
    "optional_tables": _optional_tables,
    "replaced_table": _replaced_table,
    "replaced_view": _replaced_view,
    # Models
    "model_features": _features,
    "train_test_split": _split,
    "train_test_split_stratified": partial(_split, stratify="cancelled"),
    "eta_model_metrics": _eta_metrics,
    "cancel_model_metrics": _cancel_metrics,
    "score_eta": partial(_scored, kind="eta"),
    "score_cancellation_risk": partial(_scored, kind="cancel"),
    "score_validated": _score_validated,
    "model_round_trip": _model_round_trip,
    "model_registry": _model_registry,
}
