"""The analyses of a data set in one scope, each by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame

from stallwise.operators import cancellations, customers, experiments, funnel, kpis, restaurants, retention, scope
from stallwise.operators.scope import Scope
from stallwise.sources.staging import stage
from stallwise.sources.tables import MissingTable, TableSet

Report = Callable[[], DataFrame]


def reports(tables: TableSet, within: Scope = Scope("last_30_days")) -> dict[str, Report]:
    """Every report of the scope, computed when called.

    Reports over optional tables raise MissingTable when called without them.
    Orders are filtered by the scope, and events by the same dates.
    """
    orders, catalogue = tables["orders"], tables["restaurants"]
    within = within.pinned(orders)
    period = within.bounds(orders)

    @cache
    def scoped() -> DataFrame:
        """The orders in scope, written once for all reports that read them."""
        return stage(within.apply(orders, period, catalogue), "scoped")

    def in_scope_funnel() -> DataFrame:
        return funnel.event_funnel(within.apply(tables["events"], period, ts="event_ts"))

    return {
        "period_over_period": lambda: scope.period_over_period(orders, catalogue, within),
        "filter_values": lambda: scope.filter_values(orders, catalogue),
        "daily_trends_7d": lambda: kpis.daily_trends_7d(scoped()),
        "peak_and_worst_day": lambda: kpis.peak_and_worst_day(scoped()),
        "event_funnel": lambda: funnel.label_stages(in_scope_funnel()),
        "largest_leak": lambda: funnel.largest_leak(in_scope_funnel()),
        "hourly_demand": lambda: kpis.hourly_demand(scoped()),
        "restaurant_status": lambda: restaurants.restaurant_status(scoped(), catalogue),
        "restaurant_top30": lambda: restaurants.restaurant_top30(scoped(), catalogue),
        "behavioral_segments": lambda: customers.behavioral_segments(scoped()),
        "cohort_activity": lambda: retention.cohort_activity(scoped()),
        "cancellation_by_hour": lambda: cancellations.cancellation_by(scoped(), "hour"),
        "cancellation_by_traffic": lambda: cancellations.cancellation_by(scoped(), "traffic"),
        "worst_cancellation_segment": lambda: cancellations.worst_cancellation_segment(scoped(), "traffic"),
        "experiment_summary": lambda: experiments.experiment_summary(tables["experiments"]),
        "experiment_readout": lambda: experiments.experiment_readout(tables["experiments"]),
    }


def sql_pack(tables: TableSet) -> dict[str, Report]:
    """The unscoped queries over all orders."""
    orders, catalogue = tables["orders"], tables["restaurants"]
    return {
        "kpi_summary": lambda: kpis.kpi_summary(orders),
        "daily_kpis": lambda: kpis.daily_kpis(orders),
        "repeat_customer_rate": lambda: kpis.repeat_customer_rate(orders),
        "restaurant_scorecard": lambda: restaurants.restaurant_scorecard_sql(orders),
        "restaurant_performance": lambda: restaurants.restaurant_performance(orders, catalogue),
        "peak_hour_demand": lambda: kpis.peak_hour_demand(orders),
        "cohort_retention": lambda: retention.cohort_retention(orders),
        "rolling_7d_orders": lambda: kpis.rolling_7d_orders(orders),
        "top3_restaurants_by_cuisine": lambda: restaurants.top3_restaurants_by_cuisine(orders, catalogue),
        "customer_segments": lambda: customers.rfm_segments(orders),
    }


def register(frames: dict[str, Report], prefix: str = "") -> list[str]:
    """Expose reports as temp views, so SQL can select from them; those lacking a table are skipped."""
    names = []
    for name, make in frames.items():
        try:
            make().createOrReplaceTempView(prefix + name)
        except MissingTable:
            continue
        names.append(prefix + name)
    return names
