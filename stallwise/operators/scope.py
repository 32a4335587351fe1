"""Analysis scope: period, cuisine and traffic filters, and period comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions import measures as M
from stallwise.functions.numeric import money, ratio
from stallwise.sources.schemas import DAY_COLUMNS

ALL = "All"
# Days covered by the rolling presets.
PRESET_DAYS = {"last_30_days": 30, "last_90_days": 90}
RATES = ("cancel", "delivery", "sla")
AMOUNTS = ("orders", "gmv", "aov")


@dataclass(frozen=True)
class Scope:
    """What part of the data an analysis looks at.

    ``period`` is ``last_30_days``, ``last_90_days``, ``full`` or ``custom``
    (with ``start`` and ``end``, both included). Rolling presets end on the last
    date present in the table and never begin before its first.
    """

    period: str = "full"
    start: date | None = None
    end: date | None = None
    cuisine: str = ALL
    traffic: str = ALL

    def __post_init__(self) -> None:
        if self.period == "custom":
            if self.start is None or self.end is None:
                raise ValueError("a custom period needs start and end")
        elif self.period != "full" and self.period not in PRESET_DAYS:
            raise ValueError(f"unknown period {self.period!r}")

    def bounds(self, orders: DataFrame, ts: str = "order_ts") -> Period:
        """First and last date of the period.

        The rolling presets look up the table's first and last date, two values,
        so that every filter made from them is a literal the scans can push down
        and prune by. The other periods need no look at the data.
        """
        if self.period == "custom":
            return Period(self.start, self.end)
        if self.period == "full":
            return Period()
        return self._between(orders, ts)

    def _between(self, orders: DataFrame, ts: str) -> Period:
        """The period cut to the dates present in the table."""
        day = DAY_COLUMNS.get(ts)
        # A table written by day knows its dates without reading any column.
        at = day if day in orders.columns else ts
        first, last = orders.agg(F.to_date(F.min(at)), F.to_date(F.max(at))).first()
        if last is None:
            return Period(empty=True)
        if self.period in PRESET_DAYS:
            first = max(first, last - timedelta(days=PRESET_DAYS[self.period] - 1))
        return Period(first, last)

    def pinned(self, orders: DataFrame) -> Scope:
        """The same scope with the dates it has on the orders fixed.

        Several analyses then look them up once, and other tables are cut to the
        dates of the orders, also by the full period.
        """
        if self.period == "custom":
            return self
        period = self._between(orders, "order_ts")
        return self if period.empty else replace(self, period="custom", start=period.first, end=period.last)

    def apply(
        self, facts: DataFrame, period: Period | None, restaurants: DataFrame | None = None, ts: str = "order_ts"
    ) -> DataFrame:
        """Rows in scope. The cuisine comes from the facts if they carry it, else from the restaurants."""
        if period is not None:
            facts = period.filter(facts, ts)
        if self.traffic != ALL:
            facts = facts.filter(F.col("traffic") == self.traffic)
        if self.cuisine != ALL:
            if "cuisine" in facts.columns:
                facts = facts.filter(F.col("cuisine") == self.cuisine)
            else:
                facts = facts.join(cuisine_members(restaurants, self.cuisine), "restaurant_id", "left_semi")
        return facts

    def filter(self, orders: DataFrame, restaurants: DataFrame | None = None) -> DataFrame:
        """Orders of the scope's own period."""
        return self.apply(orders, self.bounds(orders), restaurants)


@dataclass(frozen=True)
class Period:
    """Two dates, both included; without dates all of time, or none of it."""

    first: date | None = None
    last: date | None = None
    empty: bool = False

    def contains(self, ts: Column | str) -> Column:
        """A range on the raw timestamp, so that scans can skip files and row groups."""
        ts = F.col(ts) if isinstance(ts, str) else ts
        if self.empty:
            return F.lit(False)
        if self.first is None:
            return ts.isNotNull()
        return (ts >= _midnight(self.first)) & (ts < _midnight(self.last + timedelta(days=1)))

    def filter(self, facts: DataFrame, ts: str) -> DataFrame:
        """Rows of the period; where the table is written by day, other days are not even opened."""
        day = DAY_COLUMNS.get(ts)
        if self.first is not None and day in facts.columns:
            facts = facts.filter(F.col(day).between(F.lit(self.first), F.lit(self.last)))
        return facts.filter(self.contains(ts))

    def previous(self) -> Period:
        """The period of the same length that ends the day before. Nothing precedes all of time."""
        if self.empty or self.first is None:
            return Period(empty=True)
        return Period(self.first - (self.last - self.first) - timedelta(days=1), self.first - timedelta(days=1))

    def with_previous(self) -> Period:
        """Both periods, which adjoin, as one range."""
        before = self.previous()
        return self if before.empty else Period(before.first, self.last)


def _midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def cuisine_members(restaurants: DataFrame | None, cuisine: str) -> DataFrame:
    if restaurants is None:
        raise ValueError("filtering orders by cuisine needs the restaurants")
    return restaurants.filter(F.col("cuisine") == cuisine).select("restaurant_id")


def filter_values(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """The values each dimension filter can take, sorted."""
    cuisines = restaurants.select(F.lit("cuisine").alias("dimension"), F.col("cuisine").alias("value"))
    traffic = orders.select(F.lit("traffic").alias("dimension"), F.col("traffic").alias("value"))
    return cuisines.distinct().unionByName(traffic.distinct()).orderBy("dimension", "value")


def _additive(where: Column, prefix: str, sla: float) -> list[Column]:
    """Sums and counts a snapshot is made from; they add up over any split of the rows."""
    return [
        F.count_if(where).alias(f"{prefix}orders"),
        M.delivered_cents(where).alias(f"{prefix}cents"),
        M.delivered_orders(where).alias(f"{prefix}delivered"),
        F.count_if(where & (F.col("cancelled") == 1)).alias(f"{prefix}cancelled"),
        F.count_if(where & M.on_time(sla)).alias(f"{prefix}on_time"),
    ]


def _snapshot(prefix: str) -> dict[str, Column]:
    """Snapshot metrics from the sums. AOV and SLA are 0 when nothing was delivered."""

    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    zero = F.lit(0.0)
    return {
        "orders": c("orders"),
        "gmv": money(c("cents")),
        "aov": F.coalesce(ratio(money(c("cents")), c("delivered")), zero),
        "cancel": ratio(c("cancelled"), c("orders")) * F.lit(100.0),
        "delivery": ratio(c("delivered"), c("orders")) * F.lit(100.0),
        "sla": F.coalesce(ratio(c("on_time"), c("delivered")) * F.lit(100.0), zero),
    }


def _totals(facts: DataFrame, sums: list[Column], scope: Scope, restaurants: DataFrame | None) -> DataFrame:
    """One row of sums over the rows of the scope's cuisine and traffic.

    With a cuisine filter the orders are summed per restaurant first and joined
    then, so a restaurant with a third of all orders joins as a single row.
    """
    by_restaurant = scope.cuisine != ALL and "cuisine" not in facts.columns
    narrowed = Scope(traffic=scope.traffic, cuisine=ALL if by_restaurant else scope.cuisine).apply(facts, None)
    if not by_restaurant:
        return narrowed.agg(*sums)
    partial = narrowed.groupBy("restaurant_id").agg(*sums)
    names = [c for c in partial.columns if c != "restaurant_id"]
    members = cuisine_members(restaurants, scope.cuisine)
    return partial.join(members, "restaurant_id", "left_semi").agg(
        *(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names)
    )


def period_snapshot(
    orders: DataFrame, restaurants: DataFrame | None = None, scope: Scope = Scope(), sla: float = M.SLA_MINUTES
) -> DataFrame:
    """Orders, GMV, AOV, cancellation, delivery and on-time rate of one period.

    The on-time rate is over delivered orders.
    """
    rows = scope.bounds(orders).filter(orders, "order_ts")
    totals = _totals(rows, _additive(F.lit(True), "", sla), scope, restaurants)
    return totals.select(*(value.alias(name) for name, value in _snapshot("").items()))


def period_totals(orders: DataFrame, restaurants: DataFrame | None, scope: Scope, sla: float) -> DataFrame:
    """One row of sums for a period and, prefixed ``prev_``, the one before.

    Both periods are one range of time, read in one pass and told apart by their start.
    """
    current = scope.bounds(orders)
    rows = current.with_previous().filter(orders, "order_ts").withColumn("is_current", current.contains("order_ts"))
    sums = _additive(F.col("is_current"), "", sla) + _additive(~F.col("is_current"), "prev_", sla)
    return _totals(rows, sums, scope, restaurants)


def period_over_period(
    orders: DataFrame, restaurants: DataFrame | None = None, scope: Scope = Scope(), sla: float = M.SLA_MINUTES
) -> DataFrame:
    """The snapshot of a period, of the one before, and the change between them.

    Amounts change in percent (null without a previous value), rates in
    percentage points. An empty previous period leaves its columns null.
    """
    now, before = _snapshot(""), _snapshot("prev_")
    has_previous = F.col("prev_orders") > 0
    wide = period_totals(orders, restaurants, scope, sla).select(
        *(value.alias(name) for name, value in now.items()),
        *(F.when(has_previous, value).alias(f"prev_{name}") for name, value in before.items()),
    )
    return wide.select(
        "*",
        *(
            ((ratio(F.col(k), F.col(f"prev_{k}")) - F.lit(1.0)) * F.lit(100.0)).alias(f"{k}_delta_pct")
            for k in AMOUNTS
        ),
        *((F.col(k) - F.col(f"prev_{k}")).alias(f"{k}_delta_pp") for k in RATES),
    )
