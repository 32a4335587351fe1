"""Named marketplace measures as aggregate columns.

Two families of the same metric are in use and differ on purpose: ``*_all``
divides by every order, ``*_delivered`` by completed orders only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallwise.functions.numeric import cents, money, ratio

SLA_MINUTES = 45


def delivered() -> Column:
    return F.col("delivered") == 1


def on_time(sla: float) -> Column:
    """Delivered within the limit; an order without an ETA is not on time."""
    return delivered() & F.coalesce(F.col("eta_minutes") <= F.lit(sla), F.lit(False))


def orders() -> Column:
    return F.count(F.lit(1))


def delivered_orders(where: Column | None = None) -> Column:
    return F.count_if(delivered() if where is None else where & delivered())


def delivered_cents(where: Column | None = None) -> Column:
    """Delivered revenue in cents, 0 over no rows."""
    keep = delivered() if where is None else where & delivered()
    return F.coalesce(F.sum(F.when(keep, cents("revenue")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


def gmv_delivered() -> Column:
    return money(delivered_cents())


def gmv_all() -> Column:
    return money(F.sum(cents("revenue")))


def aov() -> Column:
    """Value per delivered order, null when nothing was delivered."""
    return ratio(gmv_delivered(), delivered_orders())


def revenue_per_order() -> Column:
    """Delivered value spread over all orders."""
    return ratio(gmv_delivered(), orders())


def cancellation_pct() -> Column:
    return F.avg("cancelled") * F.lit(100.0)


def delivery_pct() -> Column:
    return F.avg("delivered") * F.lit(100.0)


def sla_pct_all(sla: float = SLA_MINUTES) -> Column:
    return F.avg(on_time(sla).cast("int")) * F.lit(100.0)


def sla_pct_delivered(sla: float = SLA_MINUTES) -> Column:
    return ratio(F.count_if(on_time(sla)), delivered_orders()) * F.lit(100.0)


def avg_eta() -> Column:
    return F.avg("eta_minutes")
