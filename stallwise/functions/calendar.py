"""Calendar columns.

Everything goes through DATE, which has no time zone, so results do not depend
on the session's zone (``date_trunc`` on a zone-less timestamp would).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallwise.functions.numeric import col

# weekday() counts Monday as 0; lunch and dinner peaks, both ends included.
SATURDAY = 5
PEAK_HOURS = ((12, 14), (19, 22))


def day(ts: Column | str) -> Column:
    """Timestamp cut to its day."""
    return F.to_date(col(ts)).cast("timestamp_ntz")


def period_date(ts: Column | str, grain: str) -> Column:
    """First date of the timestamp's ``week``, ``month``, ``quarter`` or ``year``."""
    return F.trunc(col(ts).cast("date"), grain)


def period_start(ts: Column | str, grain: str) -> Column:
    """Timestamp cut to the start of its period."""
    return period_date(ts, grain).cast("timestamp_ntz")


def periods_between(start: Column, end: Column, grain: str) -> Column:
    """Whole periods from one period start to another."""
    if grain == "week":
        return (F.datediff(end, start) / F.lit(7)).cast("long")
    months = (F.year(end) - F.year(start)) * F.lit(12) + F.month(end) - F.month(start)
    per = {"month": 1, "quarter": 3, "year": 12}[grain]
    return (months / F.lit(per)).cast("long")


def month_label(ts: Column | str) -> Column:
    return F.date_format(F.to_date(col(ts)), "yyyy-MM")


def hour(ts: Column | str) -> Column:
    return F.hour(col(ts)).cast("long")


def weekend(ts: Column | str) -> Column:
    return (F.weekday(col(ts)) >= SATURDAY).cast("int")


def peak(hour_of_day: Column | str) -> Column:
    h = col(hour_of_day)
    (a, b), (c, d) = PEAK_HOURS
    return (h.between(a, b) | h.between(c, d)).cast("int")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch as a long that orders like the timestamp."""
    elapsed = col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (elapsed.cast("decimal(20,6)") * F.lit(1_000_000)).cast("long")


def plus_minutes(ts: Column | str, minutes: Column) -> Column:
    return col(ts) + F.make_dt_interval(mins=minutes)
