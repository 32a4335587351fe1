from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.functions import calendar, labels, numeric


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("x", [-8.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 4.0])
def test_normal_cdf(spark, x):
    exact = 0.5 * (1 + math.erf(x / math.sqrt(2)))
    assert value(spark, numeric.normal_cdf(F.lit(x))) == pytest.approx(exact, abs=1e-7)


def test_half_up_rounds_digits(spark):
    assert value(spark, numeric.half_up(F.lit(1.005), 2)) == 1.01
    assert value(spark, numeric.half_up(F.lit(-2.345), 2)) == -2.35


def test_cents_of_inexact_doubles(spark):
    assert value(spark, numeric.cents(F.lit(0.29))) == 29
    assert value(spark, numeric.cents(F.lit(1.15) * F.lit(3.0))) == 345


def test_ratio_by_zero_is_null(spark):
    assert value(spark, numeric.ratio(F.lit(1), F.lit(0))) is None


def test_long_ids_keep_their_digits(spark):
    assert value(spark, labels.padded_id("S", F.lit(42))) == "S0000042"
    assert value(spark, labels.padded_id("S", F.lit(123456789))) == "S123456789"


def test_unknown_category_fails(spark):
    with pytest.raises(Exception, match="unknown category: Fog"):
        value(spark, labels.ordinal(F.lit("Fog"), {"Clear": 0}))


def test_lookup_default(spark):
    assert value(spark, labels.lookup(F.lit("x"), {"a": 1})) is None
    assert value(spark, labels.lookup(F.lit("x"), {"a": 1}, 0)) == 0


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_calendar(spark):
    assert value(spark, calendar.day(ts("2025-03-09 23:59:59"))) == datetime(2025, 3, 9)
    assert value(spark, calendar.period_start(ts("2025-03-09 23:59:59"), "month")) == datetime(2025, 3, 1)
    assert value(spark, calendar.period_start(ts("2025-03-09 23:59:59"), "week")) == datetime(2025, 3, 3)
    assert [value(spark, calendar.weekend(ts(f"2025-03-0{d}"))) for d in (7, 8, 9)] == [0, 1, 1]
    assert [value(spark, calendar.peak(F.lit(h))) for h in (11, 12, 14, 15, 19, 22, 23)] == [0, 1, 1, 0, 1, 1, 0]
    months = calendar.periods_between(ts("2024-11-01"), ts("2025-02-01"), "month")
    assert value(spark, months) == 3


def test_micros_orders_like_the_timestamp_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        # The clock hour 02:30 does not exist there on this day.
        times = ["2025-03-30 02:30:00.000001", "2025-03-30 03:00:00", "1969-12-31 23:59:59.5"]
        got = [value(spark, calendar.micros(ts(t))) for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    epoch = datetime(1970, 1, 1)
    assert got == [round((datetime.fromisoformat(t) - epoch).total_seconds() * 1_000_000) for t in times]
