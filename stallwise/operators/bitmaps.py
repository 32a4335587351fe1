"""Distinct counts over any period from stored bitmaps.

Distinct counts don't add up over days, bitmaps do: a day's users (or sessions) at a stage
are a set of bits, and those of a period are the union of its days' sets. So a table of
bitmaps by day and stage answers every period without reading an event.

Keys become numbers once. Whole numbers may serve as they are; others get one each in the
order of their first day (``number_keys``), so that a day's keys lie close together and fill few
bitmaps. A bitmap holds 32,768 numbers in 4 KB; a day's row count is bounded by its keys, and
a period's union by the bitmaps of its days, merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.funnel import conversions
from stallwise.sources.schemas import STAGES
from stallwise.sources.staging import stage

BITS = 32_768  # of a bitmap


def number_keys(events: DataFrame, key: str, ts: str = "event_ts", known: DataFrame | None = None) -> DataFrame:
    """Staged ``key, number``: a number for every key, after those ``known`` already.

    New keys are numbered in the order of their first day. Numbers have gaps between partitions.
    """
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.to_date(ts)).alias("first_day"))
    if known is None:
        base = 0
    else:
        first = first.join(known.select(key), key, "left_anti")
        highest = known.agg(F.max("number")).first()[0]
        base = 0 if highest is None else (highest // BITS + 1) * BITS
    ordered = first.repartitionByRange("first_day", key).sortWithinPartitions("first_day", key)
    # Within a partition numbers follow each other.
    fresh = stage(ordered.select(key, (F.monotonically_increasing_id() + F.lit(base + 1)).alias("number")), "numbers")
    return fresh if known is None else known.select(key, "number").unionByName(fresh)


def daily_bitmaps(events: DataFrame, number: str, ts: str = "event_ts", by: Sequence[str] = ("event_name",)) -> DataFrame:
    """``day``, the columns ``by``, ``bucket`` and ``bitmap``: the numbers met on each day."""
    known = events.where(F.col(number).isNotNull() & F.col(ts).isNotNull())
    keys = [F.to_date(ts).alias("day"), *by, F.bitmap_bucket_number(number).alias("bucket")]
    return known.groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def _between(first: date | None, last: date | None) -> Column:
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("day") >= F.lit(first))
    if last is not None:
        inside = inside & (F.col("day") <= F.lit(last))
    return inside


def distinct_counts(
    bitmaps: DataFrame, by: Sequence[str] = (), first: date | None = None, last: date | None = None, name: str = "keys"
) -> DataFrame:
    """Distinct numbers in a period (both ends included), over all stages or by some columns."""
    union = bitmaps.where(_between(first, last)).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return union.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0).cast("long")).alias(name))


def trailing_distinct(bitmaps: DataFrame, days: int = 7, name: str = "keys") -> DataFrame:
    """For every day of the table, distinct numbers of it and the days before, ``days`` in all."""
    known = bitmaps.select("day").distinct()
    daily = bitmaps.groupBy("day", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    reached = daily.select(F.col("day").alias("from_day"), "bucket", "bitmap", ahead.alias("ahead"))
    reached = reached.select(F.date_add("from_day", F.col("ahead")).alias("day"), "bucket", "bitmap")
    return distinct_counts(reached.join(known, "day", "left_semi"), by=("day",), name=name)


def funnel_from_bitmaps(
    bitmaps: DataFrame, stages: Mapping[str, str] | Sequence[str] = tuple(STAGES), first: date | None = None, last: date | None = None
) -> DataFrame:
    """``funnel.event_funnel`` of a period, from session bitmaps by day and event name."""
    counts = distinct_counts(bitmaps.where(F.col("event_name").isin(list(stages))), ("event_name",), first, last, "sessions")
    # One row for all stages, with zeros for those nobody reached.
    found = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("stage"),
                F.coalesce(F.sum(F.when(F.col("event_name") == name, F.col("sessions"))), F.lit(0).cast("long")).alias("sessions"),
            )
            for i, name in enumerate(stages)
        )
    )
    return conversions(counts.agg(found.alias("stages")).select(F.inline("stages")))
