"""Event funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.labels import lookup
from stallwise.functions.numeric import ratio
from stallwise.sources.schemas import STAGES

BITS = 63  # stages that one long holds


def event_funnel(events: DataFrame, stages: Mapping[str, str] | Sequence[str] = tuple(STAGES)) -> DataFrame:
    """Distinct sessions per stage in the given order.

    The funnel is open: a session counts at every stage it has an event for,
    whatever came before, so a conversion can exceed 100 %. A stage nobody
    reached has 0 sessions. Conversion is against the stage before: 100 at the
    first stage and for 0 of 0, null for some of 0.
    """
    names = list(stages)
    groups = [names[i : i + BITS] for i in range(0, len(names), BITS)]
    bits = [
        lookup("event_name", {name: 1 << i for i, name in enumerate(group)}, 0).cast("long").alias(f"bits{k}")
        for k, group in enumerate(groups)
    ]
    # A session becomes one row with a bit per stage, merged before the shuffle;
    # counting bits then needs no DISTINCT.
    sessions = (
        events.filter(F.col("event_name").isin(names) & F.col("session_id").isNotNull())
        .select("session_id", *bits)
        .groupBy("session_id")
        .agg(*(F.bit_or(f"bits{k}").alias(f"reached{k}") for k in range(len(groups))))
    )
    # The global aggregate yields its row, with zeros, even without events.
    counts = sessions.agg(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(name).alias("stage"),
                    F.count_if(F.getbit(f"reached{i // BITS}", F.lit(i % BITS)) == 1).alias("sessions"),
                )
                for i, name in enumerate(names)
            )
        ).alias("stages")
    )
    return conversions(counts.select(F.inline("stages")))


def conversions(counted: DataFrame) -> DataFrame:
    """``position, stage, sessions`` with the conversions from the stage before and from the first one."""
    # One row per stage.
    order = Window.orderBy("position")
    n, before = F.col("sessions"), F.lag("sessions").over(order)
    conversion = (
        F.when(before.isNull() | ((n == 0) & (before == 0)), F.lit(100.0)).otherwise(ratio(n, before) * F.lit(100.0))
    )
    return (
        counted.withColumn("conversion", conversion)
        .withColumn("drop_off", F.lit(100.0) - F.col("conversion"))
        .withColumn(
            "overall_conversion",
            ratio(n, F.first("sessions").over(order.rowsBetween(Window.unboundedPreceding, 0))) * F.lit(100.0),
        )
        .orderBy("position")
    )


def label_stages(funnel: DataFrame, labels: Mapping[str, str] = STAGES) -> DataFrame:
    """Funnel with stage labels in place of event names, rounded for display."""
    return funnel.select(
        "position",
        lookup("stage", labels).alias("stage"),
        "sessions",
        *(F.round(c, 1).alias(c) for c in ("conversion", "drop_off", "overall_conversion")),
    )


def largest_leak(funnel: DataFrame) -> DataFrame:
    """The stage after the first that keeps the smallest share of the one before."""
    return (
        funnel.filter((F.col("position") > 0) & F.col("conversion").isNotNull())
        .orderBy("conversion", "position")
        .limit(1)
        .select("stage", "sessions", "conversion", "drop_off")
    )
