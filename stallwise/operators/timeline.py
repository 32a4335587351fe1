"""Events of many sessions in time order, shuffled as sessions.

Sorting an event table moves every event. Here the sessions move instead, each as one row
to each range of time that one of its events falls into: with events minutes apart and
ranges of hours that is one range for all but the few sessions at a bound. Events are made
inside the range that owns them and sorted there.

Ranges are cut by (event time, session), so a moment that a third of all events share is
cut as well. Bounds in time are percentiles of the events' times, found in one pass over the
sessions' times and ids; a moment that fills several ranges is cut at ids of about ``DRAWN``
events a range, drawn by a hash, whatever the table's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.calendar import plus_minutes

DRAWN = 60
HASHES = 1 << 20

Stages = Mapping[str, int]  # event name -> minutes from the session's time


def sessions(
    frame: DataFrame, session_id: Column, at: str, kind: int, reached: Sequence[Column | None], keep: Sequence[str]
) -> DataFrame:
    """Sessions in the form that ``ordered_events`` takes: whether stage i was reached is bit i of ``stages``.

    A stage without a column is always reached.
    """
    bits = (
        F.lit(1 << i) if flag is None else F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
        for i, flag in enumerate(reached)
    )
    stages = F.lit(0)
    for bit in bits:
        stages = stages.bitwiseOR(bit)
    return frame.select(
        session_id.alias("session_id"), F.col(at).alias("at"), F.lit(kind).alias("kind"), stages.alias("stages"), *keep
    )


def _events(kinds: Sequence[Stages]) -> str:
    """The stages of a session as an array: time, name, and whether there is such an event.

    As SQL text: one expression to parse instead of dozens of column calls.
    """

    def of(stages: Stages) -> str:
        structs = (
            f"named_struct('event_ts', at + make_dt_interval(0, 0, {minutes}), 'event_name', {_quoted(name)},"
            f" 'reached', stages & {1 << i} > 0)"
            for i, (name, minutes) in enumerate(stages.items())
        )
        return f"array({', '.join(structs)})"

    whens = " ".join(f"WHEN {k} THEN {of(stages)}" for k, stages in enumerate(kinds))
    return f"CASE kind {whens} END"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _bounds(times: DataFrame, kinds: Sequence[Stages], ranges: int) -> list[tuple[datetime, str]]:
    """First event of the second, third, ... range, as time and session id."""
    events = times.select("session_id", F.expr(f"inline({_events(kinds)})"))
    events = events.where("reached AND event_ts IS NOT NULL AND session_id IS NOT NULL")
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    cuts = F.percentile_approx("event_ts", shares, max(10_000, DRAWN * ranges))
    found = events.agg(cuts.alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    moments = Counter(found.cuts or ())
    bounds = [(moment, "") for moment, n in moments.items() if n == 1]
    # A moment with several cuts is cut by session, at the ids of some of its events.
    hot = {moment: n for moment, n in moments.items() if n > 1}
    if hot:
        drawn = F.pmod(F.xxhash64("session_id"), F.lit(HASHES)) < F.lit(int(min(DRAWN * ranges / found.n, 1.0) * HASHES) + 1)
        ids: dict[datetime, list[str]] = {moment: [] for moment in hot}
        for row in events.where(F.col("event_ts").isin(list(hot)) & drawn).select("event_ts", "session_id").collect():
            ids[row.event_ts].append(row.session_id)
        for moment, n in hot.items():
            known = sorted(ids[moment])
            bounds += [(moment, known[len(known) * k // (n + 1)]) for k in range(1, n + 1) if known]
    return sorted(set(bounds))


class _Ranges:
    """Ranges of events by their bounds, as columns."""

    def __init__(self, bounds: Sequence[tuple[datetime, str]]):
        self.moments = F.lit([at.isoformat(" ") for at, _ in bounds]).cast("array<timestamp_ntz>")
        self.ids = F.lit([one for _, one in bounds]).cast("array<string>")
        self.steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))]).cast("array<int>")

    def reaches(self, bound: Column, ts: Column) -> Column:
        """Whether an event is at a bound or after it; false for bounds that don't exist."""
        moment = F.get(self.moments, bound)
        after = (moment < ts) | ((moment == ts) & (F.get(self.ids, bound) <= F.col("session_id")))
        return F.coalesce(after, F.lit(False))

    def of(self, ts: Column) -> Column:
        """The range of an event: how many bounds are not after it, found by bisection."""
        return F.aggregate(
            self.steps, F.lit(0), lambda at, step: F.when(self.reaches(at + step - F.lit(1), ts), at + step).otherwise(at)
        )


def placed_events(
    sessions: DataFrame, kinds: Sequence[Stages], times: DataFrame | None = None, ranges: int | None = None
) -> DataFrame:
    """All events of the sessions, in partitions that follow (event_ts, session_id); unordered inside.

    ``sessions`` come from ``sessions`` of this module, ``kinds`` gives each kind's stages. ``times`` may hold the
    same sessions without columns that take joins to make. Events without a time come first.
    """
    spark = sessions.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(sessions if times is None else times, kinds, ranges)
    others = [c for c in sessions.columns if c not in ("at", "kind", "stages")]

    def end(which) -> Column:
        """The time of the first or last event that the session may have."""
        minutes = F.when(F.col("kind") == 0, F.lit(which(kinds[0].values())))
        for k, stages in enumerate(kinds[1:], 1):
            minutes = minutes.when(F.col("kind") == k, F.lit(which(stages.values())))
        return plus_minutes("at", minutes)

    ranges_of = _Ranges(bounds)
    low, whole, own_range = "_first_range", "_in_one_range", "_range"
    reached = F.filter(F.expr(_events(kinds)), lambda e: e["reached"])
    each = F.transform(reached, lambda e: ranges_of.of(e["event_ts"]))
    rows = sessions.withColumn(low, ranges_of.of(end(min)))
    rows = rows.withColumn(whole, ~ranges_of.reaches(F.col(low), end(max)))
    touched = F.when(F.col(whole), F.array(low)).otherwise(F.array_distinct(each))
    # Outer, as a plain explode would test every array for rows once more, at the scan.
    rows = rows.select(*sessions.columns, whole, F.explode_outer(touched).alias(own_range))
    rows = rows.where(F.col(own_range).isNotNull()).repartitionById(len(bounds) + 1, F.col(own_range))
    events = rows.select(*others, whole, own_range, F.expr(f"inline({_events(kinds)})")).where("reached")
    own = F.col(whole) | (ranges_of.of(F.col("event_ts")) == F.col(own_range))
    return events.where(own).drop(whole, own_range, "reached")


def ordered_events(
    sessions: DataFrame, kinds: Sequence[Stages], times: DataFrame | None = None, ranges: int | None = None
) -> DataFrame:
    """All events of the sessions in (event_ts, session_id) order, across and inside partitions."""
    placed = placed_events(sessions, kinds, times, ranges)
    return placed.sortWithinPartitions("event_ts", "session_id")
