"""Events in time order, shuffled as sessions: same rows and order as a sort of the events."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallwise.operators import journeys, timeline
from stallwise.plans.workload import QUERIES

START = datetime(2025, 1, 1)
KINDS = ({"begin": -5, "middle": -2, "end": 0}, {"look": 0, "it's": 4})
SCHEMA = "id string, at timestamp_ntz, a boolean, b boolean, n bigint"


def made(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    first = timeline.sessions(frame.where("n % 2 = 0"), F.col("id"), "at", 0, [None, F.col("a"), F.col("b")], ["n"])
    second = timeline.sessions(frame.where("n % 2 = 1"), F.col("id"), "at", 1, [F.col("a"), F.col("b")], ["n"])
    return first.unionByName(second)


def by_hand(rows):
    events = []
    for session_id, at, a, b, n in rows:
        stages = [(None if at is None else at + timedelta(minutes=m), name) for name, m in KINDS[n % 2].items()]
        flags = [True, a, b] if n % 2 == 0 else [a, b]
        events += [(ts, session_id, name, n) for (ts, name), flag in zip(stages, flags) if flag]
    return sorted(events, key=str)


def partitions(frame):
    rows = frame.withColumn("p", F.spark_partition_id()).collect()
    found = {}
    for r in rows:
        found.setdefault(r.p, []).append((r.event_ts, r.session_id))
    return rows, [found[p] for p in sorted(found)]


CASES = {
    "spread": [(f"s{n:04d}", START + timedelta(minutes=37 * n % 9000), n % 3 > 0, n % 5 > 0, n) for n in range(600)],
    "one moment": [(f"s{n * 7919 % 600:04d}", START, True, True, n * 2) for n in range(600)],
    "a third in one moment": [
        (f"s{n:04d}", START if n % 3 == 0 else START + timedelta(minutes=n), True, n % 2 == 0, n) for n in range(600)
    ],
    "nothing reached": [(f"s{n}", START, False, None, 1) for n in range(5)],
    "few": [("b", START, True, True, 0), ("a", START, True, True, 1)],
}


@pytest.mark.parametrize("ranges", [1, 2, 7])
@pytest.mark.parametrize("case", CASES)
def test_same_events_in_order(spark, case, ranges):
    frame = timeline.ordered_events(made(spark, CASES[case]), KINDS, ranges=ranges)
    rows, parts = partitions(frame)
    assert sorted(((r.event_ts, r.session_id, r.event_name, r.n) for r in rows), key=str) == by_hand(CASES[case])
    whole = [key for part in parts for key in part]
    assert whole == sorted(whole)
    if len(whole) > 100:
        assert len(parts) == ranges and max(map(len, parts)) < 2 * len(whole) / ranges


def test_nulls_and_an_empty_table(spark):
    rows = [("x", None, True, True, 0), (None, START, True, True, 2), ("y", START, None, True, 1), ("y", START, None, True, 1)]
    frame = timeline.ordered_events(made(spark, rows), KINDS, ranges=3)
    got = sorted(((r.event_ts, r.session_id, r.event_name, r.n) for r in frame.collect()), key=str)
    assert got == by_hand(rows)
    assert frame.first().event_ts is None
    assert timeline.ordered_events(made(spark, rows).limit(0), KINDS, ranges=3).count() == 0


def test_columns_of_any_name_are_kept(spark):
    rows = made(spark, CASES["few"]).selectExpr("*", "1 AS low", "2 AS whole", "3 AS `range`", "4 AS ranges")
    found = timeline.ordered_events(rows, KINDS, ranges=2)
    assert found.columns == ["session_id", "n", "low", "whole", "range", "ranges", "event_ts", "event_name"]
    assert {(r.low, r.whole, r["range"], r.ranges) for r in found.collect()} == {(1, 2, 3, 4)}


def test_shuffle_carries_a_row_a_session(spark, make_orders, make_restaurants):
    orders = make_orders(*({"order_ts": START + timedelta(minutes=n * 11)} for n in range(2000)))
    frame = journeys.journey_timeline(orders, None, make_restaurants((1, "Thai", 4.0)), ranges=8)
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in text[: text.index("partitionidpassthrough")]  # events are made after the shuffle
    plan, written = [frame._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and "passthrough" in node.toString():
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else []
        inner += [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        plan += inner + [children.apply(i) for i in range(children.size())]
    assert written and 2000 <= written[0] <= 2000 + 8 * 5


def test_orders_joined_only_once(spark):
    """Bounds are found without the lines of the orders."""
    plan = QUERIES["journey_union"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", plan)) == 1
