from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.operators import funnel, kpis
from stallwise.sources.schemas import SCHEMAS, STAGES
from stallwise.streaming.live import live_daily_kpis, live_funnel


def run(spark, frame, name, folder):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder)
    ).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def in_files(frame, ts, folder):
    """One file per day, so that the stream sees time pass."""
    for day in sorted(r[0] for r in frame.select(F.to_date(ts)).distinct().collect()):
        frame.filter(F.to_date(ts) == F.lit(day)).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema, ts):
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return read.withColumn(ts, F.col(ts).cast("timestamp"))


def test_closed_days_equal_the_batch(spark, make_orders, tmp_path):
    orders = make_orders(
        *({"order_ts": datetime(2025, 1, d, h), "cancelled": int(h == 3)} for d in range(1, 7) for h in range(d, 8))
    )
    in_files(orders, "order_ts", str(tmp_path / "in"))
    live = live_daily_kpis(stream(spark, str(tmp_path / "in"), orders.schema, "order_ts"), "1 hour")
    got = run(spark, live, "live_kpis", str(tmp_path / "cp")).orderBy("order_date").collect()
    expected = {r.order_date: r for r in kpis.daily_kpis(orders).collect()}
    assert len(got) >= 4
    for r in got:
        assert tuple(r)[1:] == tuple(expected[r.order_date])[1:]


def test_sessions_count_once_per_stage(spark, tmp_path):
    rows = [
        (f"S{d}{i}", i, datetime(2025, 1, d, 10, k), stage, 1, "Thai", "Low")
        for d in range(1, 6)
        for s, stage in enumerate(STAGES)
        for i in range(10 - s)
        for k in (0, 5)
    ]
    events = spark.createDataFrame(rows, SCHEMAS["events"])
    in_files(events, "event_ts", str(tmp_path / "in"))
    live = live_funnel(stream(spark, str(tmp_path / "in"), SCHEMAS["events"], "event_ts"), "1 hour")
    got = run(spark, live, "live_funnel", str(tmp_path / "cp"))
    first = {r.stage: r.sessions for r in got.filter(F.to_date("date") == F.lit("2025-01-01").cast("date")).collect()}
    day = events.filter(F.to_date("event_ts") == F.lit("2025-01-01").cast("date"))
    assert first == {r.stage: r.sessions for r in funnel.event_funnel(day).collect()}
    assert first["order"] == 6


@pytest.mark.parametrize("late", ["1 hour"])
def test_watermark_is_part_of_the_plan(spark, make_orders, tmp_path, late):
    orders = make_orders({})
    orders.write.parquet(str(tmp_path / "in"))
    live = live_daily_kpis(stream(spark, str(tmp_path / "in"), orders.schema, "order_ts"), late)
    assert live.isStreaming and "EventTimeWatermark" in live._jdf.queryExecution().toString()
