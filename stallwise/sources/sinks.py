"""Writing tables, events and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.sources.schemas import DAY_COLUMNS
from stallwise.sources.tables import CSV_OPTIONS

METRIC_ROWS = 100_000  # of a file


def write_table(frame: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write the table at ``path``, in place of one that nobody reads; ``versions.replace_table`` is for those in use."""
    writer = frame.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(kind).save(path)


def save_as_table(frame: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> None:
    """Create or replace a catalogue table, optionally bucketed so later joins on the key need no shuffle.

    The table is missing while it is written: ``versions.replace_table`` is for tables with readers.
    """
    writer = frame.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def order_events(events: DataFrame) -> DataFrame:
    """Events in (event_ts, session_id) order across and inside partitions."""
    return events.repartitionByRange("event_ts", "session_id").sortWithinPartitions("event_ts", "session_id")


def write_by_day(frame: DataFrame, path: str, ts: str, then_by: str, kind: str = "parquet") -> None:
    """Rows in time order, one folder per day, so that period filters skip whole folders.

    Range partitions follow the date, so a task writes to few folders; a day too
    big for one task is split between tasks.
    """
    write_placed_by_day(frame.repartitionByRange(ts, then_by), path, ts, then_by, kind)


def write_placed_by_day(frame: DataFrame, path: str, ts: str, then_by: str, kind: str = "parquet") -> None:
    """``write_by_day`` for rows whose partitions follow their time already."""
    day = DAY_COLUMNS[ts]
    ordered = frame.withColumn(day, F.to_date(ts)).sortWithinPartitions(day, ts, then_by)
    write_table(ordered, path, kind, partition_by=(day,))


def write_events(events: DataFrame, path: str, kind: str = "parquet") -> None:
    """The event table, ordered by time and session."""
    write_by_day(events, path, "event_ts", "session_id", kind)


def write_orders(orders: DataFrame, path: str, kind: str = "parquet") -> None:
    """The order table, ordered by time and id."""
    write_by_day(orders, path, "order_ts", "order_id", kind)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics frame as JSON lines: one file of few rows, several where there are many.

    The rows meet after they are computed, not in one task that computes them.
    """
    metrics.hint("rebalance").write.option("maxRecordsPerFile", METRIC_ROWS).mode("overwrite").json(path)
