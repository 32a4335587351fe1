"""The order tables written once in buckets of the order, so that later queries join them without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stallwise.sources import versions


@dataclass(frozen=True)
class Base:
    """Names of the bucketed order and line tables."""

    orders: str
    lines: str

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.table(self.orders), spark.table(self.lines)


def write_base(
    orders: DataFrame,
    lines: DataFrame,
    name: str,
    buckets: int,
    order_key: str = "o_orderkey",
    line_key: str = "l_orderkey",
    folder: str | None = None,
) -> Base:
    """Write both tables in ``buckets`` buckets of the order's key, each in place of the version before.

    A bucket is a file per writing task and is read by one task, so rows are first brought to the task of
    their bucket: one shuffle here, none after. Choose the number so that a bucket of lines is some 100 MB. A
    hot order can't be split; orders have few lines.
    """
    base = Base(f"{name}_orders", f"{name}_lines")
    for table, frame, key in ((base.orders, orders, order_key), (base.lines, lines, line_key)):
        versions.replace_table(
            frame.repartition(buckets, key), table, bucket_by=key, buckets=buckets, folder=folder
        )
    return base
