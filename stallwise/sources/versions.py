"""Tables that are replaced whole, without a moment in which they are missing or half written.

A table is a view over its current version. A new version is written as a table of its
own, and only once it is complete the view is pointed at it, which is one operation of the
catalogue. Who read the old version goes on reading it: its files stay until
``forget_versions``. A write that fails leaves the view as it was. Of two writers that
overlap the one that ends last wins; neither sees the other's rows.

Version names sort by the time at which their writing began.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MARK = "__v"
PROPERTY = "stallwise.version"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def replace_table(
    frame: DataFrame,
    name: str,
    bucket_by: str | None = None,
    buckets: int = 0,
    partition_by: tuple[str, ...] = (),
    folder: str | None = None,
) -> str:
    """Make the rows of ``frame`` the content of table ``name``; returns the version's own table name.

    ``frame`` may read the table that it replaces. With ``bucket_by`` later joins on that
    column need no shuffle. Versions lie in the warehouse, or in ``folder`` if given.
    """
    spark = frame.sparkSession
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType not in ("VIEW", "TEMPORARY"):
        raise ValueError(f"{name} is a table, not a view over versions: save it under another name first")
    version = f"{name}{MARK}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    writer = frame.write.mode("errorifexists").format("parquet").partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    if folder:
        writer = writer.option("path", f"{folder}/{version}")
    try:
        writer.saveAsTable(version)
    except Exception:
        _drop(spark, version, f"{folder}/{version}" if folder else None)
        raise
    point_to(spark, name, version)
    return version


def point_to(spark: SparkSession, name: str, version: str) -> None:
    """Make a version that is still there the current one."""
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ('{PROPERTY}' = '{version}')"
        f" AS SELECT * FROM {_quoted(version)}"
    )


def current_version(spark: SparkSession, name: str) -> str | None:
    """The version that a table shows, None if there is no such table."""
    try:
        rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()
    except AnalysisException:
        return None
    return next((r.value for r in rows if r.key == PROPERTY), None)


def versions(spark: SparkSession, name: str) -> list[str]:
    """All versions of a table that are still there, oldest first."""
    *database, table = name.split(".")
    prefix = f"{name}{MARK}"
    inside = f" IN {_quoted('.'.join(database))}" if database else ""
    found = [row.tableName for row in spark.sql(f"SHOW TABLES{inside}").collect()]
    names = [".".join((*database, n)) for n in found]
    return sorted(n for n in names if n.startswith(prefix))


def forget_versions(spark: SparkSession, name: str, keep: int = 2) -> list[str]:
    """Drop old versions with their files, but for the current and the newest ``keep``; returns what was dropped."""
    kept = {current_version(spark, name), *versions(spark, name)[-keep:]} if keep else {current_version(spark, name)}
    gone = [v for v in versions(spark, name) if v not in kept]
    for version in gone:
        _drop(spark, version, _location(spark, version))
    return gone


def _location(spark: SparkSession, table: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect()
    detail = {r.col_name: r.data_type for r in rows}
    return detail.get("Location") if detail.get("Type") == "EXTERNAL" else None


def _drop(spark: SparkSession, table: str, folder: str | None) -> None:
    """Drop a table; files outside the warehouse are deleted as well."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
