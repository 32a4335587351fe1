"""Cutting lineage with a table in the cluster's shared folder.

Several passes over one expensive aggregate must see the same rows, also when
executors are lost between passes. Such an aggregate is written once to the
folder named by ``spark.checkpoint.dir`` and read back; columnar files let each
pass read only the columns it needs. Where that setting is unset the session's
warehouse folder takes its place, unless that is a folder of one machine in a session of
several. Folders are named by application, and ``clear`` (also called when Python ends)
removes them.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        system = warehouse if ":" in warehouse else spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
        if system.startswith("file:"):
            raise ValueError(
                f"executors may not see {warehouse}: name a folder that they share with the driver in spark.checkpoint.dir"
            )
    return f"{warehouse}/staging"


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stallwise-{spark.sparkContext.applicationId}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints (iterative model training) at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    _clear_at_exit(spark)
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are given out inside, as a list that grows."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [other for other in _recorders if other is not paths]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove staged folders. Frames that read them no longer work."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and return it read back from the shared folder."""
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove every folder this application has staged. Frames that read them no longer work."""
    remove(spark, [application_folder(spark)])


_recorders: list[list[str]] = []
_at_exit: set[str] = set()


def _clear_at_exit(spark: SparkSession) -> None:
    application = spark.sparkContext.applicationId
    if application not in _at_exit:
        _at_exit.add(application)
        atexit.register(_quietly_clear, spark)


def _quietly_clear(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have been stopped
        clear(spark)
