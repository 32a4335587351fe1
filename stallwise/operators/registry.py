"""Fitted models, found again by what they were fitted on.

A model is kept under a fingerprint of its training rows, its parameters and the version of
Spark. The fingerprint is a count and sums of row hashes: rows in any order and any partitioning
give the same one, a changed, added or repeated row another. So scoring fits a model only
where none was fitted on these rows; a changed table fits anew.

A model is written beside its place and moved there when it is whole, so others never load half
of one. Two sessions that fit the same model at once keep the first to end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.models import load_model, save_model
from stallwise.sources.staging import application_folder

Train = Callable[[DataFrame], tuple[PipelineModel, DataFrame]]


@dataclass(frozen=True)
class Fitted:
    """A model, its metrics and where it is kept; ``fresh`` if it was fitted just now."""

    model: PipelineModel
    metrics: DataFrame
    path: str
    fresh: bool


def fingerprint(rows: DataFrame) -> str:
    """Digest of a frame's columns and rows, whatever their order."""
    columns = sorted(rows.columns)
    values = [F.col(f"`{c}`") for c in columns]
    # Nulls leave a hash as it was, so where they are is hashed as well.
    nulls = F.concat_ws("", *(F.isnull(v).cast("string") for v in values))
    first, second = F.xxhash64(*values, nulls), F.xxhash64(F.lit(1), *values, nulls)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(h.cast("decimal(38,0)")).alias(f"sum{i}") for i, h in enumerate((first, second))),
        F.bit_xor(first).alias("xor"),
    ).first()
    types = dict(rows.dtypes)
    text = json.dumps([[(c, types[c]) for c in columns], [str(v) for v in sums]])
    return hashlib.sha256(text.encode()).hexdigest()


def fitted(
    rows: DataFrame, kind: str, train: Train, parameters: Mapping[str, object] | None = None, folder: str | None = None
) -> Fitted:
    """The model that ``train`` makes of ``rows``, from ``folder`` if it is there.

    ``train`` returns a model and a frame of metrics; ``parameters`` says all that it hangs on besides the rows.
    Without a folder models live as long as the application.
    """
    spark = rows.sparkSession
    folder = folder or f"{application_folder(spark)}/models"
    given = json.dumps([kind, spark.version, sorted((parameters or {}).items())], default=str)
    key = hashlib.sha256(f"{given}:{fingerprint(rows)}".encode()).hexdigest()[:32]
    path = f"{folder}/{kind}-{key}"
    fresh = not _exists(spark, path)
    if fresh:
        model, metrics = train(rows)
        beside = f"{folder}/.{kind}-{key}-{uuid.uuid4().hex}"
        save_model(model, f"{beside}/model")
        metrics.write.parquet(f"{beside}/metrics")
        _move(spark, beside, path)
    return Fitted(load_model(f"{path}/model"), spark.read.parquet(f"{path}/metrics"), path, fresh)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to its place, or drop it if there is one already."""
    start, files = _files(spark, source)
    end, _ = _files(spark, target)
    if files.exists(end) or not files.rename(start, end):
        files.delete(start, True)
        if not files.exists(end):
            raise OSError(f"could not move a fitted model to {target}")
    else:
        # A rename into a folder that another session made meanwhile puts ours inside it.
        inside, _ = _files(spark, f"{target}/{source.rsplit('/', 1)[-1]}")
        files.delete(inside, True)
