"""The corpus pipeline: documents through stages, each written as Parquet and read by the next.

A stage's frame is to be written before the next stage is called: what stages keep in the shared folder for
their own use goes then, unless the next one's documents are still read from it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stallwise.llm import decontaminate, jaccard, materialise, mixing, quality
from stallwise.llm.common import table
from stallwise.sources import staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_kept: dict[str, list[str]] = {}  # by application: what earlier stages have left in the shared folder


def _tidy(step: Stage) -> Stage:
    """The stage, after the folders of earlier ones that its documents don't read are removed."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        earlier = _kept.pop(application, [])
        read = docs.inputFiles() if earlier else []
        needed = [path for path in earlier if any(f"/{path.rsplit('/', 1)[-1]}/" in file for file in read)]
        staging.remove(spark, set(earlier) - set(needed))
        with staging.recorded() as made:
            result = step(spark, docs, sf_dir)
        _kept[application] = [*needed, *made]
        return result

    return run_step


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return quality.keep(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


@_tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs)


@_tidy
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences written to fixed-stride shards, permuted inside each shard so that the mix's order stays: a row for each."""
    return materialise.materialise(docs, band=materialise.SLOTS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_shards),
]

#: The last stage's rows depend on a tokenizer and a Feistel permutation, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            with staging.recorded() as made:
                docs = staging.stage(docs, f"stage{number}")
            _kept[spark.sparkContext.applicationId] += made
    return docs
