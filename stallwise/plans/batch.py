"""Batch run: load, check, report, train, write.

    python -m stallwise.plans.batch INPUT OUTPUT [--period last_30_days]
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators import features, models, quality
from stallwise.operators.scope import Scope
from stallwise.plans import reports
from stallwise.sources import sinks
from stallwise.sources.tables import MissingTable, TableSet, load_csv, load_parquet


class BrokenInvariant(ValueError):
    """The data break a rule the metrics rely on."""


def check(tables: TableSet) -> None:
    """Stop unless the invariants hold."""
    experiments = tables["experiments"] if "experiments" in tables else None
    found = quality.invariant_violations(tables["orders"], experiments, tables["restaurants"])
    # One row per rule.
    broken = found.filter(F.col("violations") > 0).collect()
    if broken:
        raise BrokenInvariant(", ".join(f"{r['check']}: {r.violations} of {r['rows']}" for r in broken))


def train(tables: TableSet, output: str, rounds: int | None = None) -> DataFrame:
    """Train and save both models; their metrics as one frame."""
    rows = features.model_features(tables["orders"])
    limit = {} if rounds is None else {"rounds": rounds}
    metrics = []
    for name, fit in (("eta_model", models.train_eta), ("cancel_model", models.train_cancel)):
        model, metric = fit(rows, **limit)
        models.save_model(model, f"{output}/models/{name}")
        metrics.append(metric)
    return reduce(DataFrame.unionByName, metrics)


def run(tables: TableSet, output: str, within: Scope = Scope("last_30_days"), rounds: int | None = None) -> None:
    """Every report as a Parquet table under ``output``, models and their metrics beside them."""
    check(tables)
    for group, frames in (("reports", reports.reports(tables, within)), ("sql_pack", reports.sql_pack(tables))):
        for name, make in frames.items():
            try:
                frame = make()
            except MissingTable:
                continue
            sinks.write_table(frame, f"{output}/{group}/{name}")
    sinks.write_metrics(train(tables, output, rounds), f"{output}/metrics")


def main() -> None:
    parser = argparse.ArgumentParser(description="Run every report over a data set")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    parser.add_argument("--period", default="last_30_days")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("stallwise").getOrCreate()
    load = load_csv if args.format == "csv" else load_parquet
    run(load(spark, args.input), args.output, Scope(args.period))


if __name__ == "__main__":
    main()
