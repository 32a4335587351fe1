"""What the model queries read and hold, whatever the number of orders."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from stallwise.operators import features, models, registry
from stallwise.plans.workload import QUERIES
from stallwise.sources import standins


class Asked(Exception):
    """A model was asked for."""


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def market(spark, tmp_path):
    """Orders, one of them without lines, their lines and customers, as the test tables have them."""
    day, levels = datetime(2024, 1, 1, 12), list(standins.TRAFFIC_LEVELS)
    rows = {
        "orders": [(i, i % 7, "P" if i % 3 else "F", 10.0 + i, day, levels[i % 5]) for i in range(40)],
        "lineitem": [
            (i, 1, 1, n, float(n + i % 9), 20.0 + i, 0.01 * (i % 5), 0.01 * (n + 1), "N", "O", day) for i in range(39) for n in range(1 + i % 4)
        ],
        "customer": [(i, f"c{i}", 1, 0.0, list(standins.WEATHER_LEVELS)[i % 5]) for i in range(7)],
    }
    for name, of in rows.items():
        spark.createDataFrame(of, standins.RAW_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def labelled(spark):
    """Model features of 1,000 orders."""
    names = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20)).cast("double").alias(c) for i, c in enumerate(features.FEATURES)]
    rows = spark.range(1000).select(F.col("id").alias("order_id"), (F.col("id") % 4 == 0).cast("int").alias("cancelled"), *names)
    return rows.withColumn("eta_minutes", F.col("distance_km") * 2 + F.col("items"))


@pytest.mark.parametrize(
    "name",
    ["model_registry", "score_eta", "score_cancellation_risk", "score_validated", "eta_model_metrics", "cancel_model_metrics", "model_round_trip"],
)
def test_orders_and_lines_are_joined_once(spark, monkeypatch, market, name):
    asked = []

    def fitted(rows, *_):
        asked.append(plan(rows))
        raise Asked

    monkeypatch.setattr(registry, "fitted", fitted)
    with pytest.raises(Asked):
        QUERIES[name](spark, market)
    assert "l_orderkey" not in asked[0] and "o_orderkey" not in asked[0]


@pytest.mark.parametrize("stratify", [None, "cancelled"])
def test_a_split_is_used_without_looking_for_its_cuts_again(labelled, stratify):
    split = plan(features.train_test_split(labelled, stratify=stratify))
    assert "Window" not in split and "Aggregate" not in split


@pytest.mark.parametrize("kind, trainer", [("GBTRegressor", models.train_eta), ("GBTClassifier", models.train_cancel)])
def test_trainer_tasks_hold_a_bounded_number_of_rows(monkeypatch, labelled, kind, trainer):
    sizes, booster = [], getattr(models, kind)

    class Counting(Estimator):
        def __init__(self, inner):
            super().__init__()
            self.inner = inner

        def _fit(self, rows):
            sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect())
            return self.inner.fit(rows)

    monkeypatch.setattr(models, kind, lambda **settings: Counting(booster(**settings)))
    monkeypatch.setattr(models, "PARTITION_ROWS", 100, raising=False)
    _, metric = trainer(labelled, rounds=1)
    assert sum(sizes) == 800 and max(sizes) <= 200
    assert metric.first().test_rows == 200
