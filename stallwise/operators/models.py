"""Boosted-tree models for ETA and cancellation, trained and applied by Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from stallwise.functions.numeric import half_up, ratio
from stallwise.operators.features import FEATURES, split_key, train_test_split
from stallwise.sources.staging import use_checkpoints

# Most boosting rounds, learning rate and seed. Depth 5 allows 32 leaves. A tenth of the training
# rows only decides when to stop: once a round no longer improves their loss.
ETA_ROUNDS, CANCEL_ROUNDS = 180, 160
VALIDATION_SHARE = 0.1
VALIDATION_SEED = 43
LEARNING_RATE = 0.08
MAX_DEPTH = 5
SEED = 42
# Boosting holds some hundred bytes a row in memory, several times over: tasks get so many rows, however many there are.
PARTITION_ROWS = 100_000

PARAMETERS = {
    "eta_rounds": ETA_ROUNDS, "cancel_rounds": CANCEL_ROUNDS, "validation": (VALIDATION_SHARE, VALIDATION_SEED),
    "rate": LEARNING_RATE, "depth": MAX_DEPTH, "seed": SEED,
}


def _fit(rows: DataFrame, booster, n: int) -> PipelineModel:
    """The model of ``n`` rows."""
    # Boosting adds one step of lineage per round; checkpoints keep it short when executors are lost.
    use_checkpoints(rows.sparkSession)
    # The search for splits samples rows by position: put them in the same place on every run.
    part = split_key("order_id", VALIDATION_SEED) / F.lit(2.0**60) < F.lit(VALIDATION_SHARE)
    rows = rows.withColumn("for_stopping", part)
    rows = rows.repartition(max(1, math.ceil(n / PARTITION_ROWS)), "order_id").sortWithinPartitions("order_id")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # The trainer reads them half a dozen times: they are shuffled and sorted once, and kept on the executors' disks.
    rows.persist(StorageLevel.DISK_ONLY)
    try:
        return Pipeline(stages=[assembler, booster]).fit(rows)
    finally:
        rows.unpersist()


def _settings(label: str, rounds: int) -> dict:
    return {
        "featuresCol": "features",
        "labelCol": label,
        "maxIter": rounds,
        "stepSize": LEARNING_RATE,
        "maxDepth": MAX_DEPTH,
        "seed": SEED,
        "checkpointInterval": 10,
        "validationIndicatorCol": "for_stopping",
    }


def train_eta(features: DataFrame, rounds: int = ETA_ROUNDS) -> tuple[PipelineModel, DataFrame]:
    """Regressor for ETA minutes and its error on the held-out fifth."""
    split = train_test_split(features.filter(F.col("eta_minutes").isNotNull()), seed=SEED)
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    known = train.agg(F.count(F.lit(1)).alias("n"), F.avg("eta_minutes").alias("mean")).first()
    model = _fit(train, GBTRegressor(**_settings("eta_minutes", rounds)), known.n)
    mae = RegressionEvaluator(labelCol="eta_minutes", metricName="mae").evaluate(model.transform(test))
    off = F.avg(F.abs(F.col("eta_minutes") - F.lit(known.mean)))
    guess = test.agg(F.count(F.lit(1)).alias("n"), off.alias("mae")).first()
    return model, _metric(features, "eta_mae", mae, guess.n, mae < guess.mae)


def train_cancel(features: DataFrame, rounds: int = CANCEL_ROUNDS) -> tuple[PipelineModel, DataFrame]:
    """Classifier for cancellation and its ROC-AUC on a held-out fifth of either class."""
    labelled = features.withColumn("cancelled", F.col("cancelled").cast("int"))
    split = train_test_split(labelled, seed=SEED, stratify="cancelled")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    model = _fit(train, GBTClassifier(**_settings("cancelled", rounds)), train.count())
    auc = BinaryClassificationEvaluator(labelCol="cancelled", metricName="areaUnderROC").evaluate(model.transform(test))
    return model, _metric(features, "cancel_auc", auc, test.count(), auc > 0.5)


def rank_auc(scored: DataFrame, score: str, label: str) -> Column:
    """ROC-AUC by the sum of ranks, ties at their mean rank, as a scalar; null without rows of both labels.

    Scores are grouped first, so ranks are taken over distinct scores: round them to few places, four leave 10,001.
    """
    groups = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score"))
    groups = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("ones"))
    upto = F.sum("n").over(W.orderBy("score"))
    # Twice the mean rank of a group is a whole number.
    twice = F.lit(2) * (upto - F.col("n")) + F.col("n") + F.lit(1)
    sums = groups.select("n", "ones", (F.col("ones") * twice).alias("ranks")).agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("ranks").alias("ranks")
    )
    above = F.col("ranks") - F.col("ones") * (F.col("ones") + F.lit(1))
    return sums.select(ratio(above, F.lit(2) * F.col("ones") * (F.col("n") - F.col("ones")))).scalar()


def _metric(frame: DataFrame, name: str, value: float, test_rows: int, skilled: bool) -> DataFrame:
    """The metric, the rows it is taken over, and whether it beats the mean (ETA) or a coin (cancellation)."""
    return frame.sparkSession.range(1).select(
        F.lit(name).alias("metric"),
        F.lit(float(value)).alias("value"),
        F.lit(test_rows).cast("long").alias("test_rows"),
        F.lit(bool(skilled)).alias("skilled"),
    )


def score_eta(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Predicted ETA minutes per row, two decimals."""
    scored = model.transform(features)
    return scored.select(*features.columns, half_up("prediction", 2).alias("predicted_eta_minutes"))


def score_cancellation_risk(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Predicted cancellation probability per row, four decimals."""
    scored = model.transform(features)
    risk = vector_to_array("probability")[1]
    return scored.select(*features.columns, half_up(risk, 4).alias("cancellation_probability"))


def score_valid(model: PipelineModel, checked: DataFrame, features: DataFrame, score) -> DataFrame:
    """Scores of the rows that meet the input rules; the others keep their violations and a null score.

    ``checked`` has ``order_id`` and ``violations`` (see ``quality.validate_order_features``), ``features``
    the inputs of the same orders with unknown categories allowed, ``score`` is one of the functions above.
    """
    scored = score(model, features)
    name = scored.columns[-1]
    joined = checked.select("order_id", "violations").join(scored.select("order_id", name), "order_id", "left")
    valid = F.size("violations") == 0
    return joined.select("order_id", "violations", F.when(valid, F.col(name)).alias(name))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
