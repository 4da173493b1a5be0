"""Boosted-tree training, scoring and the whole training run."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import boosting
from riskloom.operators.metrics import average_precision, best_threshold, roc_auc, threshold_costs
from riskloom.operators.split import split_by_time
from riskloom.schemas import LABEL, MODEL_FEATURES
from riskloom.session import ensure_checkpoint_dir, materialise

# Stands for "unknown" in the model: every real value is zero or more.
MISSING = -1.0


def assemble(features: DataFrame) -> DataFrame:
    """Add the model's input vector; unknown values become MISSING."""
    inputs = [f"__{c}" for c in MODEL_FEATURES]
    filled = features.withColumns(
        {
            f"__{c}": F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(MISSING))
            for c in MODEL_FEATURES
        }
    )
    return VectorAssembler(inputCols=inputs, outputCol="inputs").transform(filled).drop(*inputs)


def train_model(train: DataFrame, trees: int = 200, depth: int = 5, seed: int = 42):
    """Fit on labelled rows only; an arrival without a label teaches nothing."""
    ensure_checkpoint_dir(train.sparkSession)
    known = assemble(train.filter(F.col(LABEL).isNotNull())).select(
        "inputs", F.col(LABEL).cast("double").alias("label")
    )
    estimator = GBTClassifier(
        featuresCol="inputs",
        labelCol="label",
        maxIter=trees,
        maxDepth=depth,
        stepSize=0.1,
        minInstancesPerNode=20,
        checkpointInterval=10,
        seed=seed,
    )
    return boosting.fit(estimator, known)


def score(features: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """Add ``score``: the probability of fraud, unrounded."""
    scored = model.transform(assemble(features))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "inputs", "rawPrediction", "probability", "prediction"
    )


def evaluate(scored: DataFrame) -> dict:
    costs = best_threshold(threshold_costs(scored)).first()
    return {
        "roc_auc": roc_auc(scored).first()[0],
        "pr_auc": average_precision(scored).first()[0],
        "best_threshold": costs["threshold"],
        "best_cost": float(costs["total_cost"]),
    }


def training_run(
    features: DataFrame, trees: int = 200, seed: int = 42, save_to: str | None = None
) -> tuple[GBTClassificationModel, DataFrame]:
    """Split by time, train, evaluate on the later part; one row of metrics.

    ``features`` should be a written table: several jobs read it. Only single
    rows come to the driver.
    """
    split = split_by_time(features.filter(F.col(LABEL).isNotNull()))
    train, test = split.filter("side = 'train'"), split.filter("side = 'test'")
    model = train_model(train, trees=trees, seed=seed)
    metrics = {"trees": trees, "train_rows": train.count(), "test_rows": test.count()}
    # Scoring walks every tree, and the metrics pass over the scores several times.
    scored = score(test, model).select("score", LABEL, "transactionamt")
    metrics |= evaluate(materialise(scored, "test-scores"))
    if save_to:
        model.write().overwrite().save(save_to)
    schema = (
        "trees int, train_rows long, test_rows long, roc_auc double, pr_auc double, "
        "best_threshold double, best_cost double"
    )
    return model, features.sparkSession.createDataFrame([tuple(metrics.values())], schema)


