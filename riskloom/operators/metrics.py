"""Exact ranking metrics and the cost of each decision threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.prefix import (
    SLICE,
    bucketize,
    prefix_aggregate,
    quantile_splits,
)


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: positives, negatives, and those scored lower.

    Rows fall into slices of consecutive scores first, so the running counts
    need no single sort; equal scores merge before anything is ordered.
    """
    labelled = df.select(F.col(score).alias("score"), F.col(label).alias("label")).dropna()
    rows = labelled.count()
    (splits,) = quantile_splits(labelled, ["score"], rows)
    scores = (
        bucketize(labelled, "score", splits, SLICE)
        .groupBy(SLICE, "score")
        .agg(
            F.sum((F.col("label") == 1).cast("long")).alias("pos"),
            F.sum((F.col("label") == 0).cast("long")).alias("neg"),
        )
    )
    return prefix_aggregate(scores, ["score"], sums={"pos_below": "pos", "neg_below": "neg"})


def _wide(name: str):
    return F.coalesce(F.col(name), F.lit(0)).cast("decimal(19,0)")


def roc_auc(df: DataFrame, score: str = "score", label: str = "isfraud") -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs ranked right.

    A tied pair counts half. The pair count is a whole number kept in a wide
    decimal; NULL when a class is missing.
    """
    pairs = _wide("pos") * (2 * _wide("neg_below") + _wide("neg"))
    return (
        _by_score(df, score, label)
        .agg(
            F.sum(pairs.cast("decimal(38,0)")).cast("double").alias("twice"),
            F.sum("pos").cast("double").alias("p"),
            F.sum("neg").cast("double").alias("n"),
        )
        .select(
            F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("twice") / (2.0 * F.col("p") * F.col("n")))
            .alias("roc_auc")
        )
    )


def average_precision(df: DataFrame, score: str = "score", label: str = "isfraud") -> DataFrame:
    """Step sum of precision over recall; no interpolation. NULL without positives."""
    falling = df.select((-F.col(score)).alias("falling"), label)
    hits = F.coalesce(F.col("pos_below"), F.lit(0)) + F.col("pos")
    alarms = F.coalesce(F.col("neg_below"), F.lit(0)) + F.col("neg")
    precision = hits.cast("double") / F.nullif(hits + alarms, F.lit(0))
    return (
        _by_score(falling, "falling", label)
        .agg(F.sum(F.col("pos") * precision).alias("gain"), F.sum("pos").alias("p"))
        .select(F.when(F.col("p") > 0, F.col("gain") / F.col("p")).alias("average_precision"))
    )


def threshold_costs(
    df: DataFrame,
    score: str = "score",
    label: str = "isfraud",
    amount: str = "transactionamt",
    alarm_cost: int = 10,
) -> DataFrame:
    """Money lost at each threshold 0.01 .. 0.99, from one pass over the rows.

    A row's bin is the number of thresholds at or below its score. Rows collapse
    to at most 100 bins before they move; the rest works on those.
    """
    s = F.col(score)
    low = F.floor(s * 100)
    # floor(s*100) can be off by one; compare with the very thresholds.
    bin_ = (
        low
        + (s >= (low + 1) / F.lit(100.0)).cast("long")
        - (s < low / F.lit(100.0)).cast("long")
    )
    bins = (
        df.select(
            F.greatest(F.lit(0), F.least(F.lit(99), bin_)).cast("int").alias("bin"),
            F.col(label).alias("label"),
            F.col(amount).alias("amount"),
        )
        .groupBy("bin")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("amount"))).alias("fraud_amount"),
            F.sum((F.col("label") == 0).cast("long")).alias("good"),
        )
    )
    spine = df.sparkSession.range(0, 100, 1, 1).select(F.col("id").cast("int").alias("bin"))
    one = Window.partitionBy(F.lit(0)).orderBy("bin")
    missed = F.sum("fraud_amount").over(one.rowsBetween(Window.unboundedPreceding, -1))
    alarms = F.sum("good").over(one.rowsBetween(0, Window.unboundedFollowing))
    money = "decimal(30,2)"
    return (
        spine.join(bins, "bin", "left")
        .select(
            "bin",
            F.coalesce(missed, F.lit(0)).cast(money).alias("missed_fraud_cost"),
            F.coalesce(alarms, F.lit(0)).cast("long").alias("false_alarms"),
        )
        .filter("bin > 0")
        .select(
            (F.col("bin") / F.lit(100.0)).alias("threshold"),
            "missed_fraud_cost",
            "false_alarms",
            (F.col("missed_fraud_cost") + F.col("false_alarms") * F.lit(alarm_cost))
            .cast(money)
            .alias("total_cost"),
        )
    )


def best_threshold(costs: DataFrame) -> DataFrame:
    """The cheapest threshold; of equally cheap ones the lowest."""
    return costs.orderBy("total_cost", "threshold").limit(1).select("threshold", "total_cost")
