"""From scores to cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import PROBABILITY

# The cost-least threshold in use, and the amount from which a
# second analyst has to approve.
DECISION_THRESHOLD = 0.07
HIGH_VALUE = 500


def is_flagged(score: str = "score", threshold: float = DECISION_THRESHOLD) -> Column:
    """Compares the unrounded probability."""
    return F.col(score) >= F.lit(threshold)


def needs_second_approval(amount: str = "transactionamt", limit: int = HIGH_VALUE) -> Column:
    return F.col(amount) >= F.lit(limit)


def verdict(score: str = "score", threshold: float = DECISION_THRESHOLD) -> Column:
    return F.when(is_flagged(score, threshold), "FLAGGED FOR REVIEW").otherwise(
        "APPEARS LEGITIMATE"
    )


def flag(
    scored: DataFrame,
    threshold: float = DECISION_THRESHOLD,
    high_value: int = HIGH_VALUE,
    since: int | None = None,
) -> DataFrame:
    """Case rows of all transactions at or above the threshold.

    ``since`` leaves out transactions before that time offset, for example the
    ones the model was trained on.
    """
    if since is not None:
        scored = scored.filter(F.col("transactiondt") >= since)
    return scored.filter(is_flagged(threshold=threshold)).select(
        "transactionid",
        F.col("score").cast(PROBABILITY).alias("fraud_probability"),
        needs_second_approval(limit=high_value).alias("requires_second_approval"),
    )


def score_response(explained: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """One record per transaction: rounded probability, verdict, ranked reasons.

    ``explained`` has the score and the reasons array side by side (see
    ``explain.ranked``), so no join is needed.
    """
    short = F.transform(
        "reasons",
        lambda r: F.struct(
            r["feature"].alias("feature"), F.round(r["contribution"], 4).alias("contribution")
        ),
    )
    return explained.select(
        "transactionid",
        F.round("score", 4).alias("fraud_probability"),
        is_flagged(threshold=threshold).alias("flagged"),
        verdict(threshold=threshold).alias("verdict"),
        F.lit(threshold).alias("threshold_used"),
        short.alias("reasons"),
    )
