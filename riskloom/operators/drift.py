"""Two-sample Kolmogorov-Smirnov drift report between two periods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import ks
from riskloom.operators.prefix import (
    SLICE,
    bucketize,
    prefix_aggregate,
    quantile_splits,
)

# Monitored features and the significance level. Cumulative
# counts grow with time by construction, so their drift says little.
MONITORED = [
    "transactionamt",
    "uid_avg_amt_before_this",
    "uid_txn_count_before_this",
    "seconds_since_last_txn",
    "email_txn_count_before_this",
]
MECHANICAL = ["uid_txn_count_before_this", "email_txn_count_before_this"]
SIGNIFICANCE = 0.05
MIN_VALUES = 10
SERIES_TERMS = 100


def _p_value() -> Column:
    """Limit distribution of the statistic, with lambda in column ``lam``."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("lam") * F.col("lam")),
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(F.col("lam") < 0.2, 1.0).otherwise(bounded)


def _finite_p_value(exact_values: int) -> Column:
    """For samples of the sizes at hand; the column has one row per feature."""

    @F.pandas_udf("double")
    def p_values(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks.p_value(*row, exact_values) for row in zip(d, n, m)], dtype="float64")

    return p_values("d", "n_ref", "n_cur")


def drift_report(
    split: DataFrame, features: list[str] = MONITORED, finite: bool = False, exact_values: int = ks.EXACT_VALUES
) -> DataFrame:
    """One row per feature with at least ten values on both sides.

    p-values are those of the limit distribution, or with ``finite`` of the samples' sizes: exact up to ``exact_values``.

    ``split`` has a ``side`` of 'reference' or 'current'. Equal values merge
    first; the running counts then go slice by slice within each feature, with
    split points taken from that feature's own distribution.
    """
    wide = split.select("side", *[F.col(c).cast("double").alias(c) for c in features])
    rows = wide.count()
    splits = quantile_splits(wide, features, rows)
    for name, cut in zip(features, splits):
        wide = bucketize(wide, name, cut, f"__slice_{name}")
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"__slice_{c}").alias(SLICE),
                F.col(c).alias("value"),
            )
            for c in features
        ]
    )
    is_reference = F.col("side") == "reference"
    counts = (
        wide.select("side", F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", SLICE, "value")
        .agg(
            F.sum(is_reference.cast("long")).alias("ref"),
            F.sum((~is_reference).cast("long")).alias("cur"),
        )
    )
    sizes = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")
    )
    below = prefix_aggregate(
        counts, ["value"], key="feature", sums={"ref_below": "ref", "cur_below": "cur"}
    )

    def share(own: str, lower: str, size: str) -> Column:
        return (F.coalesce(F.col(lower), F.lit(0)) + F.col(own)).cast("double") / F.col(size)

    gap = F.abs(share("ref", "ref_below", "n_ref") - share("cur", "cur_below", "n_cur"))
    # ``sizes`` has one row per monitored feature.
    statistic = (
        below.join(F.broadcast(sizes), "feature")
        .groupBy("feature", "n_ref", "n_cur")
        .agg(F.max(gap).alias("d"))
        .filter((F.col("n_ref") >= MIN_VALUES) & (F.col("n_cur") >= MIN_VALUES))
    )
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    return (
        statistic.withColumn("lam", F.sqrt(n * m / (n + m)) * F.col("d"))
        .withColumn("p", _finite_p_value(exact_values) if finite else _p_value())
        .select(
            "feature",
            F.round("d", 4).alias("ks_statistic"),
            F.round("p", 6).alias("p_value"),
            (F.col("p") < SIGNIFICANCE).alias("drift_detected"),
            F.col("feature").isin(MECHANICAL).alias("mechanical"),
        )
    )


def any_drift(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("any_drift"),
        F.count_if("drift_detected").alias("n_drifted"),
    )
