"""The analyst's case queue, its key figures, and the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.expressions import day_number, elapsed_label
from riskloom.operators.prefix import time_rank
from riskloom.schemas import ANALYST_DECISIONS
from riskloom.sources.tables import read_target

LOG = T.StructType([*ANALYST_DECISIONS.fields, T.StructField("batch", T.IntegerType())])

# Rows shown in the queue and in the activity feed, and the
# levels at which a key figure turns into an alert.
QUEUE_ROWS = 100
FEED_ROWS = 15
RISK_ALERT = 0.5
PENDING_ALERT = 1000

# What an analyst sees of a case.
CONTEXT_COLUMNS = [
    "transactionamt", "transactiondt", "productcd", "card1", "card4", "card6", "addr1",
    "addr2", "dist1", "p_emaildomain", "r_emaildomain",
]


def pending_cases(flagged: DataFrame, decisions: DataFrame, strict: bool = False) -> DataFrame:
    """Flagged cases nobody has decided yet; any decision closes a case.

    With ``strict``, a case that needs a second approval stays until two
    different analysts have decided. Decisions collapse to one row per case
    before the join, so a much-discussed case is no hot key.
    """
    if not strict:
        decided = decisions.select("transactionid").distinct()
        return flagged.join(decided, "transactionid", "left_anti")
    voters = decisions.groupBy("transactionid").agg(
        F.count_distinct("analyst_name").alias("voters")
    )
    needed = F.when(F.col("requires_second_approval"), 2).otherwise(1)
    return (
        flagged.join(voters, "transactionid", "left")
        .filter(F.coalesce(F.col("voters"), F.lit(0)) < needed)
        .drop("voters")
    )


def pending_count(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    return pending_cases(flagged, decisions).agg(F.count(F.lit(1)).alias("pending_count"))


def pending_value(flagged: DataFrame, transactions: DataFrame, decisions: DataFrame) -> DataFrame:
    amounts = transactions.select("transactionid", "transactionamt")
    return (
        pending_cases(flagged, decisions)
        .join(amounts, "transactionid")
        .agg(
            F.coalesce(F.sum("transactionamt"), F.lit(0))
            .cast("decimal(30,2)")
            .alias("total_pending_value")
        )
    )


def case_queue(
    flagged: DataFrame,
    transactions: DataFrame,
    identities: DataFrame,
    decisions: DataFrame,
    limit: int | None = QUEUE_ROWS,
) -> DataFrame:
    """Open cases with their context, riskiest first.

    The top rows are picked on narrow columns; the wide context is then read for
    those few only. ``limit=None`` gives all open cases.
    """
    open_cases = pending_cases(flagged, decisions).select(
        "transactionid", "fraud_probability", "requires_second_approval"
    )
    context = transactions.select("transactionid", *CONTEXT_COLUMNS)
    devices = identities.select("transactionid", "devicetype", "deviceinfo")
    if limit is None:
        return open_cases.join(context, "transactionid").join(devices, "transactionid", "left")
    # A case without its transaction is no row of the queue, so the key join comes first; Spark
    # sees how small the cases and ``top`` are and chooses the joins.
    top = _riskiest(open_cases.join(transactions.select("transactionid"), "transactionid"), limit)
    cases = context.join(top, "transactionid")
    few = devices.join(top.select("transactionid"), "transactionid", "left_semi")
    return _riskiest(cases.join(few, "transactionid", "left"), limit).select(
        *open_cases.columns, *CONTEXT_COLUMNS, "devicetype", "deviceinfo"
    )


def _riskiest(cases: DataFrame, limit: int) -> DataFrame:
    return cases.orderBy(F.col("fraud_probability").desc_nulls_last(), "transactionid").limit(limit)


def filter_queue(
    queue: DataFrame, search: str | None = None, min_risk: float = 0.0, min_amount: float = 0.0
) -> DataFrame:
    """Search text that is no number matches nothing."""
    if search:
        queue = queue.filter(F.col("transactionid") == F.lit(search).try_cast("bigint"))
    return queue.filter(
        (F.col("fraud_probability") >= F.lit(min_risk))
        & (F.col("transactionamt") >= F.lit(min_amount))
    )


def queue_kpis(
    queue: DataFrame, flagged: DataFrame, transactions: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Key figures of the shown queue and of all open cases, with alert flags."""
    amounts = transactions.select("transactionid", "transactionamt")
    shown = queue.select(
        F.lit(True).alias("shown"), "transactionamt", "fraud_probability"
    )
    every = (
        pending_cases(flagged, decisions)
        .join(amounts, "transactionid", "left")
        .select(F.lit(False).alias("shown"), "transactionamt", "fraud_probability")
    )
    is_shown = F.col("shown")
    money = "decimal(30,2)"

    def total(condition: Column) -> Column:
        amount = F.sum(F.when(condition, F.col("transactionamt")))
        return F.coalesce(amount, F.lit(0)).cast(money)

    risk = F.sum(F.when(is_shown, F.col("fraud_probability"))).cast("double")
    return (
        shown.unionByName(every)
        .agg(
            F.count_if(is_shown).alias("cases_in_queue"),
            total(is_shown).alias("value_at_risk"),
            F.coalesce(risk / F.nullif(F.count_if(is_shown), F.lit(0)), F.lit(0.0)).alias(
                "avg_risk"
            ),
            F.count_if(~is_shown).alias("pending_count"),
            total(~is_shown).alias("pending_value"),
        )
        .withColumns(
            {
                "risk_alert": F.col("avg_risk") > RISK_ALERT,
                "pending_alert": F.col("pending_count") > PENDING_ALERT,
            }
        )
    )


def case_context(queue: DataFrame) -> DataFrame:
    """Words for each case (fixed values): elapsed time and the approval tag."""
    return queue.select(
        "transactionid",
        "fraud_probability",
        "transactionamt",
        elapsed_label().alias("transaction_time"),
        F.when(F.col("requires_second_approval"), "SECOND APPROVAL REQUIRED")
        .otherwise("")
        .alias("approval_tag"),
    )


def recent_activity(log: DataFrame, n: int = FEED_ROWS) -> DataFrame:
    """Latest log rows with their status word (fixed values)."""
    return (
        log.orderBy(F.col("processed_at").desc_nulls_last(), F.col("transactionid").desc())
        .limit(n)
        .withColumn(
            "status", F.when(F.col("was_flagged"), "Flagged for review").otherwise("Cleared")
        )
    )


def activity_funnel(log: DataFrame, n: int | None = FEED_ROWS) -> DataFrame:
    """Seen, flagged and cleared over the last ``n`` rows, or over all."""
    rows = log if n is None else recent_activity(log, n)
    return rows.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("was_flagged").alias("flagged"),
    ).withColumn("cleared", F.col("seen") - F.col("flagged"))


def number_decisions(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Give new decisions ids that continue the log's."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    timed = decisions.withColumn("decided_us", F.unix_micros("decided_at"))
    ranked = time_rank(timed, "decided_us", "transactionid", "rank")
    return ranked.select(
        (F.col("rank") + 1 + F.lit(last)).alias("id"),
        "transactionid",
        "analyst_name",
        "decision",
        "decided_at",
    )


def append_decisions(decisions: DataFrame, path: str, batch: int) -> None:
    """Store one batch of decisions in the log at ``path``, numbered after the batches before it.

    A batch that is written again gets the same ids and replaces itself.
    """
    spark = decisions.sparkSession
    log = read_target(spark, path, LOG)
    numbered = number_decisions(decisions, log.filter(F.col("batch") < batch))
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def decision_breakdown(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n_decisions"),
        F.count_distinct("transactionid").alias("n_cases"),
    )


def fraud_rate_trend(transactions: DataFrame) -> DataFrame:
    """Fraud share per day offset, labelled rows only."""
    return (
        transactions.filter(F.col("isfraud").isNotNull())
        .groupBy(day_number().alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n_transactions"),
            F.sum(F.col("isfraud").cast("long")).alias("n_fraud"),
        )
        .withColumn("fraud_rate", F.col("n_fraud") / F.col("n_transactions"))
    )
