"""Fraud tables derived from the given star-schema tables.

Each builder is a projection of a whole input table, so it grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expressions import offset_seconds
from riskloom.schemas import IDENTITIES, MONEY, TRANSACTIONS

EVENT_ORIGIN = "2024-01-01"

_EVENT_COLUMNS = {
    "transactionid": "event_id",
    "isfraud": "CASE WHEN event_type = 'error' AND value >= 40 THEN 1 ELSE 0 END",
    "transactionamt": "CAST(value * 10 AS DECIMAL(10,2))",
    "productcd": "element_at(array('W','H','C','S','R'), CAST(event_id % 5 AS INT) + 1)",
    "card1": "CAST(1000 + user_id AS INT)",
    "card4": "element_at(array('visa','mastercard','amex','discover'), CAST(user_id % 4 AS INT) + 1)",
    "card6": "CASE WHEN user_id % 2 = 0 THEN 'debit' ELSE 'credit' END",
    "addr1": "CASE WHEN event_id % 9 <> 0 THEN 100 + (event_id % 3) * 10 END",
    "p_emaildomain": (
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 <= 5 THEN 'gmail.com' "
        "WHEN event_id % 11 <= 7 THEN 'yahoo.com' WHEN event_id % 11 <= 9 THEN 'hotmail.com' "
        "ELSE 'anonymous.com' END"
    ),
    "d1": "CASE WHEN event_id % 6 <> 0 THEN (user_id * 7 + event_id) % 640 END",
    "c1": "event_id % 4",
    "c2": "CASE WHEN event_id % 10 <> 0 THEN event_id % 3 END",
    "m1": "CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "m2": "CASE event_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN NULL ELSE 'T' END",
    "m3": "CASE WHEN event_id % 5 <> 0 THEN 'T' END",
    "m4": "CASE WHEN event_id % 7 = 0 THEN 'F' ELSE 'T' END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A: one transaction per event, all 55 columns."""
    columns = []
    for field in TRANSACTIONS.fields:
        if field.name == "transactiondt":
            value = offset_seconds("ts", EVENT_ORIGIN)
        else:
            value = F.expr(_EVENT_COLUMNS.get(field.name, "NULL"))
        columns.append(value.cast(field.dataType).alias(field.name))
    return table(spark, sf_dir, "events").select(*columns)


def raw_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the events have an identity row; some of those are all NULL."""
    device = "CASE WHEN event_id % 16 = 0 THEN NULL WHEN event_id % 8 = 4 THEN 'mobile' ELSE 'desktop' END"
    values = {"transactionid": "event_id", "devicetype": device}
    return table(spark, sf_dir, "events").filter("event_id % 4 = 0").select(
        *[
            F.expr(values.get(f.name, "NULL")).cast(f.dataType).alias(f.name)
            for f in IDENTITIES.fields
        ]
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity rows as loaded: those with no value at all are gone."""
    return raw_identities(spark, sf_dir).na.drop(
        how="all", subset=[c for c in IDENTITIES.names if c != "transactionid"]
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B: orders as transactions; whole-day times give many ties."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("transactionid"),
        F.col("o_custkey").cast("int").alias("card1"),
        F.col("c_nationkey").cast("float").alias("addr1"),
        F.col("o_totalprice").cast(MONEY).alias("transactionamt"),
        offset_seconds("o_orderdate", "1995-01-01").alias("transactiondt"),
    )


# A fixed-weight logistic stands in for a trained model wherever SQL has to
# follow; it is test data, not a scoring method.
RULE_INTERCEPT = -4.0
RULE_WEIGHTS = {
    "card1": 0.0001,
    "transactionamt": 0.003,
    "has_identity": -0.5,
    "uid_avg_amt_before_this": 0.0005,
    "uid_txn_count_before_this": -0.01,
    "seconds_since_last_txn": -0.0000005,
    "email_txn_count_before_this": 0.00001,
    "account_age_days": -0.001,
    "identity_linkage_score": 0.05,
    "match_flag_count": 0.2,
    "hour_of_day": 0.01,
    "day_of_week": -0.02,
    "no_identity_high_velocity": 0.6,
}


def rule_score(features: DataFrame) -> DataFrame:
    """Add ``score`` in [0, 1], rounded to six places."""
    z = F.lit(RULE_INTERCEPT)
    for name, weight in RULE_WEIGHTS.items():
        z = z + F.lit(weight) * F.coalesce(F.col(name).cast("double"), F.lit(-1.0))
    return features.withColumn("score", F.round(1.0 / (1.0 + F.exp(-z)), 6))


def decisions(cases: DataFrame, transactions: DataFrame) -> DataFrame:
    """Decisions on every fifth flagged case, at the time of its transaction."""
    times = transactions.select("transactionid", "transactiondt", "card1")
    kind = "element_at(array('dismissed','confirmed_fraud','escalated'), CAST(transactionid % 3 AS INT) + 1)"
    return (
        cases.filter("transactionid % 5 = 0")
        .select("transactionid")
        .join(times, "transactionid")
        .select(
            "transactionid",
            F.concat(F.lit("analyst_"), (F.col("card1") % 7).cast("string")).alias("analyst_name"),
            F.expr(kind).alias("decision"),
            F.timestamp_seconds("transactiondt").alias("decided_at"),
        )
    )


def activity_log(scored: DataFrame) -> DataFrame:
    return scored.select(
        "transactionid",
        "transactionamt",
        F.col("score").cast("decimal(6,4)").alias("fraud_probability"),
        (F.col("score") >= 0.07).alias("was_flagged"),
        F.timestamp_seconds("transactiondt").alias("processed_at"),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as text, with faults, and with some rows sent twice."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 101 <> 0 THEN CAST(event_id AS STRING) END AS transactionid",
        "CASE WHEN event_id % 89 = 0 THEN '2' WHEN event_id % 97 = 0 THEN NULL "
        "WHEN event_type = 'error' THEN '1' ELSE '0' END AS isfraud",
        "CASE WHEN event_id % 83 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS transactiondt",
        "CASE WHEN event_id % 79 = 0 THEN '123456789012.00' "
        "ELSE CAST(CAST(value * 10 AS DECIMAL(10,2)) AS STRING) END AS transactionamt",
        "CASE WHEN event_id % 73 = 0 THEN 'WHOLESALE-LONG' ELSE 'W' END AS productcd",
        "CASE WHEN event_id % 71 = 0 THEN repeat('x', 101) ELSE 'gmail.com' END AS p_emaildomain",
        "event_id",
    )
    again = rows.filter("event_id % 67 = 0")
    return rows.withColumn("ingest_order", F.col("event_id") * 2).unionByName(
        again.withColumn("ingest_order", F.col("event_id") * 2 + 1)
    ).drop("event_id")


def raw_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision rows as text, one per event, with faults."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS transactionid",
        "CASE WHEN event_id % 31 <> 0 THEN concat('analyst_', CAST(user_id % 7 AS STRING)) END AS analyst_name",
        "CASE event_id % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'confirmed_fraud' "
        "WHEN 2 THEN 'escalated' ELSE 'approve' END AS decision",
        "event_id AS ingest_order",
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file as it comes: mixed case, columns nobody wants, others missing."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("V1"),
        F.col("value").alias("V2"),
        F.expr("CAST(1000 + user_id AS INT)").alias("card1"),
        F.col("event_id").alias("TransactionID"),
        offset_seconds("ts", EVENT_ORIGIN).alias("TransactionDT"),
        F.col("value").cast("float").alias("dist1"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'T' END").alias("M4"),
        F.lit("gmail.com").alias("P_emaildomain"),
    )
