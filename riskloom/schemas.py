"""Table schemas and column groups."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column groups of the two raw tables ---------------------
COLUMN_GROUPS = {
    "identifier": ["transactionid", "isfraud"],
    "velocity": ["transactiondt", "transactionamt"],
    "geographic": ["dist1", "dist2"],
    "maturity": [f"d{i}" for i in range(1, 16)],
    "linkage": [f"c{i}" for i in range(1, 15)],
    "match": [f"m{i}" for i in range(1, 10)],
    "context": ["productcd", "card4", "card6"],
    "supporting": ["card1", "card2", "card3", "card5", "addr1", "addr2"],
    "email": ["p_emaildomain", "r_emaildomain"],
}
IDENTITY_GROUPS = {
    "identifier": ["transactionid"],
    "signal": [f"id_{i:02d}" for i in range(1, 13)],
    "device": ["devicetype", "deviceinfo"],
}

# --- Fixed values: model inputs, in model order ----------------------------
MODEL_FEATURES = [
    "card1",
    "transactionamt",
    "has_identity",
    "uid_avg_amt_before_this",
    "uid_txn_count_before_this",
    "seconds_since_last_txn",
    "email_txn_count_before_this",
    "account_age_days",
    "identity_linkage_score",
    "match_flag_count",
    "hour_of_day",
    "day_of_week",
    "no_identity_high_velocity",
]
LABEL = "isfraud"

# --- Fixed values: text length limits and the decision enum ----------------
TEXT_LIMITS = {
    "productcd": 10,
    "card4": 25,
    "card6": 25,
    "p_emaildomain": 100,
    "r_emaildomain": 100,
    **{f"m{i}": 10 for i in range(1, 10)},
    "id_12": 20,
    "devicetype": 50,
    "deviceinfo": 255,
    "analyst_name": 100,
    "decision": 20,
}
DECISIONS = ["confirmed_fraud", "dismissed", "escalated"]

# Columns the features are made from.
INPUTS = [
    "transactionid", "card1", "addr1", "transactiondt", "transactionamt", "isfraud",
    "p_emaildomain", "d1", "c1", "c2", "m1", "m2", "m3", "m4",
]

MONEY = T.DecimalType(10, 2)
PROBABILITY = T.DecimalType(6, 4)

# Keys are bigint rather than int: a table of the size this is meant for has
# more rows than int can number.
_TYPES = {
    "transactionid": T.LongType(),
    "isfraud": T.IntegerType(),
    "transactiondt": T.LongType(),
    "transactionamt": MONEY,
    "card1": T.IntegerType(),
}


def _field(name: str) -> T.StructField:
    text = TEXT_LIMITS.keys()
    kind = _TYPES.get(name) or (T.StringType() if name in text else T.FloatType())
    return T.StructField(name, kind, True)


TRANSACTION_COLUMNS = [c for group in COLUMN_GROUPS.values() for c in group]
IDENTITY_COLUMNS = [c for group in IDENTITY_GROUPS.values() for c in group]

TRANSACTIONS = T.StructType([_field(c) for c in TRANSACTION_COLUMNS])
IDENTITIES = T.StructType([_field(c) for c in IDENTITY_COLUMNS])

FLAGGED_CASES = T.StructType(
    [
        T.StructField("transactionid", T.LongType()),
        T.StructField("fraud_probability", PROBABILITY),
        T.StructField("requires_second_approval", T.BooleanType()),
        T.StructField("flagged_at", T.TimestampType()),
    ]
)
ANALYST_DECISIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("transactionid", T.LongType()),
        T.StructField("analyst_name", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
    ]
)
ACTIVITY_LOG = T.StructType(
    [
        T.StructField("transactionid", T.LongType()),
        T.StructField("transactionamt", MONEY),
        T.StructField("fraud_probability", PROBABILITY),
        T.StructField("was_flagged", T.BooleanType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)
# What a caller knows about a transaction that has just arrived.
ARRIVAL = T.StructType(
    [
        T.StructField("transactionid", T.LongType()),
        T.StructField("card1", T.IntegerType()),
        T.StructField("addr1", T.FloatType()),
        T.StructField("transactionamt", MONEY),
        T.StructField("transactiondt", T.LongType()),
        T.StructField("p_emaildomain", T.StringType()),
    ]
)
