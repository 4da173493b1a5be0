"""The model features of each transaction, from its customer's own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import expressions as E
from riskloom.operators.prefix import OrderProfile, prefix_aggregate, profile_order
from riskloom.schemas import INPUTS

ORDER = ["transactiondt", "transactionid"]

# The output columns, in order.
OUTPUTS = [
    "transactionid", "card1", "uid", "transactiondt", "transactionamt", "isfraud",
    "devicetype", "has_identity", "p_emaildomain", "uid_avg_amt_before_this",
    "uid_txn_count_before_this", "seconds_since_last_txn", "email_txn_count_before_this",
    "account_age_days", "identity_linkage_score", "match_flag_count", "hour_of_day",
    "day_of_week", "no_identity_high_velocity",
]


# What the history windows need of a row.
HISTORY_INPUTS = ["transactionid", "transactiondt", "uid", "p_emaildomain", "amt_cents"]


def prepare(transactions: DataFrame) -> DataFrame:
    """Everything that needs one row only, so that the windows move few bytes.

    Amounts become whole cents for the running sums: exact in a long, which
    windows add much faster than a decimal of more than 18 digits.
    """
    return transactions.select(
        "transactionid",
        "card1",
        "transactiondt",
        "transactionamt",
        "isfraud",
        "p_emaildomain",
        E.customer_key().alias("uid"),
        (F.col("transactionamt") * 100).cast("long").alias("amt_cents"),
        E.account_age().alias("account_age_days"),
        E.linkage_score().alias("identity_linkage_score"),
        E.match_mismatches().alias("match_flag_count"),
    )


def with_identity(transactions: DataFrame, identities: DataFrame) -> DataFrame:
    """Left join of the device type, and whether an identity record exists."""
    known = identities.select(
        "transactionid", "devicetype", F.lit(1).alias("has_identity")
    )
    return transactions.join(known, "transactionid", "left").withColumn(
        "has_identity", F.coalesce(F.col("has_identity"), F.lit(0))
    )


def profile_transactions(keyed: DataFrame) -> OrderProfile:
    return profile_order(keyed, *ORDER, keys=("uid", "p_emaildomain"))


def customer_history(keyed: DataFrame, profile: OrderProfile, **options) -> DataFrame:
    """Count, amount sum and time of the customer's earlier transactions."""
    return prefix_aggregate(
        keyed,
        ORDER,
        profile,
        key="uid",
        count="uid_txn_count_before_this",
        sums={"uid_cents_before_this": "amt_cents"},
        previous="uid_last_dt",
        **options,
    )


def email_history(rows: DataFrame, profile: OrderProfile, **options) -> DataFrame:
    """Number of earlier transactions with the same purchaser e-mail domain."""
    return prefix_aggregate(
        rows, ORDER, profile, key="p_emaildomain", count="email_txn_count_before_this", **options
    )


def prior_average(cents: str, count: str) -> Column:
    """Mean of earlier amounts, from an exact sum of cents."""
    return F.when(F.col(count) > 0, F.col(cents).cast("double") / 100.0 / F.col(count))


def derive_features(history: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature columns, once history and identity are there."""
    return (
        history.withColumns(
            {
                "uid_avg_amt_before_this": prior_average(
                    "uid_cents_before_this", "uid_txn_count_before_this"
                ),
                "seconds_since_last_txn": F.col("transactiondt") - F.col("uid_last_dt"),
                "hour_of_day": E.hour_of_day(),
                "day_of_week": E.day_of_week(),
            }
        )
        .withColumn("no_identity_high_velocity", E.high_velocity())
        .select(*OUTPUTS, *keep)
    )


def transaction_features(transactions: DataFrame, identities: DataFrame) -> DataFrame:
    """One row of features per transaction.

    Rows move three times: by (uid, slice), by (e-mail domain, slice) and by id
    for the identity join. The output has no global order; sort it where a
    consumer asks for one.
    """
    keyed = prepare(transactions)
    profile = profile_transactions(keyed)
    history = email_history(customer_history(keyed, profile), profile, totals_from=keyed)
    return derive_features(with_identity(history, identities))


def card_prior_average(transactions: DataFrame, limit: int | None = 20) -> DataFrame:
    """Mean earlier amount per card number, first rows by card and time."""
    narrow = transactions.select(
        "transactionid",
        "card1",
        "transactiondt",
        "transactionamt",
        (F.col("transactionamt") * 100).cast("long").alias("amt_cents"),
    )
    profile = profile_order(narrow, *ORDER, keys=("card1",))
    out = prefix_aggregate(
        narrow,
        ORDER,
        profile,
        key="card1",
        count="card_n",
        sums={"card_cents": "amt_cents"},
    ).select(
        "transactionid",
        "card1",
        "transactiondt",
        "transactionamt",
        prior_average("card_cents", "card_n").alias("card_avg_amt_before_this"),
    )
    if limit is None:
        return out
    return out.orderBy(F.col("card1").asc_nulls_last(), *ORDER).limit(limit)
