"""Features of some given transactions without computing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import coerce_double
from riskloom.operators.features import (
    HISTORY_INPUTS,
    INPUTS,
    ORDER,
    customer_history,
    derive_features,
    email_history,
    prepare,
    profile_transactions,
    with_identity,
)
from riskloom.operators.split import before_row
from riskloom.schemas import MODEL_FEATURES
from riskloom.session import materialise


def features_for_ids(
    transactions: DataFrame, identities: DataFrame, ids: DataFrame
) -> DataFrame:
    """Feature rows of the transactions named in ``ids`` (column transactionid).

    An id filter cannot move below a window by itself, so the history is cut
    here: the customer part reads only the wanted customers, the e-mail part
    only the wanted domains, each before its window, and neither reads rows after the
    last wanted one. In a hot customer or domain
    only the time slices that hold a wanted row are sorted; the others enter as
    pre-aggregated totals.
    """
    ids = ids.select("transactionid").distinct()
    keyed = prepare(transactions)
    # Read by four joins below, so it is found once and kept.
    targets = materialise(keyed.join(ids, "transactionid", "left_semi"), "lookup")
    wanted = targets.select("transactionid")
    # Nothing after the last wanted row is read: plain comparisons, which reach the scan.
    last = targets.agg(F.max(F.struct(*ORDER))).first()[0]
    if last is not None and last[0] is not None:
        reached = before_row(ORDER, tuple(last)) | (F.col("transactionid") == last[1])
        keyed = prepare(transactions.filter(reached | F.col("transactiondt").isNull()))
    profile = profile_transactions(keyed)

    history = keyed.select(*HISTORY_INPUTS)
    only = targets.select(*HISTORY_INPUTS)
    customers = customer_history(history, profile, only=only).select(
        "transactionid", "uid_txn_count_before_this", "uid_cents_before_this", "uid_last_dt"
    )
    domains = email_history(history, profile, only=only).select(
        "transactionid", "email_txn_count_before_this"
    )
    for part in (customers, domains):
        found = part.join(wanted, "transactionid", "left_semi")
        targets = targets.join(found, "transactionid")
    return derive_features(with_identity(targets, identities))


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row per id, of differing ones the least; copies collapse before they move."""
    rest = [c for c in rows.columns if c != "transactionid"]
    least = rows.groupBy("transactionid").agg(F.min(F.struct(*rest)).alias("row"))
    return least.select("transactionid", "row.*").select(*rows.columns)


def features_for_new(
    history: DataFrame, identities: DataFrame, arrivals: DataFrame
) -> DataFrame:
    """Features of transactions that are not stored yet, from what is known of them.

    Columns an arrival lacks are NULL, its label among them. An id that is
    already stored keeps its stored row; of an id sent several times one row counts.
    """
    known = [c for c in INPUTS if c in arrivals.columns and c != "isfraud"]
    fresh = one_per_id(arrivals.select(*known)).join(
        history.select("transactionid").distinct(), "transactionid", "left_anti"
    )
    together = history.select(*INPUTS).unionByName(fresh, allowMissingColumns=True)
    return features_for_ids(together, identities, arrivals)


def model_inputs(features: DataFrame) -> DataFrame:
    """Id plus the model's columns, every one a double; no-numbers become NULL."""
    return coerce_double(features.select("transactionid", *MODEL_FEATURES), MODEL_FEATURES)


def high_water(transactions: DataFrame, default_id: int = 3_000_000) -> DataFrame:
    """Next free id and the latest time, for incremental loads."""
    return transactions.agg(
        (F.coalesce(F.max("transactionid"), F.lit(default_id)) + 1).alias("next_id"),
        F.max("transactiondt").alias("max_dt"),
    )
