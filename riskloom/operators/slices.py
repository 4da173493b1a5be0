"""Transactions as rows per key and slice of time, for steps that know the past by totals of whole slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import expressions as E

#: Seconds of a slice: customers have few rows, domains many.
SLICE_SECONDS = {"uid": 30 * 86400, "p_emaildomain": 3600}
#: Stands for a missing time, which comes before all others.
NO_TIME = -(1 << 62)


def with_keys(transactions: DataFrame) -> DataFrame:
    """Adds uid and cents."""
    cents = (F.col("transactionamt") * 100).cast("long")
    return transactions.withColumns({"uid": E.customer_key(), "cents": cents})


def keyed_rows(rows: DataFrame, whole: Column | None = None) -> DataFrame:
    """Two narrow rows per transaction (with uid and cents), for its customer and for its domain.

    Columns kind, key, slice, at, id, cents; ``whole`` goes along with the customer's. Keys are never null: ''
    is the missing one, others begin with '='.
    """
    at = F.coalesce("transactiondt", F.lit(NO_TIME))

    def one(kind: str, seconds: int) -> Column:
        columns = {
            "kind": F.lit(kind),
            "key": F.coalesce(F.concat(F.lit("="), F.col(kind)), F.lit("")),
            "slice": F.floor(at / seconds),
            "at": at,
            "id": F.col("transactionid"),
            "cents": F.coalesce("cents", F.lit(0)),
        }
        if whole is not None:
            columns["whole"] = F.when(F.lit(kind == "uid"), whole)
        return F.struct(*[value.alias(name) for name, value in columns.items()])

    kinds = F.array(*[one(kind, seconds) for kind, seconds in SLICE_SECONDS.items()])
    return rows.select(F.explode(kinds).alias("row")).select("row.*")
