"""Extract, prune, merge, split, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.functions.expressions import nan_to_null
from riskloom.operators.quality import check_rows, rejected_rows, valid_rows
from riskloom.schemas import IDENTITIES, IDENTITY_COLUMNS, TRANSACTION_COLUMNS, TRANSACTIONS
from riskloom.session import grown, materialise, temporary
from riskloom.sources.tables import (
    append,
    keep_first,
    load_if_absent,
    read_target,
    read_text,
    runs,
    sample_identities,
    sample_transactions,
)

INGEST_ORDER = "ingest_order"


def prune_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in wanted order; letter case is ignored."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[df[f"`{have[c]}`"].alias(c) for c in wanted if c in have])


def merge(transactions: DataFrame, identities: DataFrame) -> DataFrame:
    """Every transaction with its identity columns, where there are any."""
    left = prune_columns(transactions, TRANSACTION_COLUMNS + [INGEST_ORDER])
    right = prune_columns(identities, IDENTITY_COLUMNS)
    return nan_to_null(left.join(grown(right), "transactionid", "left"))


def split_merged(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to two tables; identity rows without any value are dropped."""
    transactions = prune_columns(merged, TRANSACTION_COLUMNS)
    identities = prune_columns(merged, IDENTITY_COLUMNS)
    values = [c for c in identities.columns if c != "transactionid"]
    return transactions, identities.na.drop(how="all", subset=values)


def run_etl(
    transactions: DataFrame,
    identities: DataFrame,
    target_transactions: DataFrame,
    target_identities: DataFrame,
    sample_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows to append to both target tables.

    Both sources carry ``ingest_order``, by which the first copy of a key wins.
    """
    if sample_rows is not None:
        transactions = sample_transactions(transactions, sample_rows)
        identities = sample_identities(identities, transactions)
    merged = merge(transactions, keep_first(identities).drop(INGEST_ORDER))
    _, new_i = split_merged(merged)
    new_t = prune_columns(merged, TRANSACTION_COLUMNS + [INGEST_ORDER])
    # Copies of a transaction carry the same identity values, so any one will do.
    new_i = new_i.dropDuplicates(["transactionid"]).join(
        grown(target_identities.select("transactionid")), "transactionid", "left_anti"
    )
    return load_if_absent(new_t, target_transactions), new_i


def checked_file(
    spark: SparkSession, path: str, table: str, schema: T.StructType, parents: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid rows of a CSV file or folder with their ingest order, and rejects as text with reasons."""
    raw = materialise(read_text(spark, path, schema, INGEST_ORDER), f"raw-{table}")
    checked = materialise(check_rows(raw, table, schema, parents=parents), f"checked-{table}")
    order = T.StructType([*schema.fields, raw.schema[INGEST_ORDER]])
    return valid_rows(checked, order), rejected_rows(checked)


def etl_files(
    spark: SparkSession,
    transactions_path: str,
    identities_path: str,
    target: str,
    sample_rows: int | None = None,
    run: int | None = None,
) -> int:
    """From CSV files to the tables ``transactions`` and ``identities`` below ``target``; returns the run's number.

    Rows that break a table rule go to ``rejects_<table>``, by run, with their reasons and place; a run that is
    repeated under its number replaces its own rejects only. An identity whose transaction is neither in the
    target nor among the valid rows is rejected too, and can be loaded by a later run that has its transaction.
    Ids that the tables have are left alone, so a second run adds nothing to them.
    """
    rejects = {t: f"{target}/rejects_{t}" for t in ("transactions", "identities")}
    if run is None:
        run = 1 + max([-1, *(n for path in rejects.values() for n in runs(spark, path))])
    with temporary(spark):
        transactions, bad_t = checked_file(spark, transactions_path, "transactions", TRANSACTIONS)
        have_t = read_target(spark, f"{target}/transactions", TRANSACTIONS)
        parents = transactions.select("transactionid").union(have_t.select("transactionid")).distinct()
        identities, bad_i = checked_file(spark, identities_path, "identities", IDENTITIES, parents)
        have_i = read_target(spark, f"{target}/identities", IDENTITIES)
        new_t, new_i = run_etl(transactions, identities, have_t, have_i, sample_rows)
        # Settled before anything is appended to what it was compared with.
        new_t, new_i = materialise(new_t, "new-transactions"), materialise(new_i, "new-identities")
        for table, rows in (("transactions", bad_t), ("identities", bad_i)):
            rows.write.mode("overwrite").parquet(f"{rejects[table]}/run={run}")
        append(new_t, f"{target}/transactions")
        append(new_i, f"{target}/identities")
    return run
