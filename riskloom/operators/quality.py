"""Table rules as a valid/reject split, and deletes that cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import DECISIONS, TEXT_LIMITS
from riskloom.session import grown

# Columns that may not be NULL, per table.
REQUIRED = {
    "transactions": ["transactionid", "isfraud", "transactiondt", "transactionamt", "productcd"],
    "identities": ["transactionid"],
    "analyst_decisions": ["transactionid", "analyst_name", "decision"],
}
ALLOWED = {"isfraud": ["0", "1"], "decision": DECISIONS}


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the first row of each key; many copies of one key
    collapse before they are shuffled."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def check_rows(
    raw: DataFrame,
    table: str,
    schema: T.StructType,
    order: str = "ingest_order",
    key: str | None = "transactionid",
    parents: DataFrame | None = None,
) -> DataFrame:
    """Add ``reasons``: the names of all rules a raw (text) row breaks.

    Type rules use try_cast, so a value that does not fit rejects its row
    rather than the job. Of several rows with one key all but the first break
    the key rule. ``parents`` is the table the key must exist in.
    """
    broken: list[Column] = []

    def rule(name: str, violated: Column) -> None:
        broken.append(F.when(F.coalesce(violated, F.lit(False)), F.lit(name)))

    for name in REQUIRED[table]:
        rule(f"{name}_missing", F.col(name).isNull())
    for field in schema.fields:
        name = field.name
        if name not in raw.columns:
            continue
        if isinstance(field.dataType, T.StringType):
            if name in TEXT_LIMITS:
                rule(f"{name}_too_long", F.length(name) > TEXT_LIMITS[name])
        else:
            fits = F.col(name).try_cast(field.dataType).isNotNull()
            rule(f"{name}_bad_value", F.col(name).isNotNull() & ~fits)
        if name in ALLOWED:
            rule(f"{name}_not_allowed", ~F.col(name).isin(ALLOWED[name]))

    rows = raw
    if key is not None:
        # Joined on (key, order), which is unique, so copies spread out.
        firsts = first_per_key(raw.filter(F.col(key).isNotNull()), key, order)
        rows = rows.join(grown(firsts.withColumn("__first", F.lit(True))), [key, order], "left")
        rule("key_duplicate", F.col(key).isNotNull() & F.col("__first").isNull())
    if parents is not None:
        # Orphans are found among distinct keys, so a parent with very many
        # children weighs no more than any other.
        known = parents.select(F.col("transactionid").cast("string"))
        orphans = (
            raw.select("transactionid")
            .distinct()
            .join(grown(known), "transactionid", "left_anti")
            .withColumn("__orphan", F.lit(True))
        )
        rows = rows.join(grown(orphans), "transactionid", "left")
        rule("parent_missing", F.col("transactionid").isNotNull() & F.col("__orphan").isNotNull())
    return rows.withColumn("reasons", F.array_compact(F.array(*broken))).select(
        *raw.columns, "reasons"
    )


def valid_rows(checked: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows without a broken rule, in their table's types."""
    present = [f for f in schema.fields if f.name in checked.columns]
    return checked.filter(F.size("reasons") == 0).select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in present]
    )


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def cascade_retain(children: DataFrame, parents: DataFrame, key: str = "transactionid") -> DataFrame:
    """Child rows whose parent is still there."""
    return children.join(grown(parents.select(key).distinct()), key, "left_semi")
