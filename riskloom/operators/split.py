"""Splits by position in time order, found without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.features import ORDER

CELLS = 4096


def _histogram(rows: DataFrame, column: str, low: int, high: int) -> tuple[list, int]:
    width = (high - low) // CELLS + 1
    cells = (
        rows.groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("cell"))
        .count()
        .orderBy("cell")
        .collect()
    )
    return cells, width


def row_at(df: DataFrame, columns: list[str], position: int) -> tuple | None:
    """Values of ``columns`` in the row at ``position`` (from 0) of their order.

    Counts rows in at most 4,096 equal cells of the first column's range, keeps
    the cell the position falls in and repeats inside it; when a cell is a
    single value, goes on with the next column. Each pass is one filtered,
    pre-aggregated count, and a 64-bit range needs no more than six of them.
    The columns are whole numbers; together they are a key.
    """
    rows = df.select(*columns)
    fixed: list[int] = []
    for column in columns:
        size = rows.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
        total, low, high = size
        if position < 0 or position >= total:
            return None
        while high > low:
            cells, width = _histogram(rows, column, low, high)
            for cell, count in cells:
                if position < count:
                    break
                position -= count
            low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
            rows, total = rows.filter(F.col(column).between(low, high)), count
        fixed.append(low)
    return tuple(fixed)


def before_row(columns: list[str], row: tuple) -> Column:
    """True for rows that come before ``row``; plain comparisons, so they push down."""
    condition = F.lit(False)
    for name, value in reversed(list(zip(columns, row))):
        condition = (F.col(name) < value) | ((F.col(name) == value) & condition)
    return condition


def split_by_time(
    df: DataFrame, first_fraction: float = 0.8, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """Add ``side``: the first rows by (time, id), and the rest.

    The cut is one literal (time, id) pair, so the split itself is a filter and
    moves no row.
    """
    rows = df.count()
    cut = row_at(df, ORDER, int(rows * first_fraction))
    if cut is None:
        return df.withColumn("side", F.lit(names[0]))
    return df.withColumn("side", F.when(before_row(ORDER, cut), names[0]).otherwise(names[1]))


def split_for_drift(df: DataFrame, recent_fraction: float = 0.1) -> DataFrame:
    return split_by_time(df, 1 - recent_fraction, ("reference", "current"))


def split_summary(split: DataFrame) -> DataFrame:
    """Rows and time range of each side."""
    return split.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("transactiondt").alias("min_dt"),
        F.max("transactiondt").alias("max_dt"),
    )


def first_rows(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``columns``, as a filter.

    A sorted limit would pull n rows of every partition into one task.
    """
    cut = row_at(df, columns, n)
    return df if cut is None else df.filter(before_row(columns, cut))
