"""Per-row expressions shared by the batch, lookup and streaming jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400


def plain_number(col: Column) -> Column:
    """Text of a float code, without a trailing ``.0`` when it is whole."""
    return F.when(col == F.floor(col), col.cast("long").cast("string")).otherwise(
        col.cast("string")
    )


def customer_key(card: str = "card1", address: str = "addr1") -> Column:
    """card number + '_' + address code; a missing part never nulls the key."""
    return F.concat(
        F.coalesce(F.col(card).cast("string"), F.lit("")),
        F.lit("_"),
        F.coalesce(plain_number(F.col(address)), F.lit("NA")),
    )


def account_age() -> Column:
    return F.coalesce(F.col("d1").cast("double"), F.lit(0.0))


def linkage_score() -> Column:
    return F.coalesce(F.col("c1").cast("double"), F.lit(0.0)) + F.coalesce(
        F.col("c2").cast("double"), F.lit(0.0)
    )


def match_mismatches() -> Column:
    """How many of m1..m4 are anything but a clean 'T' (NULL counts)."""
    total = F.lit(0)
    for name in ("m1", "m2", "m3", "m4"):
        total = total + (~F.col(name).eqNullSafe("T")).cast("int")
    return total


def _div(col: str, by: int) -> Column:
    return F.expr(f"{col} div {by}")


def hour_of_day(time: str = "transactiondt") -> Column:
    return _div(time, SECONDS_PER_HOUR) % 24


def day_of_week(time: str = "transactiondt") -> Column:
    return _div(time, SECONDS_PER_DAY) % 7


def day_number(time: str = "transactiondt") -> Column:
    return _div(time, SECONDS_PER_DAY)


def high_velocity(gap_seconds: int = 300) -> Column:
    """No identity record and a short gap; an unknown gap does not count."""
    quick = (F.col("has_identity") == 0) & (F.col("seconds_since_last_txn") < gap_seconds)
    return F.when(quick, 1).otherwise(0)


def elapsed_label(time: str = "transactiondt") -> Column:
    return F.format_string(
        "Day %d, %02d:%02d",
        _div(time, SECONDS_PER_DAY),
        _div(f"({time} % {SECONDS_PER_DAY})", SECONDS_PER_HOUR),
        _div(f"({time} % {SECONDS_PER_HOUR})", 60),
    )


def offset_seconds(stamp: str, origin: str = "2019-01-01") -> Column:
    """Whole seconds from midnight of ``origin`` to a wall-clock timestamp.

    A timestamp without zone is read as it stands, so for such columns the
    session zone plays no part.
    """
    first = (date.fromisoformat(origin) - date(1970, 1, 1)).days * SECONDS_PER_DAY
    return F.unix_timestamp(F.col(stamp).cast("timestamp_ntz")) - F.lit(first)


def coerce_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as double; text that is no number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
