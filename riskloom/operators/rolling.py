"""Spend of a key over a range of time, as the difference of two prefix sums.

A window with a RANGE frame sorts a whole key in one task. Here the question "how much between these two times" becomes two
points in the key's order, one just before the range and one at its end, put among the rows; ``prefix_aggregate`` cuts hot
keys into slices and carries totals from slice to slice, so each point learns the total before it wherever the range begins, and
the difference of the two is the answer. No row meets the other rows of its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import prefix_aggregate, profile_order
from riskloom.session import materialise

#: Places at one time: the range's start, the rows, the range's end.
_START, _ROW, _END = 0, 1, 2


def time_totals(rows: DataFrame, key: str, time: str, cents: str) -> DataFrame:
    """Rows and cents of each key and time, pre-aggregated; columns key, time, n, cents."""
    return rows.groupBy(key, time).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cents), F.lit(0)).alias("cents"))


def range_totals(totals: DataFrame, asked: DataFrame, key: str, time: str) -> DataFrame:
    """n and cents of ``totals`` with low <= time <= high, for each distinct (key, low, high) of ``asked``.

    A range without rows has 0. A missing key is a key; a missing time comes before all others, so it is in
    ranges only that begin without one.
    """

    def event(place: int, at: str, n: Column, cents: Column) -> list[Column]:
        return [F.col(at).alias("at"), F.lit(place).alias("place"), n.alias("n"), cents.alias("cents")]

    none = F.lit(0).cast("long")
    rows = totals.select(key, *event(_ROW, time, F.col("n"), F.col("cents")), *[F.lit(None).cast("long").alias(c) for c in ("low", "high")])
    ends = [F.struct(*event(place, at, none, none), "low", "high") for place, at in ((_START, "low"), (_END, "high"))]
    points = asked.select(key, "low", "high").distinct().select(key, F.explode(F.array(*ends)).alias("end")).select(key, "end.*")
    events = materialise(rows.unionByName(points), "ranges")
    profile = profile_order(events, "at", "place", keys=(key,))
    placed = prefix_aggregate(events, ["at", "place"], profile, key=key, sums={"n_before": "n", "cents_before": "cents"})
    sign = F.when(F.col("place") == _END, 1).otherwise(-1)

    def difference(column: str) -> Column:
        return F.sum(sign * F.coalesce(F.col(column), F.lit(0)))

    ends = placed.filter(F.col("place") != _ROW).groupBy(key, "low", "high")
    return ends.agg(difference("n_before").alias("n"), difference("cents_before").alias("cents"))


def rolling_spend(rows: DataFrame, seconds: int, key: str = "uid", time: str = "transactiondt", cents: str = "amt_cents") -> DataFrame:
    """Adds rolling_n and rolling_cents: rows of the key in the ``seconds`` up to a row's time, itself and rows of its time among them."""
    totals = materialise(time_totals(rows, key, time, cents), "time-totals")
    asked = totals.select(key, (F.col(time) - seconds).alias("low"), F.col(time).alias("high"))
    found = range_totals(totals, asked, key, time).select(
        F.col(key).alias("_key"), F.col("high").alias("_time"), F.col("n").alias("rolling_n"), F.col("cents").alias("rolling_cents")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(time).eqNullSafe(F.col("_time"))
    return rows.join(found, same).drop("_key", "_time")
