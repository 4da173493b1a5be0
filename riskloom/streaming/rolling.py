"""Rolling spend of arrivals: sliding windows over event time, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions import expressions as E


def spend_windows(arrivals: DataFrame, seconds: int, step: int, delay: int) -> DataFrame:
    """uid, window_end, n, cents of each window of ``seconds`` that ends at a multiple of ``step``.

    A stream gives a window once, when the watermark (``delay`` seconds behind the latest arrival) has
    passed its end. Rows are summed before they move, so a busy customer costs a row per task and window.
    """
    timed = arrivals.select(
        E.customer_key().alias("uid"),
        F.timestamp_seconds("transactiondt").alias("at"),
        (F.col("transactionamt") * 100).cast("long").alias("amt_cents"),
    )
    window = F.window("at", f"{seconds} seconds", f"{step} seconds")
    totals = timed.withWatermark("at", f"{delay} seconds").groupBy("uid", window).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amt_cents"), F.lit(0)).alias("cents")
    )
    return totals.select("uid", F.unix_timestamp("window.end").alias("window_end"), "n", "cents")


def start_spend(stream: DataFrame, path: str, seconds: int, step: int, delay: int) -> StreamingQuery:
    """Append closed windows to Parquet files below ``path``; the sink's own log keeps repeated batches apart."""
    writer = spend_windows(stream, seconds, step, delay).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/windows")


def late_in_windows(closed: DataFrame, arrivals: DataFrame, seconds: int, step: int) -> DataFrame:
    """Every window up to the last closed one, with late_n and late_cents: what came for it after it had been given.

    ``arrivals`` are all rows that have come. A window that got late rows only was never given: n and cents are 0.
    """
    last = closed.agg(F.max("window_end").alias("last"))  # one row
    full = spend_windows(arrivals, seconds, step, 0).select(
        "uid", "window_end", F.col("n").alias("_n"), F.col("cents").alias("_cents")
    )
    full = full.join(last, F.col("window_end") <= F.col("last")).drop("last")
    given = {c: F.coalesce(c, F.lit(0)) for c in ("n", "cents")}
    joined = full.join(closed, ["uid", "window_end"], "left").withColumns(given)
    late = {"late_n": F.col("_n") - F.col("n"), "late_cents": F.col("_cents") - F.col("cents")}
    return joined.withColumns(late).drop("_n", "_cents")
