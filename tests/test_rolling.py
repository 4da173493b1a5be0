"""Rolling spend equals a search through all rows, in any range; windows of a stream equal the batch operator's."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import prefix, rolling
from riskloom.operators.features import prepare
from riskloom.sources import fixtures as X
from riskloom.streaming import live
from riskloom.streaming import rolling as stream_rolling

SF = "/root/testdata/sf0.001"


def made(seed, n=250):
    draw = random.Random(seed)
    return [
        (i, draw.choice([None, "hot", "hot", "hot", f"k{draw.randrange(9)}"]), draw.choice([None, draw.randrange(-50, 400), 7]), draw.randrange(100))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_spend(spark, seed):
    """Ties, missing keys and times, negative times; a hot key of many slices."""
    rows = made(seed)
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    got = {r.id: (r.rolling_n, r.rolling_cents) for r in rolling.rolling_spend(df, 60, "k", "t", "v").collect()}
    for i, k, t, _ in rows:
        near = [r for r in rows if r[1] == k and (r[2] is None if t is None else r[2] is not None and t - 60 <= r[2] <= t)]
        assert got[i] == (len(near), sum(r[3] for r in near))


def test_ranges_asked_for_apart_from_rows(spark):
    rows = made(3)
    totals = rolling.time_totals(spark.createDataFrame(rows, "id long, k string, t long, v long"), "k", "t", "v")
    asked = [("hot", 0, 10), ("hot", 0, 10), ("hot", 500, 600), ("none", 0, 9), (None, -50, 400), ("hot", 7, 7)]
    found = rolling.range_totals(totals, spark.createDataFrame(asked, "k string, low long, high long"), "k", "t").collect()
    assert len(found) == 5
    for r in found:
        near = [x for x in rows if x[1] == r.k and x[2] is not None and r.low <= x[2] <= r.high]
        assert (r.n, r.cents) == (len(near), sum(x[3] for x in near))


def test_no_task_has_a_whole_hot_key(spark):
    """The ends of ranges are placed by slices: no window group of the domain with 45 % of all rows is near that size."""
    keyed = prepare(X.transactions(spark, "/root/testdata/sf0.01"))
    profile = prefix.profile_order(keyed, "transactiondt", "transactionid", ("p_emaildomain",))
    sliced = prefix.assign_slices(keyed, profile, "transactiondt", "transactionid", "p_emaildomain")
    groups = sliced.groupBy("p_emaildomain", prefix.SLICE).count()
    assert groups.agg(F.max("count")).first()[0] < 0.03 * keyed.count()


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, k string, t long, v long")
    assert rolling.rolling_spend(empty, 60, "k", "t", "v").collect() == []


def test_stream_windows_equal_the_batch_operator(spark, tmp_path):
    """Rows in time, rows late within the watermark, rows beyond it."""
    rows = X.transactions(spark, SF).select(*live.ARRIVING.names).persist()
    day = 86400
    soon, old = F.col("transactionid") % 40 == 3, F.col("transactionid") % 50 == 7
    bounds = [(0, 10), (10, 20), (20, 31)]
    source, path = str(tmp_path / "in"), str(tmp_path / "spend")
    for n, (low, high) in enumerate(bounds):
        dt = F.col("transactiondt")
        part = rows.filter((dt >= low * day) & (dt < high * day) & ~old & ~(soon & (dt >= (high - 0.2) * day)))
        if n:
            part = part.union(rows.filter(soon & ~old & (dt >= (low - 0.2) * day) & (dt < low * day)))
        if n == 2:
            part = part.union(rows.filter(old & (dt < low * day)))
        part.coalesce(1).write.mode("append").parquet(source)
        stream_rolling.start_spend(live.arrivals_stream(spark, source), path, day, day // 4, day // 2).awaitTermination()
    arrived = spark.read.schema(live.ARRIVING).parquet(source)
    closed = spark.read.parquet(f"{path}/windows")
    found = stream_rolling.late_in_windows(closed, arrived, day, day // 4).collect()
    assert closed.select("uid", "window_end").distinct().count() == closed.count()

    keyed = prepare(arrived).select("uid", "transactiondt", "amt_cents")
    asked = spark.createDataFrame([(r.uid, r.window_end - day, r.window_end - 1) for r in found], "uid string, low long, high long")
    totals = rolling.time_totals(keyed, "uid", "transactiondt", "amt_cents")
    batch = {(r.uid, r.high + 1): (r.n, r.cents) for r in rolling.range_totals(totals, asked, "uid", "transactiondt").collect()}
    assert {(r.uid, r.window_end): (r.n + r.late_n, r.cents + r.late_cents) for r in found} == batch
    late = {(r.uid, r.window_end) for r in found if r.late_n}
    olds = prepare(rows.filter(old & (F.col("transactiondt") < 20 * day))).select("uid", "transactiondt").collect()
    assert late <= {(r.uid, (r.transactiondt // (day // 4) + k) * (day // 4)) for r in olds for k in range(1, 5)} and late
    rows.unpersist()
