"""The live job as a streaming query: equal to the batch job, late and repeated rows, restart, intermediates."""

import threading

import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import OUTPUTS, transaction_features
from riskloom.schemas import IDENTITIES
from riskloom.session import materialise, temporary
from riskloom.sources import fixtures as X
from riskloom.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return X.transactions(spark, SF).select(*live.ARRIVING.names).persist()


@pytest.fixture(scope="module")
def no_ids(spark):
    return spark.createDataFrame([], IDENTITIES)


def collect(df):
    return {r.transactionid: r for r in df.collect()}


def arrive(store, identities, source, *parts, scorer=None):
    """Each part is a file, and a micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    spark = parts[0].sparkSession
    stream = live.arrivals_stream(spark, source, max_files=1)
    live.start(stream, identities, store, scorer, available_now=True).awaitTermination()


def test_history_late_and_repeated_rows_and_a_restart(spark, rows, no_ids, tmp_path):
    """A stored history, a micro-batch in time, then after a restart one with late rows and ids that came before or come twice."""
    store, source = live.LiveTables(str(tmp_path / "live")), str(tmp_path / "in")
    live.seed(rows.filter("transactionid < 100"), store)
    late = F.col("transactionid") == 140
    arrive(store, no_ids, source, rows.filter(F.col("transactionid").between(100, 499) & ~late), scorer=X.rule_score)
    resent = rows.filter("transactionid % 7 = 0 or transactionid < 90").withColumn("card1", F.lit(1))
    last = rows.filter((F.col("transactionid") >= 500) | late)
    arrive(store, no_ids, source, last.coalesce(1).union(resent), scorer=X.rule_score)
    features = store.read(spark, "features")
    assert features.count() == 900 and features.select("batch_id").distinct().count() == 2
    got, full = collect(features), collect(transaction_features(rows, no_ids))
    assert [i for i, r in got.items() if r.is_late] == [140]
    # Rows of the first micro-batch that follow the late one could not know it.
    known = collect(transaction_features(rows.filter((F.col("transactionid") < 500) & ~late), no_ids))
    for i, row in got.items():
        expected = full[i] if i >= 500 or i == 140 else known[i]
        assert [row[c] for c in OUTPUTS] == list(expected)
    log = store.read(spark, "activity")
    assert log.count() == 900 and log.select("transactionid").distinct().count() == 900
    assert store.read(spark, "flagged").count() == log.filter("was_flagged").count() > 0
    assert store.read(spark, "transactions").count() == 1000
    # What the past is known by lies in the engine's state, not in folders by micro-batch.
    names = {p.name for p in (tmp_path / "live").iterdir()}
    assert names == {"checkpoint", "first_state", "transactions", "features", "scores", "activity", "flagged"}


def test_a_batch_that_runs_again_changes_nothing(spark, rows, no_ids, tmp_path):
    store = live.LiveTables(str(tmp_path / "live"))
    live.seed(rows.limit(0), store)
    kept = []
    handler = live.store_batch

    def twice(parts, *rest):
        handler(parts, *rest)
        handler(parts, *rest)
        kept.append(1)

    live.store_batch = twice
    try:
        arrive(store, no_ids, str(tmp_path / "in"), rows, scorer=X.rule_score)
    finally:
        live.store_batch = handler
    assert kept == [1]
    got = collect(store.read(spark, "features").drop("batch_id", "is_late"))
    assert got == collect(transaction_features(rows, no_ids)) and store.read(spark, "activity").count() == 1000


def test_intermediates_of_other_threads_stay(spark):
    """A thread inside ``temporary`` deletes what it has made itself, and nothing that others make meanwhile."""
    begun, made, result = threading.Event(), threading.Event(), {}

    def handler():
        with temporary(spark):
            begun.set()
            made.wait(60)
            result["own"] = materialise(spark.range(3), "thread").inputFiles()
        result["done"] = True

    thread = threading.Thread(target=handler)
    thread.start()
    begun.wait(60)
    mine = materialise(spark.range(5), "main")
    made.set()
    thread.join(60)
    assert result["done"] and mine.count() == 5
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(*result["own"]).count()
