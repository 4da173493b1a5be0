"""Lookups in the stored history give what the batch job gives, and read little."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import transaction_features
from riskloom.operators.history import History, arrival_features, first_per_id, stored_features
from riskloom.schemas import IDENTITIES
from riskloom.sources import fixtures as X

SF = "/root/testdata/sf0.001"
HALF = 15 * 86400


@pytest.fixture(scope="module")
def rows(spark):
    """Also rows without a time or an e-mail domain, and ties."""
    rows = X.transactions(spark, SF)
    odd = F.col("transactionid") % 97 == 5
    return rows.withColumns(
        {"transactiondt": F.when(odd, None).when(F.col("transactionid") % 89 == 3, 1000).otherwise(F.col("transactiondt"))}
    ).persist()


@pytest.fixture(scope="module")
def no_ids(spark):
    return spark.createDataFrame([], IDENTITIES)


def collect(df):
    return {r.transactionid: r for r in df.collect()}


def test_stored_ids(spark, rows, no_ids, tmp_path):
    """A history stored in three parts, out of order; ids that are not stored have no row."""
    history = History(spark, str(tmp_path / "h"))
    for n in (2, 0, 1):
        history.append(rows.filter(F.col("transactionid") % 3 == n))
    ids = rows.filter("transactionid % 4 = 1").select("transactionid").union(spark.range(10**7, 10**7 + 3).toDF("transactionid"))
    got = collect(stored_features(history, no_ids, ids.union(ids)))
    full = collect(transaction_features(rows, no_ids))
    assert got == {i: r for i, r in full.items() if i % 4 == 1}


def test_arrivals(spark, rows, no_ids, tmp_path):
    """New ids, stored ids and ids sent twice together; late ones too."""
    is_new = F.col("transactionid") % 3 == 0
    history = History(spark, str(tmp_path / "h"))
    history.append(rows.filter(~is_new))
    new = rows.filter(is_new).withColumn("isfraud", F.lit(None).cast("int"))
    sent = new.union(rows.filter("transactionid % 50 = 1")).withColumn("place", F.lit(1))
    again = new.filter("transactionid % 2 = 0").withColumns({"card1": F.lit(1), "place": F.lit(2)})
    got = collect(arrival_features(history, no_ids, again.unionByName(sent), "place"))
    full = collect(transaction_features(rows.filter(~is_new).unionByName(new), no_ids))
    assert got == {i: r for i, r in full.items() if i % 3 == 0 or i % 50 == 1}


def test_first_by_place_not_by_value(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 3, "c"), (1, 9, "a"), (2, 1, "x")], "transactionid long, v int, place string")
    assert sorted(map(tuple, first_per_id(rows, "place").collect())) == [(1, 9), (2, 1)]
    assert sorted(map(tuple, first_per_id(rows.drop("place"), None).collect())) == [(1, 3), (2, 1)]


def test_only_folders_with_a_wanted_slice_are_read(spark, rows, no_ids, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    history.append(rows.filter("transactiondt is not null"))
    slices = spark.createDataFrame([("p_emaildomain", "=gmail.com", 30, 1)], "kind string, key string, slice long, folder long")
    plan = history.slice_rows(slices)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*folder.*1", plan)
    assert {r.at // 3600 for r in history.slice_rows(slices).collect()} <= {30}
    files = {f.split("/folder=")[1].split("/")[0] for f in spark.read.parquet(f"{tmp_path}/h/rows").filter("kind = 'p_emaildomain'").inputFiles()}
    assert len(files) > 5
