"""The keyed table: new keys only, whatever is sent again, and only the groups that may hold an old one are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.sources import keyed


def rows(spark, low, high, order=0, value=0):
    return spark.range(low, high).select(
        F.col("id").alias("transactionid"), F.lit(value).alias("v"), (F.col("id") * 10 + order).alias("ingest_order")
    )


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "GROUP_KEYS", 100)
    return keyed.KeyedTable(spark, str(tmp_path / "t"))


def test_filters_rule_out_most_and_lose_none():
    draw = np.random.default_rng(1)
    keys = draw.integers(-(2**62), 2**62, 20_000)
    data = keyed.make_filter(keys[:10_000])
    assert keyed.may_have(data, keys[:10_000]).all() and keyed.may_have(data, keys[10_000:]).mean() < 0.01
    assert not keyed.may_have(keyed.make_filter(keys[:0]), keys).any()


def test_first_of_each_key_and_old_ones_stay(spark, table):
    table.load(rows(spark, 0, 500, value=1), 0)
    twice = rows(spark, 400, 700, 5, 2).union(rows(spark, 400, 700, 3, 3)).union(rows(spark, 600, 601, 4, 4))
    table.load(twice, 1)
    got = {r.transactionid: r.v for r in table.read().collect()}
    assert table.read().count() == 700 and got == {i: 1 if i < 500 else 3 for i in range(700)}
    table.load(rows(spark, 0, 0), 2)
    assert table.read().count() == 700


def test_one_old_key_reads_one_group(spark, table):
    table.load(rows(spark, 0, 1000), 0)
    table.load(rows(spark, 5000, 6000), 1)
    assert table.index().select("run", "group").distinct().count() == 20
    asked = spark.createDataFrame([(333,), (7000,), (2500,), (-4,)], "transactionid long")
    folders = table.groups_to_read(table.candidates(asked))
    assert len(folders) == 1
    assert [r.transactionid for r in spark.read.parquet(*folders).filter("transactionid = 333").collect()] == [333]
    assert sorted(r.transactionid for r in table.unknown(asked).collect()) == [-4, 2500, 7000]


def test_a_run_again_replaces_itself(spark, table):
    """Also a run that ended before its index was written."""
    table.load(rows(spark, 0, 300), 0)
    rows(spark, 250, 400).drop("ingest_order").withColumn("group", F.lit("g0")).write.partitionBy("group").parquet(f"{table.path}/rows/run=1")
    assert table.read().count() == 300
    for _ in range(2):
        table.load(rows(spark, 200, 420), 1)
        assert table.read().count() == table.read().select("transactionid").distinct().count() == 420


def test_scattered_ids_and_missing_ones(spark, table):
    odd = spark.range(0, 3000).select(
        F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("transactionid"), F.lit(0).alias("v"), F.col("id").alias("ingest_order")
    )
    table.load(odd.filter("ingest_order < 1000"), 0)
    table.load(odd, 1)
    assert table.read().count() == odd.filter("transactionid is not null").count()
