"""Loading, pruning, table rules, and publishing."""

import pytest

from riskloom.operators import quality as Q
from riskloom.plans import etl
from riskloom.schemas import ANALYST_DECISIONS, IDENTITIES, TRANSACTION_COLUMNS, TRANSACTIONS
from riskloom.sources import tables as T

RAW = "transactionid string, isfraud string, transactiondt string, transactionamt string, productcd string, ingest_order long"


def test_load_twice_adds_nothing(spark):
    schema = "transactionid long, v string, ingest_order long"
    incoming = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3), (3, "d", 4)], schema)
    existing = spark.createDataFrame([(3, "old")], "transactionid long, v string")
    new = T.load_if_absent(incoming, existing)
    assert sorted(map(tuple, new.collect())) == [(1, "b"), (2, "c")]
    assert T.load_if_absent(incoming, existing.unionByName(new)).count() == 0


def test_load_fills_defaults(spark):
    incoming = spark.createDataFrame([(1, 1)], "transactionid long, ingest_order long")
    empty = spark.createDataFrame([], "transactionid long")
    row = T.load_if_absent(incoming, empty, defaults={"productcd": "W"}).first()
    assert row.productcd == "W"


def test_csv_header_case_and_extra_columns(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("TransactionID,isFraud,V1,TransactionAmt,card1,dist1\n1,0,9,12.50,77,\n2,1,9,oops,,3.5\n")
    rows = T.read_transactions(spark, path, "csv")
    assert rows.columns == ["transactionid", "isfraud", "transactionamt", "card1", "dist1"]
    got = sorted(map(tuple, rows.collect()))
    assert [str(v) for v in got[0]] == ["1", "0", "12.50", "77", "None"]
    assert got[1][2] is None and got[1][4] == 3.5


def test_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 5)], "transactionid long, transactiondt long")
    for fmt in ("json", "orc", "parquet"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).save(path)
        assert T.read_transactions(spark, path, fmt, sample_rows=10).first().transactiondt == 5


def test_prune_skips_what_is_missing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "V9 int, TransactionID int, M1 int")
    assert etl.prune_columns(df, TRANSACTION_COLUMNS).columns == ["transactionid", "m1"]


def test_nan_becomes_null(spark):
    tx = spark.createDataFrame([(1, float("nan"))], "transactionid long, dist1 float")
    ids = spark.createDataFrame([], "transactionid long, devicetype string")
    assert etl.merge(tx, ids).first().dist1 is None


def test_etl(spark):
    tx = spark.createDataFrame(
        [(1, 10, 1), (1, 11, 2), (2, 20, 3), (3, 30, 4)],
        "transactionid long, transactiondt long, ingest_order long",
    )
    ids = spark.createDataFrame(
        [(1, "mobile", 1), (1, "desktop", 2), (2, None, 3), (9, "mobile", 4)],
        "transactionid long, devicetype string, ingest_order long",
    )
    have_t = spark.createDataFrame([(3,)], "transactionid long")
    have_i = spark.createDataFrame([], "transactionid long")
    new_t, new_i = etl.run_etl(tx, ids, have_t, have_i)
    assert sorted((r.transactionid, r.transactiondt) for r in new_t.collect()) == [(1, 10), (2, 20)]
    assert [(r.transactionid, r.devicetype) for r in new_i.collect()] == [(1, "mobile")]


def check(spark, rows):
    df = Q.check_rows(spark.createDataFrame(rows, RAW), "transactions", TRANSACTIONS)
    return {r.ingest_order: r.reasons for r in df.collect()}, df


def test_rules(spark):
    rows = [
        ("1", "0", "5", "12.34", "W", 1),
        ("1", "0", "5", "12.34", "W", 2),
        ("2", "2", "5", "123456789.00", "W", 3),
        ("3", None, "x", "1", "12345678901", 4),
        (None, "1", "5", "1", None, 5),
    ]
    reasons, df = check(spark, rows)
    assert reasons[1] == []
    assert reasons[2] == ["key_duplicate"]
    assert reasons[3] == ["isfraud_not_allowed", "transactionamt_bad_value"]
    assert reasons[4] == ["isfraud_missing", "transactiondt_bad_value", "productcd_too_long"]
    assert reasons[5] == ["transactionid_missing", "productcd_missing"]
    valid = Q.valid_rows(df, TRANSACTIONS)
    assert valid.count() == 1 and valid.schema["transactionamt"].dataType.simpleString() == "decimal(10,2)"
    assert Q.rejected_rows(df).count() == 4


def test_parent_rule(spark):
    parents = spark.createDataFrame([(1,)], "transactionid long")
    raw = spark.createDataFrame(
        [("1", "x" * 60, 1), ("2", "mobile", 2)],
        "transactionid string, devicetype string, ingest_order long",
    )
    got = Q.check_rows(raw, "identities", IDENTITIES, parents=parents).collect()
    assert {r.ingest_order: r.reasons for r in got} == {
        1: ["devicetype_too_long"],
        2: ["parent_missing"],
    }


def test_decision_enum(spark):
    raw = spark.createDataFrame(
        [("1", "ann", "approve", 1), ("1", None, "escalated", 2)],
        "transactionid string, analyst_name string, decision string, ingest_order long",
    )
    got = Q.check_rows(raw, "analyst_decisions", ANALYST_DECISIONS, key=None).collect()
    assert {r.ingest_order: r.reasons for r in got} == {
        1: ["decision_not_allowed"],
        2: ["analyst_name_missing"],
    }


def test_cascade(spark):
    children = spark.createDataFrame([(1,), (2,), (2,)], "transactionid long")
    parents = spark.createDataFrame([(2,), (2,)], "transactionid long")
    assert Q.cascade_retain(children, parents).count() == 2


def test_refresh_keeps_old_runs(spark, tmp_path):
    path = str(tmp_path / "flagged")
    for run, value in ((1, 10), (2, 20), (2, 21)):
        T.publish_refresh(spark.createDataFrame([(value,)], "v int"), path, run)
    assert [r.v for r in T.latest_refresh(spark, path).collect()] == [21]
    assert spark.read.parquet(path).filter("run = 1").count() == 1


def test_time_order_prunes_days(spark, tmp_path, capsys):
    path = str(tmp_path / "tx")
    rows = spark.createDataFrame(
        [(i, i * 3600) for i in range(96)], "transactionid long, transactiondt long"
    )
    T.write_in_time_order(rows, path)
    back = spark.read.parquet(path).filter("day = 2")
    assert back.count() == 24
    back.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_etl_takes_all_rows(spark):
    """No row is lost above any number."""
    rows = spark.range(60_000).selectExpr("id AS transactionid", "id AS transactiondt", "id AS ingest_order")
    devices = spark.createDataFrame([], "transactionid long, devicetype string, ingest_order long")
    have = rows.filter("transactionid < 10").drop("ingest_order")
    new, _ = etl.run_etl(rows, devices, have, devices)
    assert new.count() == 59_990


def test_files_of_two_column_orders_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TransactionID,TransactionDT\n1,10\n")
    (tmp_path / "b.csv").write_text("TransactionDT,TransactionID\n20,2\n")
    with pytest.raises(Exception, match="(?i)header|CSV"):
        T.read_transactions(spark, str(tmp_path), "csv").collect()


def test_files_to_tables(spark, tmp_path):
    """Rejects keep their text and reasons; a second run adds nothing."""
    (tmp_path / "t.csv").write_text(
        "TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD\n"
        "1,0,10,5.00,W\n1,0,11,6.00,W\n2,0,12,123456789012.00,W\n3,7,13,1.00,W\n4,0,14,2.50,C\n"
    )
    (tmp_path / "i.csv").write_text("TransactionID,DeviceType\n1,mobile\n4,\nx,desktop\n2,tablet\n")
    target = str(tmp_path / "target")
    for _ in range(2):
        etl.etl_files(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), target)
        loaded = spark.read.parquet(f"{target}/transactions").orderBy("transactionid").collect()
        assert [(r.transactionid, r.transactiondt, float(r.transactionamt)) for r in loaded] == [(1, 10, 5.0), (4, 14, 2.5)]
        rejects = spark.read.parquet(f"{target}/rejects_transactions").collect()
        assert {(r.transactiondt, *r.reasons) for r in rejects} == {
            ("11", "key_duplicate"), ("12", "transactionamt_bad_value"), ("13", "isfraud_not_allowed"),
        }
        assert [r.devicetype for r in spark.read.parquet(f"{target}/identities").collect()] == ["mobile"]
    rejects = spark.read.parquet(f"{target}/rejects_identities").collect()
    assert sorted((r.run, r.devicetype, *r.reasons) for r in rejects) == [
        (run, device, *reasons)
        for run in (0, 1)
        for device, reasons in (("desktop", ["transactionid_bad_value", "parent_missing"]), ("tablet", ["parent_missing"]))
    ]
    # The refused transaction comes right: its identity can be loaded now. A run under its old number replaces its own rejects.
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD\n2,0,12,7.00,W\n")
    assert etl.etl_files(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), target, run=1) == 1
    assert {r.devicetype for r in spark.read.parquet(f"{target}/identities").collect()} == {"mobile", "tablet"}
    rejects = spark.read.parquet(f"{target}/rejects_identities").collect()
    assert sorted((r.run, r.devicetype) for r in rejects) == [(0, "desktop"), (0, "tablet"), (1, "desktop")]
    assert {r.run for r in spark.read.parquet(f"{target}/rejects_transactions").collect()} == {0}


def test_sides_that_grow_are_not_broadcast(spark, tmp_path):
    """However small Spark takes them for: mostly empty columns weigh nothing in files, and their ids do on the driver."""
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD\n1,0,10,5.00,W\n")
    raw = T.read_text(spark, str(tmp_path / "t.csv"), TRANSACTIONS, "ingest_order")
    checked = Q.check_rows(raw, "transactions", TRANSACTIONS, parents=spark.range(3).selectExpr("id AS transactionid"))
    rows = spark.range(5).selectExpr("id AS transactionid", "id AS transactiondt", "id AS ingest_order")
    devices = spark.createDataFrame([], "transactionid long, devicetype string, ingest_order long")
    for df in (checked, *etl.run_etl(rows, devices, rows.drop("ingest_order"), devices)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
