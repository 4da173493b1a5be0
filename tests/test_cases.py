"""Flags, queue, key figures, decision log, expressions."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from riskloom.functions import expressions as E
from riskloom.operators import cases as C
from riskloom.operators import flagging

FLAGGED = "transactionid long, fraud_probability decimal(6,4), requires_second_approval boolean"
DECISIONS = "id long, transactionid long, analyst_name string, decision string, decided_at timestamp"


def flagged(spark, *rows):
    return spark.createDataFrame([(i, Decimal(p), two) for i, p, two in rows], FLAGGED)


def decisions(spark, *rows):
    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(n, i, who, "escalated", now) for n, (i, who) in enumerate(rows)], DECISIONS
    )


def test_threshold_and_high_value_are_inclusive(spark):
    scored = spark.createDataFrame(
        [(1, 0.07, Decimal("500.00"), 1), (2, 0.0699999, Decimal("999.00"), 2), (3, 0.5, Decimal("499.99"), 3)],
        "transactionid long, score double, transactionamt decimal(10,2), transactiondt long",
    )
    got = {r.transactionid: r for r in flagging.flag(scored).collect()}
    assert set(got) == {1, 3}
    assert got[1].requires_second_approval and not got[3].requires_second_approval
    assert got[1].fraud_probability == Decimal("0.0700")
    assert [r.transactionid for r in flagging.flag(scored, since=2).collect()] == [3]


def test_any_decision_closes_a_case(spark):
    cases = flagged(spark, (1, "0.9", True), (2, "0.8", False))
    decided = decisions(spark, (1, "ann"), (1, "ann"))
    assert [r.transactionid for r in C.pending_cases(cases, decided).collect()] == [2]


def test_strict_mode_needs_two_analysts(spark):
    cases = flagged(spark, (1, "0.9", True), (2, "0.8", False), (3, "0.7", True))
    decided = decisions(spark, (1, "ann"), (1, "ann"), (2, "ann"), (3, "ann"), (3, "bob"))
    left = C.pending_cases(cases, decided, strict=True).collect()
    assert [r.transactionid for r in left] == [1]


def context(spark, *rows):
    columns = ["transactionid", *C.CONTEXT_COLUMNS]
    kinds = {"transactionamt": "decimal(10,2)", "transactiondt": "long", "card1": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string' if c != 'transactionid' else 'long')}" for c in columns)
    full = [
        tuple({"transactionid": i, "transactionamt": Decimal(a), "transactiondt": 90061}.get(c) for c in columns)
        for i, a in rows
    ]
    return spark.createDataFrame(full, schema)


def test_queue_order_limit_and_empty(spark):
    cases = flagged(spark, (1, "0.5", False), (2, "0.9", True), (3, "0.5", False), (4, "0.99", False))
    tx = context(spark, (1, "10"), (2, "20"), (3, "30"))
    ids = spark.createDataFrame([(2, "mobile", None)], "transactionid long, devicetype string, deviceinfo string")
    none = decisions(spark).limit(0)
    top = C.case_queue(cases, tx, ids, none, limit=2)
    assert [(r.transactionid, r.devicetype) for r in top.collect()] == [(2, "mobile"), (1, None)]
    assert C.case_queue(cases, tx, ids, none, limit=None).count() == 3
    words = {r.transactionid: r for r in C.case_context(top).collect()}
    assert words[2].approval_tag == "SECOND APPROVAL REQUIRED" and words[1].approval_tag == ""
    assert words[1].transaction_time == "Day 1, 01:01"
    all_decided = decisions(spark, (1, "a"), (2, "a"), (3, "a"), (4, "a"))
    empty = C.case_queue(cases, tx, ids, all_decided)
    row = C.queue_kpis(empty, cases, tx, all_decided).first()
    assert (row.cases_in_queue, row.value_at_risk, row.avg_risk) == (0, 0, 0.0)
    assert C.pending_value(cases, tx, all_decided).first()[0] == 0
    assert C.pending_count(cases, all_decided).first()[0] == 0


def test_filter_queue(spark):
    queue = flagged(spark, (1, "0.5", False), (2, "0.9", True)).withColumn(
        "transactionamt", F.col("transactionid") * 100
    )
    ids = lambda df: sorted(r.transactionid for r in df.collect())
    assert ids(C.filter_queue(queue)) == [1, 2]
    assert ids(C.filter_queue(queue, "2")) == [2]
    assert ids(C.filter_queue(queue, "two")) == []
    assert ids(C.filter_queue(queue, None, 0.5, 150.0)) == [2]


def test_funnel_of_the_last_rows(spark):
    start = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(i, i % 3 == 0, start + dt.timedelta(seconds=i)) for i in range(40)],
        "transactionid long, was_flagged boolean, processed_at timestamp",
    )
    assert tuple(C.activity_funnel(log).first()) == (15, 5, 10)
    assert tuple(C.activity_funnel(log, None).first()) == (40, 14, 26)
    assert tuple(C.activity_funnel(log.limit(0)).first()) == (0, 0, 0)


def test_decision_ids_continue(spark):
    log = decisions(spark, (1, "ann"), (2, "bob"))
    new = decisions(spark, (7, "ann"), (5, "bob")).drop("id")
    got = C.number_decisions(new, log).collect()
    assert sorted((r.id, r.transactionid) for r in got) == [(2, 5), (3, 7)]


def test_fraud_rate_ignores_unlabelled(spark):
    tx = spark.createDataFrame([(1, 0), (5, 1), (9, None), (86400, 0)], "transactiondt long, isfraud int")
    got = {r.day: r for r in C.fraud_rate_trend(tx).collect()}
    assert (got[0].n_transactions, got[0].fraud_rate, got[1].fraud_rate) == (2, 0.5, 0.0)


def test_offset_seconds_ignores_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2019-06-15 14:30:05.9' AS t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    expected = int((dt.datetime(2019, 6, 15, 14, 30, 5) - dt.datetime(2019, 1, 1)).total_seconds())
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.select(E.offset_seconds("t")).first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_coerce_double(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r.v for r in E.coerce_double(df, ["v"]).collect()] == [1.5, None, None]
