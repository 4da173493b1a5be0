"""Traps of the feature definitions, on hand-made rows."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import (
    INPUTS,
    email_history,
    prepare,
    profile_transactions,
    transaction_features,
)
from riskloom.operators.lookup import features_for_ids, features_for_new, high_water
from riskloom.schemas import IDENTITIES, TRANSACTIONS

BASE = dict(
    isfraud=0, transactionamt=Decimal("10.00"), productcd="W", card1=1, addr1=315.0,
    p_emaildomain="a.com", d1=1.0, c1=1.0, c2=2.0, m1="T", m2="T", m3="T", m4="T",
)


def frame(spark, rows):
    full = [
        tuple({**BASE, **r}.get(f.name) for f in TRANSACTIONS.fields) for r in rows
    ]
    return spark.createDataFrame(full, TRANSACTIONS)


def ids(spark, rows):
    return spark.createDataFrame(
        [tuple(r.get(f.name) for f in IDENTITIES.fields) for r in rows], IDENTITIES
    )


def run(spark, rows, identities=()):
    out = transaction_features(frame(spark, rows), ids(spark, identities))
    return {r.transactionid: r for r in out.collect()}


def test_customer_key(spark):
    got = run(
        spark,
        [
            dict(transactionid=1, transactiondt=1),
            dict(transactionid=2, transactiondt=2, card1=None),
            dict(transactionid=3, transactiondt=3, addr1=None),
            dict(transactionid=4, transactiondt=4, addr1=315.5),
            dict(transactionid=5, transactiondt=5, card1=None, addr1=None),
        ],
    )
    assert [got[i].uid for i in range(1, 6)] == ["1_315", "_315", "1_NA", "1_315.5", "_NA"]


def test_first_row_and_history(spark):
    got = run(
        spark,
        [
            dict(transactionid=1, transactiondt=100, transactionamt=Decimal("10.10")),
            dict(transactionid=2, transactiondt=250, transactionamt=Decimal("20.20")),
            dict(transactionid=3, transactiondt=700, transactionamt=Decimal("1.00")),
        ],
    )
    assert got[1].uid_avg_amt_before_this is None
    assert got[1].uid_txn_count_before_this == 0
    assert got[1].seconds_since_last_txn is None
    assert got[2].uid_avg_amt_before_this == 10.1
    assert got[3].uid_avg_amt_before_this == 15.15
    assert got[3].seconds_since_last_txn == 450


def test_ties_follow_the_id(spark):
    got = run(spark, [dict(transactionid=i, transactiondt=5) for i in (3, 1, 2)])
    assert [got[i].uid_txn_count_before_this for i in (1, 2, 3)] == [0, 1, 2]
    assert got[3].seconds_since_last_txn == 0


def test_null_email_is_one_group(spark):
    got = run(
        spark,
        [
            dict(transactionid=1, transactiondt=1, p_emaildomain=None),
            dict(transactionid=2, transactiondt=2, p_emaildomain="a.com", card1=2),
            dict(transactionid=3, transactiondt=3, p_emaildomain=None, card1=3),
            dict(transactionid=4, transactiondt=4, p_emaildomain="", card1=3),
        ],
    )
    assert [got[i].email_txn_count_before_this for i in (1, 2, 3, 4)] == [0, 0, 1, 0]


@pytest.mark.parametrize("gap, expected", [(299, 1), (300, 0), (301, 0)])
def test_high_velocity_gap(spark, gap, expected):
    got = run(
        spark, [dict(transactionid=1, transactiondt=0), dict(transactionid=2, transactiondt=gap)]
    )
    assert got[2].no_identity_high_velocity == expected
    assert got[1].no_identity_high_velocity == 0


def test_identity_stops_high_velocity(spark):
    rows = [dict(transactionid=1, transactiondt=0), dict(transactionid=2, transactiondt=9)]
    got = run(spark, rows, [dict(transactionid=2, devicetype="mobile")])
    assert (got[2].has_identity, got[2].devicetype) == (1, "mobile")
    assert (got[1].has_identity, got[1].devicetype) == (0, None)
    assert got[2].no_identity_high_velocity == 0


def test_row_features(spark):
    got = run(
        spark,
        [
            dict(transactionid=1, transactiondt=86400 * 8 + 3600 * 5 + 59, d1=None, c1=None,
                 c2=2.0, m1=None, m2="F", m3="T", m4="X"),
        ],
    )[1]
    assert (got.account_age_days, got.identity_linkage_score, got.match_flag_count) == (0.0, 2.0, 3)
    assert (got.hour_of_day, got.day_of_week) == (5, 1)


def test_negative_offset_truncates(spark):
    got = run(spark, [dict(transactionid=1, transactiondt=-1)])[1]
    assert (got.hour_of_day, got.day_of_week) == (0, 0)


def sample_rows():
    return [
        dict(transactionid=i, transactiondt=(i * 37) % 101, card1=i % 3,
             p_emaildomain=[None, "a.com"][i % 2], transactionamt=Decimal(i))
        for i in range(60)
    ]


def test_later_rows_change_nothing_earlier(spark):
    rows = sample_rows()
    early = [r for r in rows if r["transactiondt"] < 60]
    whole, part = run(spark, rows), run(spark, early)
    assert all(whole[i] == part[i] for i in part)


def test_lookup_equals_full_features(spark):
    rows = sample_rows()
    whole = run(spark, rows)
    wanted = spark.createDataFrame([(5,), (17,), (59,), (59,), (1000,)], "transactionid long")
    tx = frame(spark, rows)
    got = features_for_ids(tx, ids(spark, []), wanted).collect()
    assert sorted(r.transactionid for r in got) == [5, 17, 59]
    assert all(whole[r.transactionid] == r for r in got)


def test_resent_arrivals_count_once(spark):
    rows = sample_rows()
    tx = frame(spark, rows)
    cut = F.col("transactionid") < 40
    arrivals = tx.filter(~cut).drop("isfraud")
    once = features_for_new(tx.filter(cut), ids(spark, []), arrivals).collect()
    again = features_for_new(tx.filter(cut), ids(spark, []), arrivals.union(arrivals)).collect()
    assert sorted(once) == sorted(again) and len(once) == len(rows) - 40


def test_high_water_of_nothing(spark):
    row = high_water(frame(spark, [])).first()
    assert (row.next_id, row.max_dt) == (3_000_001, None)


def test_scan_reads_input_columns_only(spark, tmp_path, capsys):
    path = str(tmp_path / "tx")
    frame(spark, sample_rows()).write.parquet(path)
    tx = spark.read.parquet(path)
    transaction_features(tx, ids(spark, [])).explain("formatted")
    scans = re.findall(r"Scan parquet *\nOutput \[(\d+)\]", capsys.readouterr().out)
    assert scans and max(map(int, scans)) == len(INPUTS)


def test_rows_move_three_times(spark, tmp_path, capsys):
    """By customer, by domain, by id; the fourth exchange is the identity side."""
    path = str(tmp_path / "tx")
    frame(spark, sample_rows()).write.parquet(path)
    transaction_features(spark.read.parquet(path), ids(spark, [])).hint("merge").explain()
    plan = capsys.readouterr().out
    # by (key, slice) twice and by id twice; the rest are slice totals, three narrow ones per key
    assert plan.count("Exchange hashpartitioning") <= 4 + 2 * 3


def test_slice_totals_do_not_move_the_rows_again(spark, tmp_path, capsys):
    """Window and join share one exchange of the wide rows."""
    path = str(tmp_path / "tx")
    frame(spark, sample_rows()).write.parquet(path)
    keyed = prepare(spark.read.parquet(path))
    profile = profile_transactions(keyed)
    assert profile.hot["p_emaildomain"]
    email_history(keyed, profile).explain()
    plan = capsys.readouterr().out
    wide = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    # rows by (key, slice); totals by (key, slice), by key, and back for the join
    assert len(wide) <= 4
