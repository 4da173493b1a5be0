"""Splits by position, and metrics against their definitions."""

import random
from decimal import Decimal

import pytest

from riskloom.operators import metrics as M
from riskloom.operators import split as S

ORDER = ["transactiondt", "transactionid"]


def times(spark, values):
    return spark.createDataFrame(
        [(i, t) for i, t in enumerate(values)], "transactionid long, transactiondt long"
    )


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "far"])
def test_row_at(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "CELLS", 4)
    rng = random.Random(1)
    values = {
        "spread": [rng.randrange(-900, 900) for _ in range(80)],
        "ties": [rng.randrange(3) for _ in range(80)],
        "one": [5] * 80,
        "far": [rng.choice([0, 1, 2**40, 2**40 + 1]) for _ in range(80)],
    }[kind]
    df = times(spark, values)
    ordered = sorted((t, i) for i, t in enumerate(values))
    for position in (0, 1, 37, 79):
        assert S.row_at(df, ORDER, position) == ordered[position]
    assert S.row_at(df, ORDER, 80) is None


def test_split_sizes_and_order(spark):
    df = times(spark, [random.Random(2).randrange(9) for _ in range(33)])
    rows = S.split_by_time(df).collect()
    train = [(r.transactiondt, r.transactionid) for r in rows if r.side == "train"]
    test = [(r.transactiondt, r.transactionid) for r in rows if r.side == "test"]
    assert len(train) == int(33 * 0.8)
    assert max(train) < min(test)


def test_split_moves_no_rows(spark):
    df = times(spark, range(50))
    plan = S.split_by_time(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_first_rows(spark):
    df = times(spark, range(50))
    assert S.first_rows(df, ["transactionid"], 7).count() == 7
    assert S.first_rows(df, ["transactionid"], 99).count() == 50


def scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [
        (round(rng.random(), 2), int(rng.random() < 0.3), Decimal(rng.randrange(1, 90000)) / 100)
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(
        rows, "score double, isfraud int, transactionamt decimal(10,2)"
    )


def test_roc_auc_counts_pairs(spark):
    rows, df = scored(spark)
    pos = [s for s, y, _ in rows if y]
    neg = [s for s, y, _ in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert M.roc_auc(df).first()[0] == pytest.approx(
        wins / len(pos) / len(neg), abs=1e-12
    )


def test_average_precision_steps(spark):
    rows, df = scored(spark)
    total = sum(y for _, y, _ in rows)
    expected = 0.0
    for level in sorted({s for s, _, _ in rows}):
        hit = sum(y for s, y, _ in rows if s >= level)
        seen = sum(1 for s, _, _ in rows if s >= level)
        here = sum(y for s, y, _ in rows if s == level)
        expected += here / total * hit / seen
    assert M.average_precision(df).first()[0] == pytest.approx(
        expected, abs=1e-12
    )


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only(spark, label):
    df = spark.createDataFrame([(0.5, label), (0.2, label)], "score double, isfraud int")
    assert M.roc_auc(df).first()[0] is None
    assert M.average_precision(df).first()[0] == (1.0 if label else None)


def test_threshold_table_is_99_filters(spark):
    rows, df = scored(spark)
    # Scores on the thresholds themselves, where rounding would misplace them.
    rows = rows + [(i / 100, i % 2, Decimal("1.00")) for i in range(101)]
    df = spark.createDataFrame(rows, df.schema)
    costs = {r.threshold: r for r in M.threshold_costs(df).collect()}
    assert len(costs) == 99
    for i in range(1, 100):
        t = i / 100
        missed = sum((a for s, y, a in rows if y == 1 and not s >= t), Decimal(0))
        alarms = sum(1 for s, y, _ in rows if y == 0 and s >= t)
        assert costs[t].missed_fraud_cost == missed
        assert costs[t].false_alarms == alarms
        assert costs[t].total_cost == missed + 10 * alarms


def test_first_of_equal_costs_wins(spark):
    df = spark.createDataFrame(
        [(0.5, 1, Decimal("3.00"))], "score double, isfraud int, transactionamt decimal(10,2)"
    )
    best = M.best_threshold(M.threshold_costs(df)).first()
    assert (best.threshold, best.total_cost) == (0.01, 0)
