"""The sliced prefix aggregate equals brute force, however rows are spread."""

import random

import pytest

from riskloom.operators import prefix as P

SCHEMA = "id long, k string, t long, v long"


def brute(rows):
    expected = {}
    for r in rows:
        before = [o for o in rows if o[1] == r[1] and (o[2], o[0]) < (r[2], r[0])]
        expected[r[0]] = (
            len(before),
            sum(o[3] for o in before) if before else None,
            max(o[2] for o in before) if before else None,
        )
    return expected


def make(kind, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice([None, "hot", "hot", "hot", "hot", f"k{rng.randrange(60)}"])
        time = {"spread": rng.randrange(-500, 5000), "ties": rng.randrange(3), "one": 7}[kind]
        rows.append((i, key, time, rng.randrange(100)))
    return rows


def run(df, profile, **options):
    return P.prefix_aggregate(
        df, ["t", "id"], profile, key="k", count="n", sums={"s": "v"}, previous="p", **options
    )


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, kind, seed):
    rows = make(kind, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    profile = P.profile_order(df, "t", "id", ("k",))
    assert "hot" in profile.hot["k"] and None in profile.hot["k"]
    assert len(profile.splits) > 4
    got = {r.id: (r.n, r.s, r.p) for r in run(df, profile).collect()}
    assert got == brute(rows)


def test_no_slice_of_a_hot_key_stays_large(spark):
    """All rows share one time; the tie-breaker still cuts them apart."""
    df = spark.createDataFrame([(i, "hot", 7, 1) for i in range(4000)], SCHEMA)
    profile = P.profile_order(df, "t", "id", ("k",))
    sliced = P.assign_slices(df, profile, "t", "id", "k")
    assert sliced.groupBy(P.SLICE).count().agg({"count": "max"}).first()[0] < 4000 / 8


def test_only_limits_rows_not_results(spark):
    rows = make("spread", 4)
    df = spark.createDataFrame(rows, SCHEMA)
    profile = P.profile_order(df, "t", "id", ("k",))
    wanted = df.filter("id % 40 = 0")
    got = {r.id: (r.n, r.s, r.p) for r in run(df, profile, only=wanted).collect()}
    expected = brute(rows)
    assert set(got) < {r[0] for r in rows}
    assert all(expected[i] == got[i] for i in got)
    assert all(i in got for i in range(0, 300, 40))


def test_carry_adds_the_past(spark):
    rows = sorted(make("spread", 5), key=lambda r: (r[2], r[0]))
    first, second = rows[:150], rows[150:]
    past = {}
    for _, k, t, v in first:
        n, s, _ = past.get(k, (0, 0, None))
        past[k] = (n + 1, s + v, t)
    carry = spark.createDataFrame(
        [(k, *x) for k, x in past.items()], "k string, n long, s long, p long"
    )
    df = spark.createDataFrame(second, SCHEMA)
    profile = P.profile_order(df, "t", "id", ("k",))
    got = {r.id: (r.n, r.s, r.p) for r in run(df, profile, carry=carry).collect()}
    expected = brute(rows)
    assert got == {r[0]: expected[r[0]] for r in second}


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_time_rank(spark, kind):
    rows = make(kind, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.pos for r in P.time_rank(df, "t", "id", "pos").collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    profile = P.profile_order(df, "t", "id", ("k",))
    assert run(df, profile).count() == 0


def test_null_order_values_come_first_once_each(spark):
    """NULL times share the lowest slice; every row has its own position."""
    rows = [(i, "k", None if i % 50 == 0 else (i * 37) % 101, 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.pos for r in P.time_rank(df, "t", "id", "pos").collect()}
    ordered = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert got == {r[0]: i for i, r in enumerate(ordered)}


def test_more_slices_than_a_sketch_can_hold(spark, monkeypatch):
    """A table cut as one of 400 billion rows would be: 200,001 slices, and as many hot keys as fit."""
    monkeypatch.setattr(P, "ROWS_PER_SLICE", 1)
    n = 200_001
    df = spark.range(n).selectExpr("id", "id % 60000 AS k", "id DIV 7 AS t", "1L AS v")
    assert P.slice_count(n) == n
    profile = P.profile_order(df, "t", "id", ("k",))
    assert len(profile.splits) > 180_000 and len(profile.hot["k"]) == 60_000
    got = P.prefix_aggregate(df, ["t", "id"], profile, key="k", count="n", sums={"s": "v"})
    wrong = got.filter("n <> id DIV 60000 OR coalesce(s, 0) <> n")
    assert got.count() == n and wrong.isEmpty()
