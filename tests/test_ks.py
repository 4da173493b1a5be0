"""p-values of the two-sample statistic against counting, published tables and each other."""

import itertools

import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift, ks


def counted(d, n, m):
    """Over all merged orders of the two samples."""
    orders = list(itertools.combinations(range(n + m), n))
    far = 0
    for chosen in orders:
        i = most = 0
        for k in range(n + m):
            i += k in chosen
            most = max(most, abs(i * m - (k + 1 - i) * n))
        far += most >= round(d * n * m)
    return far / len(orders)


@pytest.mark.parametrize(("n", "m"), [(4, 6), (3, 7), (5, 6), (1, 8), (6, 6)])
def test_exact_equals_counting(n, m):
    for d in {abs(i / n - j / m) for i in range(n + 1) for j in range(m + 1)}:
        assert abs(ks.exact_p(d, n, m) - counted(d, n, m)) < 1e-12


def test_published_values():
    """Two samples of five; critical values of one sample at 5 %."""
    assert abs(ks.exact_p(0.8, 5, 5) - 20 / 252) < 1e-12 and abs(ks.exact_p(1.0, 5, 5) - 2 / 252) < 1e-12
    for size, critical in ((20, 0.29408), (100, 0.13403), (10**6, 1.3581e-3)):
        assert abs(ks.size_corrected_p(critical, size) - 0.05) < 1e-4
    assert ks.p_value(0.0, 50, 60) == ks.p_value(0.0, 50_000, 60_000) == 1.0
    assert ks.p_value(1.0, 20, 20) < 1e-10 and ks.p_value(1.0, 20_000, 20_000) == 0.0


def test_the_two_forms_meet():
    for d in (0.015, 0.02, 0.03):
        assert abs(ks.exact_p(d, 9000, 8000) - ks.size_corrected_p(d, round(9000 * 8000 / 17000))) < 0.006


def test_report(spark):
    """Small samples get exact values, and the decision follows them."""
    rows = [("reference", float(v)) for v in range(40)] + [("current", v + 9.5) for v in range(30)]
    sides = spark.createDataFrame(rows, "side string, x double")
    (found,) = drift.drift_report(sides, ["x"], finite=True).collect()
    d = max(abs(sum(v <= x for s, v in rows if s == "reference") / 40 - sum(v <= x for s, v in rows if s == "current") / 30) for _, x in rows)
    assert found.ks_statistic == round(d, 4) and found.p_value == round(ks.exact_p(d, 40, 30), 6)
    assert found.drift_detected == (found.p_value < 0.05)
    assert drift.drift_report(sides.filter(F.col("x") < 5), ["x"], finite=True).collect() == []
