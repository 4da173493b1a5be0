"""Significance of a two-sample Kolmogorov-Smirnov statistic for samples of finite size.

Up to EXACT_VALUES in the larger sample the p-value is exact: all orders in which the two samples can be merged are equally likely, an order is
a path over a lattice of (values of one, values of the other), and the statistic stays below d as long as the path
stays in a band. The share of such paths is carried from one diagonal of the lattice to the next. Beyond, the statistic has the
distribution of a one-sample one with n*m/(n+m) values, whose tail is the limit distribution and two
corrections for size (Pelz and Good).
"""

from __future__ import annotations

import math

import numpy as np

EXACT_VALUES = 10_000
_TERMS = 40


def exact_p(d: float, n: int, m: int) -> float:
    """P(statistic >= d) for samples of n and m values without ties."""
    edge = round(d * n * m)  # the statistic times n*m is a whole number
    if edge <= 0:
        return 1.0
    shares = np.array([1.0])  # by values taken from the first sample, on the diagonal of ``taken`` values
    low = 0
    for taken in range(1, n + m + 1):
        begin, end = max(0, taken - m), min(n, taken)
        i = np.arange(begin, end + 1)
        held = np.zeros(len(i) + 2)
        held[low - begin + 1 : low - begin + 1 + len(shares)] = shares  # place k holds i = begin + k - 1
        # Merged orders are equally likely, so the last value is from the first sample with chance i / taken.
        now = held[:-2] * i / taken + held[1:-1] * (taken - i) / taken
        now[np.abs(i * m - (taken - i) * n) >= edge] = 0.0
        shares, low = now, begin
    return float(min(1.0, max(0.0, 1.0 - shares[-1])))


def size_corrected_p(d: float, size: int) -> float:
    """P(one-sample statistic of ``size`` values >= d), to about 1 / size ** 1.5."""
    z = math.sqrt(size) * d
    if z < 0.18:
        return 1.0
    if z > 4:  # the series below would need more terms, and the tail is below 1e-13
        return 2 * math.exp(-2 * z * z)
    half = (np.arange(_TERMS) + 0.5) ** 2 * math.pi**2
    whole = np.arange(1, _TERMS) ** 2 * math.pi**2
    at_half, at_whole = np.exp(-half / (2 * z * z)), np.exp(-whole / (2 * z * z))
    limit = 2 * math.sqrt(math.pi / 2) / z * at_half.sum()
    root = math.sqrt(math.pi / 2)
    first = 2 * root / (6 * z**4) * ((half - z * z) * at_half).sum()
    second = 2 * root / (72 * z**7) * (
        ((6 * z**6 + 2 * z**4) + (2 * z**4 - 5 * z**2) * half + (1 - 2 * z * z) * half**2) * at_half
    ).sum() - 2 * root / (36 * z**3) * (whole * at_whole).sum()
    below = limit + first / math.sqrt(size) + second / size
    return float(min(1.0, max(0.0, 1.0 - below)))


def p_value(d: float, n: int, m: int, exact_values: int = EXACT_VALUES) -> float:
    n, m = int(n), int(m)
    if max(n, m) <= exact_values:
        return exact_p(d, n, m)
    return size_corrected_p(d, round(n * m / (n + m)))
