"""Tail probabilities for a handful of aggregated test rows.

Spark SQL has no erf, gamma or beta function, so these run as Arrow-batched UDFs. They only
ever see one row per test, never data rows.
"""

from __future__ import annotations

import math
import sys
from itertools import accumulate

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_EPSILON = 1e-16


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _continued_fraction(terms) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)); terms yields (a, b)."""
    _, value = next(terms)
    value = value or _TINY
    numerator, denominator = value, 0.0
    for a, b in terms:
        denominator = b + a * denominator
        denominator = 1.0 / (denominator or _TINY)
        numerator = (b + a / numerator) or _TINY
        step = numerator * denominator
        value *= step
        if abs(step - 1.0) < _EPSILON * 4 or not math.isfinite(value):
            break
    return value


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * _EPSILON:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)

    def terms():
        yield 0.0, x + 1.0 - a
        i = 1
        while True:
            yield i * (a - i), x + 2.0 * i + 1.0 - a
            i += 1

    return scale / _continued_fraction(terms())


def chi_square_tail(statistic: float, dof: float) -> float:
    if dof <= 0:
        return 1.0
    if math.isinf(statistic):
        return 0.0
    if dof == 1:
        return math.erfc(math.sqrt(max(statistic, 0.0) / 2.0))
    return upper_gamma(dof / 2.0, statistic / 2.0)


def _stirling_rest(z: float) -> float:
    """What lgamma(z) adds to (z - 1/2) log z - z + log(2 pi) / 2, for z of 20 and more."""
    w = 1.0 / (z * z)
    return (1.0 / 12.0 - w * (1.0 / 360.0 - w * (1.0 / 1260.0 - w / 1680.0))) / z


def _log_gamma_step(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a) for a small b, without the cancellation of two large numbers."""
    rest = 0.0
    while a < 20.0:
        rest += math.log(a / (a + b))
        a += 1.0
    return (
        rest + (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
        + _stirling_rest(a + b) - _stirling_rest(a)
    )


def _beta_tail(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function I_x(a, b), y being 1 - x."""
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, y, x)
    large, small = max(a, b), min(a, b)
    log_x = math.log(x) if x < y else math.log1p(-y)
    log_y = math.log(y) if y < x else math.log1p(-x)
    front = math.exp(_log_gamma_step(large, small) - math.lgamma(small) + a * log_x + b * log_y)

    def terms():
        yield 0.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / a / _continued_fraction(terms())


def student_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def rank_sum_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p of Mann-Whitney's U for samples without ties.

    Counts the orders of both samples whose U is at most the smaller of u and its mirror. Their
    number for each value of U is a coefficient of the Gaussian binomial: the product over i up to
    the smaller size of (1 - q^(larger + i)) / (1 - q^i). Whole numbers, so nothing cancels; time
    and memory grow with the larger sample.
    """
    small, large = sorted((n1, n2))
    low = min(int(u), n1 * n2 - int(u))
    ways = [1] + [0] * low
    for i in range(1, small + 1):
        for start in range(min(i, low + 1)):
            ways[start::i] = accumulate(ways[start::i])
        for place in range(low, large + i - 1, -1):
            ways[place] -= ways[place - large - i]
    return min(1.0, 2 * sum(ways) / math.comb(n1 + n2, small))


_TAILS = {
    "chi-square": chi_square_tail,
    "student": student_two_sided,
    "normal": lambda z, _: normal_two_sided(z),
    "known": lambda p, _: p,
}


def _tail(kind: str, statistic: float, dof: float) -> float | None:
    if pd.isna(statistic) or pd.isna(dof):
        return None
    return _TAILS[kind](float(statistic), float(dof))


@F.pandas_udf(T.DoubleType())
def tail_p(kind: pd.Series, statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper chi-square tail or two-sided Student or normal tail; a known p stays.

    Normal and known ignore dof.
    """
    return pd.Series(
        [_tail(*row) for row in zip(kind, statistic, dof)], dtype="float64", index=kind.index
    )


@F.pandas_udf(T.DoubleType())
def rank_sum_p(
    exact: pd.Series, statistic: pd.Series, n1: pd.Series, n2: pd.Series, z: pd.Series
) -> pd.Series:
    """Two-sided p of U by its exact law where that is asked for, else by the normal tail of z."""
    return pd.Series(
        [
            rank_sum_two_sided(u, int(a), int(b)) if use else normal_two_sided(normal)
            for use, u, a, b, normal in zip(exact, statistic, n1, n2, z)
        ],
        dtype="float64", index=statistic.index,
    )


@F.pandas_udf(T.StringType())
def short_number(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Number text with the given significant digits and no trailing zeros."""
    return pd.Series(
        [None if pd.isna(v) else f"{v:.{int(d)}g}" for v, d in zip(value, digits)],
        dtype="object", index=value.index,
    )
