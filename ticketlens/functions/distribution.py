"""Upper tail of the F distribution, for the few result rows of a variance analysis."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_MAX_STEPS = 1_000_000


def _log_beta(a: float, b: float) -> float:
    """log B(a, b); series for a long second argument, where gamma differences lose digits."""
    small, large = min(a, b), max(a, b)
    if large < 1e6 or small > 1e3:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    ratio = small * math.log(large) + small * (small - 1) / (2 * large)
    ratio -= small * (small - 1) * (2 * small - 1) / (12 * large * large)
    return math.lgamma(small) - ratio


def _fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, _MAX_STEPS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def _beta_share(x: float, y: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b) with y = 1 - x given apart to keep its digits."""
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    log_front = a * math.log(x) + b * math.log(y) - _log_beta(a, b)
    front = math.exp(log_front) if log_front > -745 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(x, a, b) / a
    return 1.0 - front * _fraction(y, b, a) / b


def f_upper_tail(f: float, between: float, within: float) -> float:
    """P(F > f) for the two degrees of freedom; NaN where undefined."""
    if f is None or between is None or within is None or math.isnan(f) or math.isnan(between):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    total = within + between * f
    # log1p of the ratio keeps its digits when the within side is very long.
    return _beta_share(within / total, between * f / total, within / 2, between / 2)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    tails = [f_upper_tail(*row) for row in zip(f, between, within)]
    return pd.Series(tails, dtype="float64").where(lambda p: p.notna(), None)
