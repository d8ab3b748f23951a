"""Scalar functions as column expressions: everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational Chebyshev fit of erfc (relative error 1.2e-7 everywhere).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def log_gamma(x: Column | float) -> Column:
    """ln Gamma(x), x > 0: Stirling's series at x + 8 and the recurrence back; error below 1e-12 but for rounding."""
    x = num(x)
    y = x + 8.0
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    r = 1.0 / (y * y)
    series = (1.0 / 12.0 - r * (1.0 / 360.0 - r * (1.0 / 1260.0 - r * (1.0 / 1680.0 - r / 1188.0)))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_erfc(z: Column) -> Column:
    """ln erfc(z), z >= 0."""
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.ln(t) - z * z + poly


def log10_chisq_tail(x: Column) -> Column:
    """log10 of the upper tail of chi-square with one degree of freedom."""
    return log_erfc(F.sqrt(x / 2.0)) / math.log(10)


def chisq_quantile(p: float) -> float:
    """The x whose upper tail probability is p (one degree of freedom), by bisection on the driver."""
    low, high = 0.0, 5000.0
    for _ in range(200):
        mid = (low + high) / 2
        if math.erfc(math.sqrt(mid / 2)) > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def logit(p: Column) -> Column:
    """ln(p / (1 - p)), held within 30 of zero."""
    low, high = 1 / (1 + math.exp(30.0)), 1 / (1 + math.exp(-30.0))
    return F.when(p <= low, -30.0).when(p >= high, 30.0).otherwise(F.ln(p / (1.0 - p)))


def expit(x: Column) -> Column:
    return F.when(x > 30.0, 1.0).when(x < -30.0, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sign1(x: Column) -> Column:
    """1 for zero and above, else -1."""
    return F.when(x >= 0, 1.0).otherwise(-1.0)


def to_one(a: Column) -> Column:
    """An array scaled to sum to one."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: x / total)


def log_sum_exp(xs: list[Column]) -> Column:
    top = F.greatest(*xs)
    total = F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(F.exp(x - top), F.lit(0.0))
    return top + F.ln(total)


def rounded(x: Column, digits: int = 6) -> Column:
    """Fixed digits without negative zero, for comparing engines."""
    return F.round(x, digits) + F.lit(0.0)
