"""Special functions as Column expressions, evaluated in generated code.

The argument appears many times in each expression: pass a column of the frame,
not a long expression. Arguments outside a function's domain give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
SERIES, FRACTION, SWITCH = 60, 60, 3.0
Z975 = 1.959963984540054  # the normal quantile at 0.975


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upper_normal(z: Column | str) -> Column:
    """1 - Phi(z), with full relative accuracy in the upper tail; null for null and NaN."""
    z = _col(z)
    a = F.abs(z)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    square = z * z
    inner = F.lit(1.0)
    for k in range(SERIES, 0, -1):
        inner = 1 + square / (2 * k + 1) * inner
    fraction = a
    for k in range(FRACTION, 0, -1):
        fraction = a + F.lit(float(k)) / fraction
    tail = density / fraction
    return (
        F.when(z.isNull() | F.isnan(z), None)
        .when(a < SWITCH, 0.5 - density * z * inner)
        .when(z > 0, tail)
        .otherwise(1 - tail)
    )


def normal_cdf(z: Column | str) -> Column:
    """Phi(z)."""
    return upper_normal(-_col(z))


def lgamma(x: Column | str) -> Column:
    """ln Gamma(x) for x > 0."""
    x = _col(x)
    y = x + SHIFT
    product = x
    for k in range(1, SHIFT):
        product = product * (x + k)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360)))))) / y
    return F.when(x > 0, (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product))


def digamma(x: Column | str) -> Column:
    """The derivative of ln Gamma at x > 0."""
    x = _col(x)
    y = x + SHIFT
    below = 1 / x
    for k in range(1, SHIFT):
        below = below + 1 / (x + k)
    r = 1 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760))))))
    return F.when(x > 0, F.ln(y) - 0.5 / y - series - below)


def trigamma(x: Column | str) -> Column:
    """The second derivative of ln Gamma at x > 0."""
    x = _col(x)
    y = x + SHIFT
    below = 1 / (x * x)
    for k in range(1, SHIFT):
        below = below + 1 / ((x + k) * (x + k))
    r = 1 / (y * y)
    series = r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66)))))
    return F.when(x > 0, (1 + series) / y + 0.5 * r + below)


def ln_nbinom(n: Column | str, size: float, beta: float, expected: Column | str) -> Column:
    """ln of the negative binomial probability of n with this size and success share beta / (beta + expected)."""
    n, e = _col(n), _col(expected)
    return (
        lgamma(n + size)
        - math.lgamma(size)
        - lgamma(n + 1.0)
        + size * F.ln(beta / (e + beta))
        + n * F.ln(e / (e + beta))
    )
