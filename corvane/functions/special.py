"""Tail probabilities as column expressions: regularised incomplete gamma and beta functions, summed in `aggregate` within a row.

All take and give doubles; null in, null out. The number of terms follows the square root of the parameters, as convergence does. Absolute error is under
1e-9 for parameters up to 1e5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

TINY = 1e-300
SHIFT = 15


def log_gamma(x: Column | str) -> Column:
    """ln of the gamma function for x > 0: Stirling's series beyond 15, reached from below by the recurrence."""
    x = col(x).cast("double")
    steps = F.when(x < SHIFT, F.lit(SHIFT)).otherwise(F.lit(0))
    rising = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda acc, i: acc * F.when(x < SHIFT, x + i).otherwise(F.lit(1.0)))
    z = x + steps
    w = 1 / (z * z)
    series = (F.lit(1 / 12) - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * (691 / 360360)))))) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def _away(x: Column) -> Column:
    """x, or a tiny number where it is zero: a denominator of a continued fraction."""
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _rounds(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(80) + 12 * F.sqrt(size)).cast("int"))


def upper_gamma(a: Column | str, x: Column | str) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function: a power series below a + 1, a continued fraction beyond."""
    a, x = col(a).cast("double"), col(x).cast("double")
    start = F.struct(a.alias("a"), x.alias("x"), (1 / a).alias("term"), (1 / a).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * s["x"] / (s["a"] + i)
        return F.struct(s["a"].alias("a"), s["x"].alias("x"), term.alias("term"), (s["sum"] + term).alias("sum"))

    first = _away(x + 1 - a)
    head = F.struct(a.alias("a"), first.alias("b"), F.lit(1 / TINY).alias("c"), (1 / first).alias("d"), (1 / first).alias("h"))

    def deepen(s: Column, i: Column) -> Column:
        numerator, b = i * (s["a"] - i), s["b"] + 2
        d, c = 1 / _away(numerator * s["d"] + b), _away(b + numerator / s["c"])
        return F.struct(s["a"].alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    rounds = _rounds(F.greatest(a, F.least(x, 2 * a + 100)))
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    below = 1 - scale * F.aggregate(rounds, start, add, lambda s: s["sum"])
    beyond = scale * F.aggregate(rounds, head, deepen, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, below).when(x.isNotNull() & a.isNotNull(), beyond)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, two of its steps a round."""
    first = 1 / _away(1 - (a + b) * x / (a + 1))
    head = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def deepen(s: Column, i: Column) -> Column:
        two = s["a"] + 2 * i
        even = i * (s["b"] - i) * s["x"] / ((two - 1) * two)
        odd = -(s["a"] + i) * (s["a"] + s["b"] + i) * s["x"] / (two * (two + 1))
        d1, c1 = 1 / _away(1 + even * s["d"]), _away(1 + even / s["c"])
        d2, c2 = 1 / _away(1 + odd * d1), _away(1 + odd / c1)
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"), c2.alias("c"), d2.alias("d"), (s["h"] * c1 * d1 * c2 * d2).alias("h"))

    return F.aggregate(_rounds(F.greatest(a, b)), head, deepen, lambda s: s["h"])


def lower_beta(a: Column | str, b: Column | str, x: Column | str) -> Column:
    """I_x(a, b), the regularised incomplete beta function."""
    a, b, x = (col(v).cast("double") for v in (a, b, x))
    scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, scale * _beta_fraction(a, b, x) / a).otherwise(1 - scale * _beta_fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(a.isNotNull() & b.isNotNull() & x.isNotNull(), inside)


def chi2_tail(x: Column | str, dof: Column | str) -> Column:
    """P(X >= x) of chi-square."""
    return upper_gamma(col(dof) / 2, col(x) / 2)


def t_tail(t: Column | str, dof: Column | str) -> Column:
    """P(|T| >= |t|) of Student's t."""
    t, v = col(t).cast("double"), col(dof).cast("double")
    return lower_beta(v / 2, F.lit(0.5), v / (v + t * t))


def f_tail(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(X >= f) of Fisher's F."""
    f, d1, d2 = (col(v).cast("double") for v in (f, d1, d2))
    return lower_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_tail(z: Column | str) -> Column:
    """P(|Z| >= |z|) of the standard normal."""
    z = col(z).cast("double")
    return upper_gamma(F.lit(0.5) + 0 * z, z * z / 2)
