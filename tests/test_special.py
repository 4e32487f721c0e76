"""Tail probabilities against closed forms: finite sums where parameters are whole or half, error functions, symmetries."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from corvane.functions import special


def gamma_tail(twice_a, x):
    """Q(a, x) for a = twice_a / 2: a finite sum, from the exponential or from the error function."""
    if twice_a % 2 == 0:
        k, total = 0.0, []
        for i in range(twice_a // 2):
            total.append(math.exp(i * math.log(x) - x - math.lgamma(i + 1)))
        return math.fsum(total) + k
    parts = [math.erfc(math.sqrt(x))]
    for i in range((twice_a - 1) // 2):
        parts.append(math.exp((i + 0.5) * math.log(x) - x - math.lgamma(i + 1.5)))
    return math.fsum(parts)


def beta_whole(a, b, x):
    """I_x(a, b) for whole a and b, exactly, as a binomial tail."""
    x, n = Fraction(x), a + b - 1
    return float(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def t_two_sided(t, v):
    """Closed forms of Student's t for whole degrees of freedom, by the angle atan(t / sqrt(v))."""
    theta = math.atan2(abs(t), math.sqrt(v))
    s, c = math.sin(theta), math.cos(theta)
    if v % 2:
        terms, term = [], c
        for k in range(1, (v - 1) // 2 + 1):
            terms.append(term)
            term *= c * c * 2 * k / (2 * k + 1)
        return 1 - 2 / math.pi * (theta + s * math.fsum(terms))
    terms, term = [], 1.0
    for k in range(1, v // 2 + 1):
        terms.append(term)
        term *= c * c * (2 * k - 1) / (2 * k)
    return 1 - s * math.fsum(terms)


def values(spark, rows, ddl, expression):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [r["p"] for r in frame.select("i", expression.alias("p")).orderBy("i").collect()]


def close(got, want):
    assert len(got) == len(want)
    worst = max(abs(g - w) for g, w in zip(got, want))
    assert worst < 1e-9, worst


def test_log_gamma(spark):
    xs = [0.25, 0.5, 1, 1.5, 2, 3.25, 14.999, 15, 15.001, 33.3, 1000.5, 1e5]
    close([g / max(1, abs(math.lgamma(x))) for g, x in zip(values(spark, [(float(x),) for x in xs], "x double", special.log_gamma("x")), xs)], [math.lgamma(x) / max(1, abs(math.lgamma(x))) for x in xs])


def test_gamma_and_chi_square(spark):
    grid = [(k, x) for k in (1, 2, 3, 4, 7, 10, 21, 36, 99, 400, 2001) for x in (1e-8, 0.1, 1.0, 2.5, k * 0.4, k * 0.95, k + 0.0, k * 1.05, k * 1.6 + 3, k * 3.0 + 20)]
    close(values(spark, [(float(k), float(x)) for k, x in grid], "k double, x double", special.chi2_tail("x", "k")), [gamma_tail(k, x / 2) for k, x in grid])
    close(values(spark, [(x,) for x in (0.0, 0.5, -1.96, 3.0, 6.5)], "x double", special.normal_tail("x")), [math.erfc(abs(x) / math.sqrt(2)) for x in (0.0, 0.5, -1.96, 3.0, 6.5)])


def test_beta_and_f(spark):
    grid = [(a, b, x) for a in (1, 2, 5, 20, 120) for b in (1, 3, 8, 60) for x in (1 / 1024, 0.125, 0.375, 0.5, 0.625, 0.96875)]
    close(values(spark, [(float(a), float(b), x) for a, b, x in grid], "a double, b double, x double", special.lower_beta("a", "b", "x")), [beta_whole(*g) for g in grid])
    grid = [(f, 2 * d1, 2 * d2) for f in (0.1, 0.7, 1.0, 1.5, 4.0, 30.0) for d1 in (1, 4, 12) for d2 in (1, 10, 50)]
    want = [beta_whole(d2 // 2, d1 // 2, Fraction(d2) / (d2 + d1 * Fraction(f))) for f, d1, d2 in grid]
    close(values(spark, [(f, float(a), float(b)) for f, a, b in grid], "f double, a double, b double", special.f_tail("f", "a", "b")), want)


def test_t(spark):
    grid = [(t, v) for t in (0.0, 0.01, -0.7, 1.0, 1.96, -3.3, 12.0) for v in (1, 2, 3, 5, 10, 31, 100, 999, 5000)]
    close(values(spark, [(t, float(v)) for t, v in grid], "t double, v double", special.t_tail("t", "v")), [t_two_sided(*g) for g in grid])


def test_large_parameters_agree_with_each_other(spark):
    """t of many degrees of freedom is nearly normal; F with one degree above is t squared; both ends of a symmetric beta add to one."""
    rows = [(t, v) for t in (0.3, 1.5, 2.8) for v in (200.0, 1e4, 1e5)]
    frame = spark.createDataFrame(rows, "t double, v double").select(
        (special.f_tail(F.col("t") * F.col("t"), F.lit(1.0), "v") - special.t_tail("t", "v")).alias("a"),
        ((special.t_tail("t", "v") - special.normal_tail("t")) * F.col("v")).alias("b"),
        (special.lower_beta("v", "v", F.col("t") / 10) + special.lower_beta("v", "v", 1 - F.col("t") / 10) - 1).alias("c"),
    )
    for r in frame.collect():
        assert abs(r["a"]) < 1e-9 and abs(r["b"]) < 1 and abs(r["c"]) < 1e-9


def test_edges(spark):
    none, two = F.lit(None).cast("double"), F.lit(2.0)
    asked = {
        "a": special.upper_gamma(none, F.lit(1.0)), "b": special.upper_gamma(two, F.lit(0.0)), "c": special.lower_beta(two, none, F.lit(0.5)), "d": special.lower_beta(two, F.lit(3.0), F.lit(1.0)),
        "e": special.t_tail(none, F.lit(3.0)), "f": special.upper_gamma(two, none), "g": special.f_tail(F.lit(0.0), two, two), "h": special.normal_tail(none),
    }
    got = spark.range(1).select(*(v.alias(k) for k, v in asked.items())).first().asDict()
    assert got == {"a": None, "b": 1.0, "c": None, "d": 1.0, "e": None, "f": None, "g": 1.0, "h": None}
