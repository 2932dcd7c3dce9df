"""Tail probabilities as plain Column arithmetic, without Python workers.

The chi-square tail is the incomplete gamma function, Student's the incomplete beta function; series
and continued fractions give both for any degrees of freedom, without an approximation for many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published Chebyshev fit of erfc, relative error below 1.2e-7 everywhere.
ERFC = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)
# Up to here Student's finite series has fewer terms than the continued fraction; both are exact.
SHORT_SERIES = 60
BETA_STEPS = 120
# Stirling's series for the logarithm of gamma, by odd powers of 1/a, and the series of
# gamma(a + 1/2) / gamma(a) / sqrt(a) by powers of 1/a.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
HALF_STEP = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
SHIFT = 24
TINY = 1e-300


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def normal_two_sided(z: Column) -> Column:
    return F.least(erfc(F.abs(z) / math.sqrt(2.0)), F.lit(1.0))


def normal_upper(z: Column) -> Column:
    half = erfc(F.abs(z) / math.sqrt(2.0)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _running(first: Column, upto: Column, step) -> Column:
    """first + sum of `upto` further terms, each from the one before by `step(term, k)`."""
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * step(k.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ks = F.when(upto >= 1, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, start, add)["sum"]


def _stirling_rest(a: Column) -> Column:
    """log gamma(a) less (a - 1/2) log a - a + log(2 pi) / 2."""

    def series(z: Column) -> Column:
        w = 1.0 / (z * z)
        out: Column = F.lit(STIRLING[-1])
        for c in reversed(STIRLING[:-1]):
            out = F.lit(c) + w * out
        return out / z

    far = a + SHIFT
    main = lambda z: (z - 0.5) * F.log(z) - z
    product: Column = F.lit(0.0)
    for k in range(SHIFT):
        product = product + F.log(a + k)
    return F.when(a >= SHIFT, series(a)).otherwise(main(far) + series(far) - product - main(a))


def _guarded(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _gamma_tail(a: Column, x: Column) -> Column:
    """Upper incomplete gamma function Q(a, x), for x > 0."""
    # x^a e^-x / gamma(a), from differences that don't cancel where a is large
    off = (x - a) / a
    front = F.exp(a * (F.log1p(off) - off) + 0.5 * F.log(a / (2 * math.pi)) - _stirling_rest(a))
    steps = F.sequence(F.lit(1), (80 + 12 * F.sqrt(a)).cast("int"))

    def term(acc: Column, k: Column) -> Column:
        t = acc["term"] * x / (a + k)
        return F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))

    one = F.lit(1.0)
    series = F.aggregate(steps, F.struct(one.alias("term"), one.alias("sum")), term)["sum"] / a

    def fraction(acc: Column, k: Column) -> Column:
        an, b = -k * (k - a), acc["b"] + 2.0
        d = 1.0 / _guarded(an * acc["d"] + b)
        c = _guarded(b + an / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    b = x + 1.0 - a
    first = 1.0 / _guarded(b)
    start = F.struct(b.alias("b"), F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("h"))
    doubles = F.transform(steps, lambda k: k.cast("double"))
    upper = F.aggregate(doubles, start, fraction)["h"]
    return F.when(x < a + 1.0, 1.0 - front * series).otherwise(front * upper)


def chi2_upper(x: Column, df: Column) -> Column:
    """P(X > x) for df of 1 or more; NULL for fewer."""
    half = F.greatest(x, F.lit(0.0)) / 2
    p = F.when(half == 0, F.lit(1.0)).otherwise(_gamma_tail(df.cast("double") / 2, half))
    return F.when(df >= 1, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    one = F.lit(1.0)
    d0 = 1.0 / _guarded(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"))

    def half(c: Column, d: Column, h: Column, an: Column) -> tuple[Column, Column, Column]:
        d = 1.0 / _guarded(1.0 + an * d)
        c = _guarded(1.0 + an / c)
        return c, d, h * d * c

    def both(acc: Column, m: Column) -> Column:
        c, d, h = half(acc["c"], acc["d"], acc["h"], m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m)))
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def other(acc: Column, m: Column) -> Column:
        an = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))
        c, d, h = half(acc["c"], acc["d"], acc["h"], an)
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    # whole steps m are even places, the half steps between them odd ones
    places = F.transform(F.sequence(F.lit(0), F.lit(2 * BETA_STEPS - 1)), lambda k: k.cast("double"))

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double") + 1.0
        return F.when(F.pmod(k, F.lit(2.0)) == 0, both(acc, m)).otherwise(other(acc, m))

    return F.aggregate(places, start, step)["h"]


def _gamma_half_step(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a)."""
    far, shrink = a + SHIFT, F.lit(1.0)
    for k in range(SHIFT):
        shrink = shrink * (a + k) / (a + k + 0.5)

    def series(z: Column) -> Column:
        out: Column = F.lit(HALF_STEP[-1])
        for c in reversed(HALF_STEP[:-1]):
            out = F.lit(c) + out / z
        return out * F.sqrt(z)

    return F.when(a >= SHIFT, series(a)).otherwise(series(far) * shrink)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for whole df of 1 or more; NULL for fewer."""
    t, df = F.abs(t), df.cast("bigint")
    nu = df.cast("double")
    theta = F.atan(t / F.sqrt(nu))
    sin, cos2 = F.sin(theta), F.cos(theta) * F.cos(theta)
    short = F.least(df, F.lit(SHORT_SERIES)).cast("int")
    n_odd, n_even = F.floor((short - 3) / 2).cast("int"), F.floor((short - 2) / 2).cast("int")
    odd_sum = F.when(
        df > 1, sin * F.cos(theta) * _running(F.lit(1.0), n_odd, lambda k: cos2 * 2 * k / (2 * k + 1))
    ).otherwise(0.0)
    even_sum = sin * _running(F.lit(1.0), n_even, lambda k: cos2 * (2 * k - 1) / (2 * k))
    inside = F.when(F.pmod(df, F.lit(2)) == 1, (theta + odd_sum) * (2 / math.pi)).otherwise(even_sum)
    # incomplete beta I_x(nu / 2, 1 / 2) with x = nu / (nu + t^2), from the side that converges fast
    a, half = nu / 2, F.lit(0.5)
    x, rest = nu / (nu + t * t), t * t / (nu + t * t)
    front = _gamma_half_step(a) / math.sqrt(math.pi) * F.exp(-a * F.log1p(t * t / nu)) * F.sqrt(rest)
    tail = F.when(x < (a + 1.0) / (a + 2.5), front * _beta_fraction(a, half, x) / a).otherwise(
        1.0 - 2.0 * front * _beta_fraction(half, a, rest)
    )
    p = F.when(df > SHORT_SERIES, F.when(t == 0, F.lit(1.0)).otherwise(tail)).when(df >= 1, 1 - inside)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
