"""Tail probabilities and quantiles of the t, F and normal distributions as column expressions.

Spark has no such functions. The incomplete beta function is a continued fraction, folded over a fixed number of steps by `aggregate`, so it stays
in the JVM beside the rest of the query. Quantiles are found by Newton's method, folded in the same way. A missing or impossible argument gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Steps of the continued fraction; it needs about the square root of the larger degrees of freedom.
STEPS = 130
#: Degrees of freedom beyond which a t value is turned into a normal one, with an error far below 1e-12.
MANY = 4000.0
#: Newton steps for a quantile.
ROUNDS = 12


def _bound(values: dict[str, Column], formula) -> Column:
    """A formula of named values, each of which is evaluated once."""
    row = F.struct(*[c.cast("double").alias(n) for n, c in values.items()])
    return F.get(F.transform(F.array(row), formula), F.lit(0))


def _fold(steps: int, start: dict[str, Column], step, result: str) -> Column:
    """The field `result` after `steps` steps; step(state, k) gives the next values by name."""
    first = F.struct(*[c.cast("double").alias(n) for n, c in start.items()])

    def merge(state, k):
        return F.struct(*[c.cast("double").alias(n) for n, c in step(state, k).items()])

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: k.cast("double")), first, merge, lambda s: s[result])


def _away_from_zero(c: Column) -> Column:
    return F.when(F.abs(c) < 1e-300, F.lit(1e-300)).otherwise(c)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, even and odd terms as steps of their own."""

    def term(k):
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    def both(s, k):
        def next_two(n):
            return F.struct(_away_from_zero(n / s["c"] + 1).alias("c"), (F.lit(1.0) / _away_from_zero(n * s["d"] + 1)).alias("d"), s["out"].alias("out"))

        return F.get(F.transform(F.array(term(k)), next_two), F.lit(0))

    def merge(s, k):
        now = both(s, k)
        return F.get(F.transform(F.array(now), lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (v["out"] * v["c"] * v["d"]).alias("out"))), F.lit(0))

    first = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("out"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(2 * STEPS)), lambda k: k.cast("double")), first, merge, lambda s: s["out"])


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x: Stirling's series ten steps further up."""
    y = x + 10
    series = F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, 3) + F.lit(1 / 1260) / F.pow(y, 5) - F.lit(1 / 1680) / F.pow(y, 7)
    rising = x
    for k in range(1, 10):
        rising = rising * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def _log_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) without the difference of two large numbers."""
    y = a + 20
    series = -F.lit(1 / 8) / y + F.lit(1 / 192) / F.pow(y, 3) - F.lit(1 / 640) / F.pow(y, 5) + F.lit(17 / 14336) / F.pow(y, 7)
    ratio = F.lit(1.0)
    for k in range(20):
        ratio = ratio * (a + k) / (a + k + 0.5)
    return 0.5 * F.log(y) + series + F.log(ratio)


def _beta_tail(a: Column, b: Column, x: Column, y: Column, log_beta: Column) -> Column:
    """Regularised incomplete beta function at x, with y = 1 - x given, too."""

    def formula(v):
        front = F.exp(v["a"] * F.log(v["x"]) + v["b"] * F.log(v["y"]) - v["l"])
        direct = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        p, q, z = (F.when(direct, v[i]).otherwise(v[j]) for i, j in (("a", "b"), ("b", "a"), ("x", "y")))
        part = front * _bound({"p": p, "q": q, "z": z}, lambda w: _fraction(w["p"], w["q"], w["z"]) / w["p"])
        value = F.when(direct, part).otherwise(F.lit(1.0) - part)
        return F.when(v["x"] <= 0, F.lit(0.0)).when(v["y"] <= 0, F.lit(1.0)).otherwise(value)

    return _bound({"a": a, "b": b, "x": x, "y": y, "l": log_beta}, formula)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): a series near zero, a continued fraction further out."""

    def formula(v):
        x = v["x"]
        near = _fold(90, {"t": x, "s": x}, lambda s, k: {"t": s["t"] * x * x * 2 / (k * 2 + 1), "s": s["s"] + s["t"] * x * x * 2 / (k * 2 + 1)}, "s")
        far = _fold(90, {"f": x}, lambda s, k: {"f": x + (F.lit(91.0) - k) / 2 / s["f"]}, "f")
        square = F.exp(-x * x)
        return F.when(x < 2, F.lit(1.0) - near * square * (2 / math.sqrt(math.pi))).otherwise(square / (far * math.sqrt(math.pi)))

    return _bound({"x": F.abs(z) / math.sqrt(2)}, formula)


def _normal_of_t(t: Column, df: Column) -> Column:
    """The normal value with the tail of a t value, for many degrees of freedom."""

    def formula(v):
        z, b = v["z"], v["b"]
        return z + (F.pow(z, 3) + z * 3) / b - (F.pow(z, 7) * 4 + F.pow(z, 5) * 33 + F.pow(z, 3) * 240 + z * 855) / (b * 10 * (b + F.pow(z, 4) * 0.8 + 100))

    a = df - 0.5
    return _bound({"z": F.sqrt(a * F.log1p(t * t / df)), "b": a * a * 48}, formula)


def t_p_value(t: Column | str, df: Column | str) -> Column:
    """P(|T| > |t|) with df degrees of freedom."""
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))

    def formula(v):
        t, df = v["t"], v["df"]
        square = t * t
        log_beta = 0.5 * math.log(math.pi) - _log_half_step(df / 2)
        tail = _beta_tail(df / 2, F.lit(0.5), df / (df + square), square / (df + square), log_beta)
        p = F.when(df > MANY, normal_two_sided(_normal_of_t(t, df))).otherwise(tail)
        return F.when(t == 0, F.lit(1.0)).when(~F.isnan(t) & (df > 0), p)

    return _bound({"t": t, "df": df}, formula)


def f_p_value(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """P(F > f) with df1 and df2 degrees of freedom."""
    f, df1, df2 = (F.col(c) if isinstance(c, str) else c for c in (f, df1, df2))

    def formula(v):
        a, b, whole = v["d2"] / 2, v["d1"] / 2, v["d2"] + v["d1"] * v["f"]
        log_beta = log_gamma(a) + log_gamma(b) - log_gamma(a + b)
        tail = _beta_tail(a, b, v["d2"] / whole, v["d1"] * v["f"] / whole, log_beta)
        return F.when(v["f"] <= 0, F.lit(1.0)).when((v["d1"] > 0) & (v["d2"] > 0) & ~F.isnan(v["f"]), tail)

    return _bound({"f": f, "d1": df1, "d2": df2}, formula)


def t_upper_quantile(tail: Column | str, df: Column | str) -> Column:
    """t with P(T > t) = tail, for tails below one half.

    Newton's method on the logarithm of the tail, which is concave: from a start on the left it closes in without overshooting much.
    """
    tail, df = (F.col(c) if isinstance(c, str) else c for c in (tail, df))

    def formula(v):
        df, goal = v["df"], F.log(v["tail"] * 2)
        # the density at t, twice for both tails
        log_scale = _log_half_step(df / 2) - 0.5 * F.log(df * math.pi) + math.log(2.0)

        def step(s, _):
            t = s["t"]
            p = t_p_value(t, df)
            density = F.exp(log_scale - (df + 1) / 2 * F.log1p(t * t / df))
            return {"t": F.get(F.transform(F.array(p), lambda p: t + (F.log(p) - goal) * p / density), F.lit(0))}

        start = F.sqrt(df * (F.pow(v["tail"] * 2, F.lit(-2.0) / df) - 1)) * 0.5
        good = (df > 0) & (v["tail"] > 0) & (v["tail"] < 0.5)
        return F.when(good, _fold(ROUNDS, {"t": F.least(start, F.lit(1e3) + start * 0)}, step, "t"))

    return _bound({"tail": tail, "df": df}, formula)
