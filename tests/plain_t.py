"""Student-t tails and quantiles in plain Python, to compare with."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for numer in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numer * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numer / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def _log_beta_factor(a: float) -> float:
    """ln(1 / B(a, 1/2)); the series avoids subtracting two huge log-gammas for many degrees of freedom."""
    if a > 50:
        half_step = 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    else:
        half_step = math.lgamma(a + 0.5) - math.lgamma(a)
    return half_step - 0.5 * math.log(math.pi)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|): the regularised incomplete beta function at df / (df + t^2)."""
    if t == 0:
        return 1.0
    a, square = df / 2.0, t * t
    x, rest = df / (df + square), square / (df + square)
    front = math.exp(_log_beta_factor(a) - a * math.log1p(square / df) + 0.5 * math.log(rest))
    if x < (a + 1.0) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x) / a
    return 1.0 - front * _beta_fraction(0.5, a, rest) / 0.5


def t_quantile(upper_tail: float, df: float) -> float:
    """t with P(T > t) = upper_tail, for tails below one half."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 2 * upper_tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > 2 * upper_tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0
