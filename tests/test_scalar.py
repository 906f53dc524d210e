"""Scalar rules: missing values, rounding, formulas with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from permspark.functions import chemistry as ch
from tests import plain_t as D
from permspark.functions import scalar as S


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(
    "x,digits,want",
    [(0.0, 3, 0.0), (123456.0, 3, 123000.0), (0.0123456, 2, 0.012), (-2.3456, 3, -2.35), (99.96, 3, 100.0), (1000.0, 1, 1000.0)],
)
def test_signif(spark, x, digits, want):
    assert value(spark, S.signif(num(x), digits)) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("x,digits,want", [(0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (25.0, -1, 20.0), (35.0, -1, 40.0), (-2.5, 0, -2.0)])
def test_half_even(spark, x, digits, want):
    assert value(spark, S.half_even(num(x), digits)) == want


@pytest.mark.parametrize(
    "expr",
    [
        lambda: S.ratio(num(1.0), num(0.0)),
        lambda: S.log10(num(0.0)),
        lambda: S.log10(num(-1.0)),
        lambda: S.number_or_null(F.lit("ND")),
        lambda: S.number_or_null(F.lit("NaN")),
        lambda: S.number_or_null(F.lit("Infinity")),
        lambda: S.finite_or_null(num(float("-inf"))),
        lambda: S.blank_to_null(F.lit("")),
        lambda: S.row_mean([num(None), num(None)]),
        lambda: S.row_sd([num(1.0), num(None)], num(1.0), F.lit(1)),
        lambda: S.bin_index(num(0.0), [0, 1]),
        lambda: S.bin_index(num(None), [0, 1]),
        lambda: S.cut_index(num(None), [1.0]),
    ],
)
def test_missing_results_are_null(spark, expr):
    assert value(spark, expr()) is None


def test_set_membership_ignores_missing(spark):
    assert value(spark, S.in_set(F.lit(None).cast("string"), ["a"])) is False
    assert value(spark, S.not_in_set(F.lit(None).cast("string"), ["a"])) is True


def test_row_statistics(spark):
    cols = [num(1.0), num(None), num(4.0)]
    assert value(spark, S.row_mean(cols)) == 2.5
    assert value(spark, S.row_count(cols)) == 2
    assert value(spark, S.row_sd(cols, S.row_mean(cols), S.row_count(cols))) == pytest.approx(math.sqrt(4.5))


def test_non_missing(spark):
    assert value(spark, S.non_missing(F.array(num(1.0), num(None), num(2.0)))) == [1.0, 2.0]
    assert value(spark, S.non_missing(F.array(num(None), num(None)))) == [None]


def test_bins_are_half_open(spark):
    assert [value(spark, S.bin_index(num(x), [0, 1, 2])) for x in (1.0, 1.5, 2.0, 2.1)] == [1, 2, 2, None]
    assert [value(spark, S.cut_index(num(x), [1.0, 2.0])) for x in (1.0, 1.1, 2.0, 9.0)] == [1, 2, 2, 3]


def test_packed_interval_round_trip(spark):
    text = S.packed_interval(num(0.2345), num(0.0321), num(3.21))
    assert value(spark, text) == "0.23 (0.032 - 3.2)"
    assert tuple(value(spark, S.unpack_interval(text))) == (0.23, 0.032, 3.2)
    assert tuple(value(spark, S.unpack_interval(F.lit("0.23,0.032,3.2")))) == (0.23, 0.032, 3.2)


def test_logit_sigmoid_inverse(spark):
    assert value(spark, S.sigmoid(S.logit(num(0.3), 0.0))) == pytest.approx(0.3)
    assert value(spark, S.logit(num(0.0), 1e-6)) == pytest.approx(math.log(1e-6 / (1 + 1e-6)))


@pytest.mark.parametrize("peff,want", [(3.06e4 / 3600, 0.9989), (0.079e4 / 3600, 0.2544), (0.53, 0.4979)])
def test_fraction_absorbed(spark, peff, want):
    assert value(spark, ch.fraction_absorbed(num(peff))) == pytest.approx(want, abs=5e-5)


def test_effective_permeability(spark):
    assert value(spark, ch.effective_permeability(num(0.55))) == pytest.approx(0.5330, abs=5e-5)
    human = value(spark, ch.effective_permeability(num(2.4)))
    assert value(spark, ch.effective_permeability(num(2.4), ch.RAT)) == pytest.approx((human + 0.1815) / 1.039 / 10)


def test_ionisation_at_pka(spark):
    f = value(spark, ch.ion_fractions(F.lit("7.4"), F.lit(None), 7.4))
    assert f["fraction_neutral"] == pytest.approx(0.5) and f["fraction_negative"] == pytest.approx(0.5)
    f = value(spark, ch.ion_fractions(F.lit(None), num(7.4), 7.4))
    assert f["fraction_positive"] == pytest.approx(0.5) and f["fraction_zwitter"] == 0
    f = value(spark, ch.ion_fractions(F.lit("3.0,5.0"), F.lit("9.0"), 7.0))
    assert sum(f[k] for k in ("fraction_neutral", "fraction_negative", "fraction_positive", "fraction_zwitter")) == pytest.approx(1)
    f = value(spark, ch.ion_fractions(F.lit(None), F.lit(None), 7.4))
    assert f["fraction_neutral"] == 1 and f["fraction_charged"] == 0


def test_log_d(spark):
    assert value(spark, ch.log_d(num(2.0), num(0.0))) == pytest.approx(2.0)
    assert value(spark, ch.log_d(num(2.0), num(1.0))) == pytest.approx(-1.0)


def test_t_distribution():
    # known two-sided tails and quantiles
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert D.t_quantile(0.025, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert D.t_quantile(0.025, 1e7) == pytest.approx(1.959964, abs=1e-5)
    # against direct integration of the density
    df, t, n = 7, 1.3, 200000
    c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
    h = t / n
    area = sum(c * (1 + ((i + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n)) * h
    assert D.t_two_sided(t, df) == pytest.approx(1 - 2 * area, abs=1e-9)


def test_tails_and_quantiles_equal_plain_versions(spark):
    from permspark.functions import distributions as X

    cases = [(t, float(df)) for t in (0.0, 1e-8, -0.3, 1.0, 2.5, 7.0, 40.0) for df in (1, 2, 3, 7, 31, 200, 598, 3999, 4001, 50_000)]
    got = spark.createDataFrame([*cases, (None, 3.0), (1.0, 0.0)], "t double, df double").select("t", "df", X.t_p_value("t", "df").alias("p")).collect()
    for r in got:
        assert r.p is None if r.t is None or r.df == 0 else r.p == pytest.approx(D.t_two_sided(r.t, r.df), rel=1e-10)
    cases = [(a, float(df)) for a in (0.4, 0.1, 0.025, 1e-6) for df in (1, 2, 5, 30, 3000, 5000)]
    got = spark.createDataFrame([*cases, (0.6, 3.0)], "a double, df double").select("a", "df", X.t_upper_quantile("a", "df").alias("t")).collect()
    for r in got:
        assert r.t is None if r.a > 0.5 else r.t == pytest.approx(D.t_quantile(r.a, r.df), rel=1e-9)
    z = spark.createDataFrame([(x,) for x in (0.0, -0.5, 1.9, 2.82, 2.83, 6.0, 37.0)], "z double").select("z", X.normal_two_sided(F.col("z")).alias("p"))
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / 2**0.5), rel=1e-12) for r in z.collect())
    f = [(x, a, b) for x in (0.2, 1.0, 3.0, 20.0) for a, b in ((1.0, 10.0), (1.0, 598.0), (2.0, 7.0), (2.0, 400.0))]
    for r in spark.createDataFrame(f, "f double, a double, b double").select("*", X.f_p_value("f", "a", "b").alias("p")).collect():
        want = D.t_two_sided(math.sqrt(r.f), r.b) if r.a == 1 else (1 + 2 * r.f / r.b) ** (-r.b / 2)  # a closed form for two degrees
        assert r.p == pytest.approx(want, rel=1e-10)
