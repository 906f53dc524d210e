"""Regression, agreement, classes and bootstrap against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import plain_t as D
from permspark.operators import stats as T
from permspark.plans import evaluate as E


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(3, 2, n)
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "x": x, "y": 0.7 * x + rng.normal(0, 1, n) + 1})
    pdf.loc[::29, "y"] = None
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return pdf, df.persist()


def test_ols_with_p_value(xy):
    pdf, df = xy
    known = pdf.dropna()
    r = T.ols(df, "x", "y", p_value=True).first()
    x, y = known.x.to_numpy(), known.y.to_numpy()
    slope, intercept = np.polyfit(x, y, 1)
    res = y - slope * x - intercept
    se = np.sqrt(res @ res / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
    assert r["slope"] == pytest.approx(slope) and r["intercept"] == pytest.approx(intercept)
    assert r["t_stat"] == pytest.approx(slope / se) and r["n"] == len(known)
    assert r["p_value"] == pytest.approx(D.t_two_sided(slope / se, len(x) - 2))


def test_tls_is_the_first_principal_axis(xy):
    pdf, df = xy
    for g, part in pdf.dropna().groupby("g"):
        v = np.linalg.eigh(np.cov(part.x, part.y))[1][:, 1]
        r = T.tls(df.where(F.col("g") == int(g)), "x", "y").first()
        assert r["tls_slope"] == pytest.approx(v[1] / v[0])
        assert r["tls_intercept"] == pytest.approx(part.y.mean() - v[1] / v[0] * part.x.mean())


@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("scale", [0.01, 100.0])
def test_tls_steep_and_flat(spark, sign, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = sign * scale * x + rng.normal(size=200) * scale / 50
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    v = np.linalg.eigh(np.cov(x, y))[1][:, 1]
    assert T.tls(df, "x", "y").first()["tls_slope"] == pytest.approx(v[1] / v[0], rel=1e-9)


def test_residuals_sum_to_zero(xy):
    _, df = xy
    r = T.tls_residuals(df, "x", "y", ["g"])
    assert abs(r.agg(F.sum("residual")).first()[0]) < 1e-9 and r.count() == df.where("y is not null").count()


def test_prediction_interval(xy):
    pdf, df = xy
    k = pdf.dropna()
    rows = T.prediction_interval(df, "x", "y", points=11).orderBy("i").toPandas()
    n, x = len(k), k.x.to_numpy()
    mse = ((k.x - k.y) ** 2).sum() / (n - 2)
    xn = np.linspace(x.min(), x.max(), 11)
    half = D.t_quantile(0.025, n - 2) * np.sqrt(mse * (1 + 1 / n + (xn - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    np.testing.assert_allclose(rows.xn, xn)
    np.testing.assert_allclose(rows.upper - rows.xn, half, rtol=1e-9)


def test_agreement_matches_definition(xy):
    pdf, df = xy
    k = pdf.dropna()
    r = T.agreement(df, "x", "y").first()
    sst, sse = ((k.y - k.y.mean()) ** 2).sum(), ((k.y - k.x) ** 2).sum()
    assert r["sst"] == pytest.approx(sst) and r["sse"] == pytest.approx(sse) and r["r2"] == pytest.approx(1 - sse / sst)
    assert r["cor"] == pytest.approx(np.corrcoef(k.x, k.y)[0, 1]) and r["n"] == len(k)


def test_subtotals_add_the_whole(xy):
    _, df = xy
    r = {(x["g"], x["part"]): x["n"] for x in T.agreement_subtotals(df.withColumn("part", F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))), "x", "y", ["g"], "part").collect()}
    for g in range(3):
        assert r[(g, "All")] == r[(g, "a")] + r[(g, "b")]


def test_kappa(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    df = spark.createDataFrame(pairs, "p string, o string")
    r = T.class_agreement(df, "p", "o").first()
    assert r["accuracy"] == pytest.approx(0.7) and r["kappa"] == pytest.approx(0.4) and r["n"] == 50
    none = T.class_agreement(df.where("p = o and p = 'a'"), "p", "o").first()
    assert none["accuracy"] == 1.0 and none["kappa"] is None


def test_kappa_of_types_that_differ(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "p int, o int")
    assert T.class_agreement(df, "p", "o").first()["accuracy"] == pytest.approx(2 / 3)


def test_kappa_of_numbers_of_two_types(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 1)], "p double, o int")
    assert T.class_agreement(df, "p", "o").first()["accuracy"] == pytest.approx(2 / 3)


def test_exact_fit_has_p_zero(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    assert T.ols(df, "x", "y", p_value=True).first()["p_value"] == 0.0


def test_binary(spark):
    pairs = [("high", "high")] * 8 + [("low", "high")] * 2 + [("high", "low")] * 3 + [("low", "low")] * 7
    r = T.binary_agreement(spark.createDataFrame(pairs, "p string, o string"), "p", "o").first()
    assert (r["high_accuracy"], r["low_accuracy"], r["balanced_accuracy"]) == (0.8, 0.7, 0.75)
    assert r["kappa"] == pytest.approx((0.75 - 0.5) / 0.5)


def test_bootstrap_draws_are_complete_and_fair(xy):
    _, df = xy
    known = df.where("y is not null")
    sizes = {r["g"]: r["n"] for r in known.groupBy("g").agg(F.count("*").alias("n")).collect()}
    draws = T.bootstrap_draws(known, ["g"], "id", 50, 7).persist()
    per = draws.groupBy("g", "rep").agg(F.count("*").alias("n")).collect()
    assert len(per) == 150 and all(r["n"] == sizes[r["g"]] for r in per)
    hits = draws.groupBy("id").agg(F.count("*").alias("n")).toPandas()["n"]
    assert len(hits) == sum(sizes.values()) and 40 < hits.mean() < 60 and 4 < hits.std() < 11


def test_bootstrap_draws_are_not_broadcast(spark):
    # a small table: its size is what Spark takes for the size of the draws
    df = spark.range(40).select("id", (F.col("id") % 2).alias("g"))
    draws = T.bootstrap_draws(df, ["g"], "id", 100, 7, partitions=2)
    assert draws.count() == 4000
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [g#" in plan and ", __pos#" in plan.split("ShuffledHashJoin [g#")[1].split("]")[0]


@pytest.mark.parametrize("fn", [T.bootstrap, T.bootstrap_poisson])
def test_bootstrap_brackets_the_sample(xy, fn):
    pdf, df = xy
    k = pdf.dropna()
    r = fn(df.withColumn("all", F.lit(1)), ["all"], "id", "y", "x", 200, 3).first()
    r2 = np.corrcoef(k.x, k.y)[0, 1] ** 2
    assert r["replicates"] == 200 and r["r2_low"] < r2 < r["r2_high"] and abs(r["r2_median"] - r2) < 0.03
    assert r["rmse_median"] == pytest.approx(np.sqrt(((k.x - k.y) ** 2).mean()), rel=0.1)


@pytest.mark.parametrize("held", [T.HELD, 50])
def test_poisson_sums_equal_spark_expressions(spark, monkeypatch, held):
    """Repeated and missing ids, missing keys, an infinite value; without a row for each row and replicate."""
    monkeypatch.setattr(T, "HELD", held)
    rows = [(("a", "b:", None, "b")[k % 4], None if k % 7 == 0 else k % 40, k % 3, float("inf") if k == 30 else k / 7, float(k * k % 11)) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, id long, h int, y double, x double")
    batches = df.select("g", "h", T.hash_text(F.lit("5"), "g", "h"), T.hash_text("id"), "y", "x", (F.col("y") - F.col("x")) ** 2).toArrow().to_batches()
    got = {}
    for batch in T._poisson_sums(2, 10, batches):
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            got[r[:3]] = np.add(got.get(r[:3], 0.0), r[3:])
    each = df.select("*", T.rep_blocks(10).alias("b")).withColumn("hex", T.hash_hex(5, "g", "h", "b", "id"))
    each = each.select("g", "h", "x", "y", T.block_numbers("b", "hex", "n")).where("rep <= 10").withColumn("w", T.poisson_weight(T.hash_int("n") / 2.0**32))
    sums = [F.sum("w"), *[F.sum(F.when(F.col("w") > 0, F.col("w") * F.expr(c))) for c in ("y", "x", "y * y", "x * x", "x * y", "(y - x) * (y - x)")]]
    want = {tuple(r[:3]): [v or 0.0 for v in r[3:]] for r in each.groupBy("g", "h", "rep").agg(*sums).collect()}
    assert len(want) == 120 and got.keys() == want.keys()
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-12, err_msg=str(k))
    plan = T.bootstrap_poisson(df.where("y < 100"), ["g"], "id", "y", "x", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_poisson_weights_have_unit_mean(spark):
    df = spark.range(20000).select(T.poisson_weight((F.col("id") + 0.5) / 20000).alias("w"))
    r = df.agg(F.avg("w"), F.var_pop("w")).first()
    assert r[0] == pytest.approx(1.0, abs=1e-3) and r[1] == pytest.approx(1.0, abs=2e-3)


def test_calibration_needs_enough_entities(spark):
    rows = [("big", i, float(i)) for i in range(6)] + [("small", i, float(i)) for i in range(4)]
    values = spark.createDataFrame(rows, "lab string, e int, v double")
    ref = spark.createDataFrame([(i, 2.0 * i + 1) for i in range(6)], "e int, r double")
    out = {r["e"]: r for r in E.calibrate_labs(values, ref, "lab", "e", "v", "r").collect()}
    assert len(out) == 6
    for i, r in out.items():
        assert r["median_ols"] == pytest.approx(2 * i + 1) and r["median_tls"] == pytest.approx(2 * i + 1)


def test_route_adjusts_oral_only(spark):
    df = spark.createDataFrame([("Oral", 10.0), ("IV", 10.0)], "route string, auc double")
    out = E.route_adjusted(df, ["route"], "route", "Oral", "auc", {"m": F.lit(0.5)}).collect()
    assert {(r["route"], r["predicted"]) for r in out} == {("Oral", 5.0), ("IV", 10.0)}


def test_sketched_counts_keep_their_bound(spark):
    from permspark.operators import grouping as G

    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 25_000).alias("m"), F.col("id").alias("x"))
    tests = {"low": F.col("x") < 30_000, "third": F.col("m") % 3 == 0}
    for size, exact in ((16, True), (10, False)):
        for r in G.sketched_counts(df, "m", tests, ["g"], [("low", "third")], size).collect():
            members = [m for m in range(25_000) if m % 2 == r.g]
            want = {"low": len(members), "third": sum(m % 3 == 0 for m in members), "low_and_third": sum(m % 3 == 0 for m in members), "low_or_third": len(members)}
            for name, n in want.items():
                either = want["low_or_third"] if "_and_" in name else n
                assert r[name] == n and r[f"{name}_error"] == 0 if exact else abs(r[name] - n) <= 2 * r[f"{name}_error"] * either
    none = G.sketched_counts(df, "m", {"none": F.col("x") < 0}, ["g"]).collect()
    assert [r.none for r in none] == [0, 0]
