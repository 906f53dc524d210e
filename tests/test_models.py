"""Forest scoring, quantile forests, feature screening and the applicability domain against numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permspark.operators import features as FE
from permspark.operators import models as M

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=COLS)
    pdf["id"] = np.arange(n)
    pdf["y"] = np.round(2 * pdf.a - pdf.b + rng.normal(0, 0.3, n), 2)
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def fitted(data):
    return M.fit_forest(data.where("id < 200"), COLS, "y", False, trees=6, depth=3, seed=3)


@pytest.mark.parametrize("known", [200, 9])
def test_quantile_forest_equals_brute_force(data, fitted, known):
    """Also where some leaves hold no training row."""
    train, new = data.where(f"id < {known}"), data.where("id >= 200")
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    got = M.quantile_forest(fitted, train, new, COLS, "y", "id", probs).toPandas().set_index("id").sort_index()
    tl = M.leaf_rows(fitted, train, COLS, ["id", "y"]).toPandas()
    nl = M.leaf_rows(fitted, new, COLS, ["id"]).toPandas()
    unmet = 0
    for i, rows in nl.groupby("id"):
        weight: dict[float, float] = {}
        for r in rows.itertuples():
            mates = tl[(tl.tree == r.tree) & (tl.leaf == r.leaf)]
            for y in mates.y:
                weight[y] = weight.get(y, 0.0) + 1 / len(mates)
        if not weight:
            unmet += 1
            continue
        ys = np.array(sorted(weight))
        cum = np.cumsum([weight[y] for y in ys]) / sum(weight.values())
        for name, p in probs.items():
            assert got.loc[i, name] == ys[np.argmax(cum >= p - 1e-9)], (i, name)
    assert len(got) == 40 - unmet


def test_score_guard(data, fitted):
    holes = data.withColumn("b", F.when(F.col("id") % 4 != 0, F.col("b")))
    asked = data.select("id").unionByName(data.sparkSession.createDataFrame([(999,)], "id long"))
    out = M.score_complete(fitted, holes, COLS, "id", asked).toPandas().set_index("id")["prediction"]
    assert len(out) == 241
    assert out[out.index % 4 == 0].isna().all() and np.isnan(out[999])
    full = M.score_complete(fitted, data, COLS, "id").toPandas().set_index("id")["prediction"]
    keep = [i for i in full.index if i % 4]
    np.testing.assert_allclose(out[keep], full[keep])


def test_mtry_grid_and_tuning(spark):
    assert M.mtry_grid(25, True) == sorted(set(M.mtry_grid(25, True))) and 5 in M.mtry_grid(25, True)
    errors = spark.createDataFrame([(3, 0.2), (5, 0.1), (7, 0.1)], "mtry int, error double")
    assert M.tune_mtry(errors) == 7


def test_elimination_path(data):
    path, scores = M.eliminate_features(data, COLS, "y", ["id"], False, [1, 2], folds=2, trees=5, depth=3)
    assert sorted(r["size"] for r in path.collect()) == [1, 2, 3]
    assert [r["feature"] for r in M.chosen_features(scores, 1).collect()] == ["a"]


def test_redundant_columns():
    m = np.array([[1, 0.95, 0.5, 0.1], [0.95, 1, 0.1, 0.1], [0.5, 0.1, 1, 0.92], [0.1, 0.1, 0.92, 1]])
    assert FE.redundant_columns(m, list("abcd")) == ["a", "c"]
    assert FE.redundant_columns(np.eye(3), list("abc")) == []


def test_spearman_matrix(data):
    pdf = data.select(*COLS, "y").toPandas()
    np.testing.assert_allclose(FE.correlation_matrix(data, [*COLS, "y"]), pdf.corr("spearman").to_numpy(), atol=1e-9)


def test_low_information(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("good"), F.lit(1.0).alias("same"), F.lit(None).cast("double").alias("none"),
        (1000 + F.col("id") % 2).cast("double").alias("steady"),
    )
    assert sorted(FE.low_information(df, ["good", "same", "none", "steady"])) == ["none", "same", "steady"]


def test_applicability(spark):
    p = FE.Profile({c: 0.0 for c in COLS}, {c: 1.0 for c in COLS})
    rows = [(1, 0.1, 0.2, 0.3), (2, 4.0, 5.0, 6.0), (3, 3.1, 0.0, 0.0), (4, 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: (r["in_domain"], r["domain_score"]) for r in FE.applicability(df, COLS, p).collect()}
    assert got[1][0] == 1 and got[2][0] == 0
    for i, s in ((3, [3.1, 0, 0]), (4, [9.0, 0, 0])):
        score = np.mean(s) + 1.28 * np.std(s, ddof=1)
        assert abs(got[i][1] - score) < 1e-12 and got[i][0] == int(score <= 3)


def test_applicability_of_constant_and_missing_descriptors(spark):
    p = FE.Profile({c: 0.0 for c in COLS}, {"a": 1.0, "b": 0.0, "c": 1.0})
    df = spark.createDataFrame([(1, 0.1, 0.0, 0.3), (2, 0.1, 0.5, 0.3), (3, None, 0.0, 0.1), (4, 9.0, 0.5, 9.0)], "id int, a double, b double, c double")
    got = {r["id"]: (r["in_domain"], r["domain_score"]) for r in FE.applicability(df, COLS, p).collect()}
    assert got[1][0] == 1 and got[2] == (0, float("inf")) and got[3] == (None, None) and got[4] == (0, float("inf"))


def test_imputation_uses_training_means(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, 10.0)], "a double, b double")
    new = spark.createDataFrame([(None, None)], "a double, b double")
    p = FE.Profile.fit(train, ["a", "b"])
    assert tuple(FE.impute(new, p).first()) == (2.0, 10.0)


def test_forests_and_cuts_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(*[((F.col("id") * (7 + 2 * k)) % (31 + k)).cast("double").alias(c) for k, c in enumerate("abcd")])
    df = df.withColumn("y", ((F.col("a") + F.col("b")) > 30).cast("double")).persist()
    many = [df.repartition(n) for n in (1, 4, 9)]
    assert len({str(M.fit_forest(d, list("abcd"), "y", True, trees=5, depth=3).featureImportances) for d in many}) == 1
    assert len({str([round(c, 9) for c in FE.cluster_cuts(d, "a", [5])[5]]) for d in many}) == 1


def test_cluster_cuts(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0.1, 0.2, 10, 10.1, 10.2, None or 10.0]], "v double")
    (cut,) = FE.cluster_cuts(df, "v", [2])[2]
    assert 4 < cut < 6


def test_guarded_scoring_query_uses_every_descriptor(spark, monkeypatch):
    from permspark.catalog import models as Q

    used, fit, score = [], M.fit_forest, M.score_complete
    monkeypatch.setattr(M, "fit_forest", lambda df, cols, *a, **b: used.append(cols) or fit(df, cols, *a, **b))
    monkeypatch.setattr(M, "score_complete", lambda model, df, cols, *a: used.append(cols) or score(model, df, cols, *a))
    out = Q.score_with_guard(spark, "/root/testdata/sf0.001")
    assert used == [Q.COLS, Q.COLS] and out.filter("scored <> (vec_id % 9 <> 0)").count() == 0


def test_univariate_logistic_equals_plain_newton(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = (rng.random(n) < 0.4).astype(float)
    pdf = pd.DataFrame({"y": y, "strong": rng.normal(size=n) + y, "none": 1e3 + rng.normal(size=n), "split": y * 2 + rng.random(n), "touch": np.where(y > 0, 1 + rng.random(n), rng.random(n).clip(0, 1)), "same": 5.0})
    pdf["holes"] = pdf.strong.where(pdf.index % 3 > 0)
    cols = ["strong", "none", "split", "touch", "same", "holes", "empty"]
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double"))
    got = {r["column"]: r for r in FE.univariate_logistic(df, cols, "y").collect()}
    for c in ("strong", "none", "holes"):
        known = pdf.dropna(subset=[c])
        x, b = np.column_stack([np.ones(len(known)), known[c] - 1e3 * (c == "none")]), np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ b))
            h = (x.T * (p * (1 - p))) @ x
            b = b + np.linalg.solve(h, x.T @ (known.y - p))
        assert got[c].slope == pytest.approx(b[1]) and got[c].se == pytest.approx(np.linalg.inv(h)[1, 1] ** 0.5) and got[c].n == len(known)
        assert got[c].p_value == pytest.approx(math.erfc(abs(b[1]) / got[c].se / 2**0.5))
    assert all(got[c].separated and got[c].p_value == 0 and got[c].slope is None for c in ("split", "touch"))
    assert got["same"].p_value is None and "empty" not in got
    assert FE.logistic_screen(df, cols, "y", 1e-4) == ["strong", "split", "touch", "holes"]
