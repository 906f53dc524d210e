"""Ranks, quantiles and sequence numbers: equal to numpy and pandas however many ranges there are."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permspark.operators import ordered
from permspark.sources.writers import staged

RANGES = [1, 3, 40, None]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # one group holds a third of the rows, values repeat, some are missing, one is a far outlier
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    v = np.round(rng.lognormal(0, 2, n) * np.where(rng.random(n) < 0.5, 1, -1), 1)
    pdf = pd.DataFrame({"g": g.astype("int64"), "id": np.arange(n), "v": v})
    pdf.loc[pdf.index % 17 == 0, "v"] = None
    pdf.loc[5, "v"] = 1e9
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df.persist()


@pytest.mark.parametrize("ranges", RANGES)
def test_average_rank(values, ranges):
    pdf, df = values
    got = ordered.average_rank(df, ["g"], "v", "r", ranges=ranges).toPandas().set_index("id").sort_index()
    want = pdf.set_index("id").groupby("g")["v"].rank(method="average")
    pd.testing.assert_series_equal(got["r"].astype(float), want, check_names=False)
    assert len(got) == len(pdf)


@pytest.mark.parametrize("ranges", RANGES)
def test_global_rank_sums(values, ranges):
    pdf, df = values
    got = ordered.average_rank(df, [], "v", "r", ranges=ranges).agg(F.sum("r"), F.count("r")).first()
    n = int(pdf["v"].notna().sum())
    assert got[1] == n and got[0] == n * (n + 1) / 2


@pytest.mark.parametrize("ranges", RANGES)
def test_quantiles(values, ranges):
    pdf, df = values
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    got = ordered.quantiles(df, ["g"], "v", probs, ranges=ranges).toPandas().set_index("g").sort_index()
    for name, p in probs.items():
        want = pdf.groupby("g")["v"].quantile(p)
        np.testing.assert_allclose(got[name].to_numpy(float), want.sort_index().to_numpy(), rtol=1e-12)
    assert (got["n_total"] == pdf.groupby("g")["v"].count()).all()


def test_quantiles_of_constant_and_empty_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "g int, v double")
    for ranges in RANGES:
        rows = ordered.quantiles(df, ["g"], "v", {"m": 0.5}, ranges=ranges).collect()
        assert [tuple(r) for r in rows] == [(1, 2.0, 2)]
    kept = ordered.keep_groups(ordered.quantiles(df, ["g"], "v", {"m": 0.5}), df, ["g"]).orderBy("g").collect()
    assert [(r["g"], r["m"]) for r in kept] == [(1, 2.0), (2, None)]


@pytest.mark.parametrize("ranges", RANGES)
def test_sequence_index(values, ranges):
    pdf, df = values
    known = df.where("v is not null")
    got = ordered.sequence_index(known, ["v", "id"], keys=["g"], ranges=ranges).toPandas()
    want = pdf.dropna().sort_values(["v", "id"]).groupby("g").cumcount() + 1
    got = got.set_index("id")["row_id"].sort_index()
    assert (got.to_numpy() == want.sort_index().to_numpy()).all()


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    for ranges in RANGES:
        rows = {r["g"]: r["m"] for r in ordered.quantiles(df, ["g"], "v", {"m": 0.5}, ranges=ranges).collect()}
        assert rows == {None: 2.0, "a": 5.0}


def test_order_of_any_type(spark):
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"id": np.arange(n), "t": [f"x{k}" if k % 5 else None for k in rng.integers(0, 60, n)], "m": rng.integers(0, 50, n)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, t string, m long")
    df = df.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("m").cast("int")))
    want = pdf.sort_values(["t", "m", "id"], na_position="first")["id"].tolist()
    for ranges in RANGES:
        got = ordered.sequence_index(df, ["t", "d", "id"], ranges=ranges).orderBy("row_id").select("id", "row_id", "n_total").collect()
        assert [r["id"] for r in got] == want and [r["row_id"] for r in got] == list(range(1, n + 1)) and got[0]["n_total"] == n
        ranks = {r["id"]: r["rank"] for r in ordered.average_rank(df, [], "t", ranges=ranges).collect()}
        plain = pdf["t"].rank(method="average")
        assert all((ranks[i] is None and np.isnan(plain[i])) or ranks[i] == plain[i] for i in range(n))


def test_inner_columns_do_not_clash(spark):
    """Callers keep scratch columns, too."""
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0)], "id int, __b double")
    got = ordered.average_rank(df, [], "__b", "r").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 2.5), (2, 1.0, 1.0), (3, 3.0, 2.5)]


def test_one_value_and_no_rows(spark):
    same = spark.range(300).withColumn("v", F.lit(7.0))
    for ranges in RANGES:
        assert {r["rank"] for r in ordered.average_rank(same, [], "v", ranges=ranges).collect()} == {150.5}
        assert sorted(r["row_id"] for r in ordered.sequence_index(same, ["v", "id"], ranges=ranges).collect()) == list(range(1, 301))
        for empty in (same.limit(0), same.withColumn("v", F.lit(None).cast("double"))):
            assert ordered.quantiles(empty, [], "v", {"m": 0.5}, ranges).count() == 0
            assert ordered.average_rank(empty, [], "v", ranges=ranges).where("rank is not null").count() == 0
        assert ordered.sequence_index(same.limit(0), ["v"], ranges=ranges).count() == 0


def test_medians_of_several_columns(values):
    pdf, df = values
    more = df.withColumn("w", F.when(F.col("g") > 3, F.col("id") % 10)).withColumn("none", F.lit(None).cast("double"))
    got = ordered.medians_of(more, ["g"], {"v": "a", "w": "b", "none": "c"}).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(got["a"].to_numpy(float), pdf.groupby("g")["v"].median().to_numpy(), rtol=1e-12)
    want = (pdf["id"] % 10).where(pdf["g"] > 3).groupby(pdf["g"]).median()
    np.testing.assert_allclose(got["b"].to_numpy(float), want.to_numpy())
    assert got["c"].isna().all()


@pytest.mark.parametrize("bracketed", [ordered.BRACKETED, 300, 5])
def test_sketched_quantiles_are_exact(spark, bracketed):
    """Groups far larger than a sketch, with many ties, few values, and outliers; with more than one round of brackets."""
    rng = np.random.default_rng(4)
    n = 120_000
    g = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.5, "ties", "some"))
    v = np.where(g == "hot", rng.lognormal(0, 3, n), np.where(g == "ties", rng.integers(0, 5, n), rng.normal(size=n)))
    v[7] = -1e300
    pdf = pd.DataFrame({"g": g, "v": v})
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.95, "e": 1.0}
    df = spark.createDataFrame(pdf).repartition(16)
    got = ordered.quantiles(df, ["g"], "v", probs, bracketed=bracketed).toPandas().set_index("g")
    for key, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[key, list(probs)].to_numpy(float), np.quantile(part.v, list(probs.values())), rtol=1e-12)
        assert got.loc[key, "n_total"] == len(part)
    whole = ordered.quantiles(df, [], "v", probs, bracketed=bracketed).toPandas()
    np.testing.assert_allclose(whole[list(probs)].to_numpy(float)[0], np.quantile(pdf.v, list(probs.values())), rtol=1e-12)


def test_small_groups_need_no_sketch(spark, monkeypatch):
    """Many small groups beside a large one: only the large one is sketched, and all are exact."""
    sketched, brackets = [], ordered._brackets
    monkeypatch.setattr(ordered, "_brackets", lambda rows, *a: sketched.append(rows) or brackets(rows, *a))
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 3001).alias("g"), (F.col("id") * 37 % 9973).cast("double").alias("v"))
    want = df.toPandas().groupby("g").v
    for part, large in ((df, {-1}), (df.where("g >= 0"), set())):
        sketched.clear()
        got = part.transform(ordered.quantiles, ["g"], "v", {"a": 0.05, "m": 0.5}).toPandas().set_index("g")
        assert {r.g for x in sketched for r in x.select(F.col("__g0").alias("g")).distinct().collect()} == large
        assert len(got) == 3001 + len(large) and (got.n_total == want.count()[got.index]).all()
        for name, p in (("a", 0.05), ("m", 0.5)):
            np.testing.assert_allclose(got[name], want.quantile(p)[got.index], rtol=1e-12)


def test_a_wrong_bracket_is_noticed(spark, monkeypatch):
    """Brackets that are trusted too far: the counts show it, and ranges give the answer."""
    monkeypatch.setattr(ordered, "RANK_ERROR", -0.05)
    monkeypatch.setattr(ordered, "SMALL", 10)
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 5000).cast("double").alias("v"))
    got = {r.g: r.m for r in ordered.quantiles(df, ["g"], "v", {"m": 0.3}).collect()}
    pdf = df.toPandas()
    assert got == {k: pytest.approx(np.quantile(x.v, 0.3)) for k, x in pdf.groupby("g")}


def test_no_range_is_deep(spark):
    """Far outliers, one hot key and one hot first value fill ranges of the usual depth."""
    n, ranges = 60_000, 30
    df = spark.range(0, n, 1, 8).select(
        "id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("g"),
        F.when(F.col("id") == 5, -1e300).when(F.col("id") % 2 == 0, 1e6).otherwise(1e6 + F.col("id") / 1e6).alias("v"),
    )
    for order in (["v", "id"], ["g", "v", "id"], ["id"]):
        depth = ordered._in_ranges(df, order, ranges).groupBy("__range").count().agg(F.max("count"), F.count("*")).first()
        assert depth[0] <= 2.5 * n / ranges and depth[1] == ranges, order


def _attached(df):
    from permspark.operators.grouping import attach

    return attach(df, ["g"], F.avg("v").alias("m"))


def _star(df):
    from permspark.operators.joins import star

    return star(df, [staged(df.groupBy("g").agg(F.avg("v").alias("m"))), staged(df.groupBy("g").agg(F.max("v").alias("top")))], ["g"])


def _overlay(df):
    from permspark.sources.readers import overlay

    return overlay(df, staged(df.groupBy("g").agg(F.avg("v").alias("m"))), "g", ["m"])


@pytest.mark.parametrize("make", [_attached, _star, _overlay])
def test_hot_key_join_is_split(spark, tmp_path, make):
    """Joins with a stored reduced table leave a plan in which adaptive execution splits the hot partition."""

    from permspark.session import RECOMMENDED

    conf = {
        **{k: v for k, v in RECOMMENDED.items() if "adaptive" in k},
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(0, 400000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("g"), F.rand(1).alias("v"), "id"
        )
        out = make(df)
        out.write.mode("overwrite").parquet(str(tmp_path / "o"))
        out.collect()
        assert "isSkew=true" in out._jdf.queryExecution().executedPlan().toString() or "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
