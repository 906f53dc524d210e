"""Exact sample sizes, determinism, whole entities, hot strata."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from permspark.operators import sampling as P


@pytest.fixture(scope="module")
def strata(spark):
    # stratum 0 holds more than a third of the rows
    return spark.range(3000).select("id", F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 7 + 1).alias("s")).persist()


def test_exact_sizes_and_hash_order(strata):
    got = P.sample_strata(strata, ["s"], ["id"], F.lit(40), 11).toPandas()
    assert (got.groupby("s").size() == 40).all()
    pdf = strata.toPandas()
    pdf["h"] = [hashlib.md5(f"11:{i}".encode()).hexdigest() for i in pdf["id"]]
    want = pdf.sort_values("h").groupby("s").head(40)
    assert set(got["id"]) == set(want["id"])


def test_small_strata_are_taken_whole(strata):
    n = strata.where("s = 1").count()
    got = P.sample_strata(strata.where("s = 1"), ["s"], ["id"], F.lit(10 * n), 1)
    assert got.count() == n
    assert P.sample_strata(strata, ["s"], ["id"], F.lit(0), 1).count() == 0


def test_repartitioning_does_not_change_the_sample(strata):
    a = {r["id"] for r in P.sample_strata(strata, ["s"], ["id"], F.lit(25), 3).collect()}
    b = {r["id"] for r in P.sample_strata(strata.repartition(13, F.rand(1)), ["s"], ["id"], F.lit(25), 3).collect()}
    assert a == b


def test_grouped_split_keeps_entities_together(spark):
    rows = [(e, b) for e in range(200) for b in (e % 5 + 1, e % 5 + 1, (e + 1) % 5 + 1)]
    df = spark.createDataFrame(rows, "e int, bin int")
    out = P.grouped_split(df, "e", "bin", 0.1, 5, forced_train=[0, 1]).toPandas()
    assert len(out) == 600 and (out.groupby("e")["test"].nunique() == 1).all()
    per = out.drop_duplicates("e").groupby("consensus").agg(n=("e", "size"), t=("test", "sum"))
    assert ((per["n"] * 0.1 - per["t"]).between(-0.51, 2.51)).all() and not out[out.e.isin([0, 1])]["test"].any()


def test_rounded_sizes(spark):
    def val(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert val(P.rounded_size(F.lit(47), "ten")) == 40 and val(P.rounded_size(F.lit(30), "ten")) == 20
    assert val(P.rounded_size(F.lit(40), "ten")) == 40 and val(P.rounded_size(F.lit(47), "one")) == 47


def test_roles_are_balanced_and_exclusive(spark):
    df = spark.range(1000).select(
        "id", ((F.col("id") % 100) / 25.0 - 2.0).alias("v"), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.lit("y")).alias("src"),
        (F.col("id") % 10 / 10.0).alias("eff"),
    )
    reserve = spark.range(50).select("id")
    o = P.SplitOptions(breaks=(0.5,), limits=(-2.0, 2.0), efflux_break=0.45, efflux_size=15)
    out = P.balanced_roles(df, "id", "v", "src", "eff", reserve, o).toPandas()
    assert len(out) == 1000 and out["role"].notna().all()
    train = out[out.role == "train"].groupby(["category", "src"]).size()
    assert len(train) == 4 and train.nunique() == 1 and train.iloc[0] % 10 == 0
    assert (out.role == "train_efflux").sum() == 30
    assert set(out[out.role == "reserve"]["id"]) <= set(range(50))


def test_gap_excludes_the_middle_and_recuts(spark):
    df = spark.range(300).select("id", (F.col("id") / 100.0).alias("v"))
    o = P.SplitOptions(breaks=(1.0, 2.0), limits=(0.0, 3.0), gap=True, rounding="one")
    out = P.balanced_roles(df, "id", "v", options=o).toPandas()
    assert set(out["category"]) == {"low", "high"}
    assert not out[(out.role == "train") & out.v.between(1.0, 1.99)].shape[0]
    assert (out[out.category == "low"]["v"] < 1.5).all()


def test_flatten_by_list(spark):
    df = spark.range(100).select("id", (F.col("id") / 50.0).alias("v"))
    o = P.SplitOptions(breaks=(1.0,), limits=(0.0, 2.0), flatten=(0.0, 0.5, 1.0, 1.5, 2.0), train_size=4)
    out = P.balanced_roles(df, "id", "v", options=o).toPandas()
    # four full sub-bins, and the break value 1.0 alone: it is high, but (0.5, 1.0] is the second sub-bin
    assert (out.role == "train").sum() == 4 * 4 + 1
    assert out[out["id"] == 0]["category"].isna().all()
