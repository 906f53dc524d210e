"""Joins, sets, harmonisation and grouping rules on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from permspark.operators import cleaning as C
from permspark.operators import grouping as G
from permspark.operators import joins as J
from permspark.operators import sets
from permspark.plans import harmonise as H
from permspark.plans import risk as R


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_interval_joins_agree(spark):
    # uneven disjoint bins with a gap, values on and around every edge
    edges = [0.0, 0.001, 0.002, 0.5, 7.0, 100.0]
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if i != 2], "bin int, lo double, hi double")
    vals = [None, -1.0, 200.0] + [e + d for e in edges for d in (-1e-4, 0.0, 1e-4)] * 2
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    want = rows(J.interval_join(df, "v", bins, "lo", "hi").select("v", "bin"))
    for ranges in (1, 3, 40):
        assert rows(J.interval_join(df, "v", bins, "lo", "hi", ranges=ranges).select("v", "bin")) == want
    assert len(want) == len(vals)
    known = [tuple(b) for b in bins.collect()]
    assert want == sorted([(v, next((i for i, a, b in known if v is not None and a < v <= b), None)) for v in vals], key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_overlapping_bins_equal_brute_force(spark, n):
    r = random.Random(n)
    bins = [(i, float(a := r.randint(0, 40)), float(a + r.choice([-1, 0, 1, 2, 30]))) for i in range(n)] + [(900, None, 1.0), (901, 1.0, None), (902, -100.0, 100.0)]
    vals = [None, -200.0, *[k / 2 for k in range(-2, 150)], 7.0, 7.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vals)], "id int, v double")
    got = rows(J.overlap_join(df, "v", spark.createDataFrame(bins, "bin int, lo double, hi double"), "lo", "hi").select("id", "bin"))
    want = []
    for k, v in enumerate(vals):
        inside = [i for i, a, b in bins if None not in (v, a, b) and a < v <= b]
        want += [(k, i) for i in inside or [None]]
    assert got == sorted(want, key=str)


def test_cells_and_pairs_are_not_broadcast(spark, monkeypatch):
    stored, store = [], J.staged
    monkeypatch.setattr(J, "staged", lambda df: stored.append(df) or store(df))
    bins = spark.range(60).select(F.col("id").alias("bin"), (F.col("id") / 9).alias("lo"), (F.col("id") + 70.0).alias("hi"))
    df = spark.range(100).select((F.col("id") + 0.5).alias("v"))
    out = J.overlap_join(df, "v", bins, "lo", "hi")
    cells, pairs = (x._jdf.queryExecution().executedPlan().toString() for x in (stored[-1], out))
    assert "SortMergeJoin [level#" in cells and "SortMergeJoin [__i#" in pairs


@pytest.mark.parametrize("n", [3, 1500])
def test_bins_with_a_missing_edge_hold_nothing(spark, n):
    bins = [(i, float(i), i + 1.0) for i in range(n)] + [(9001, None, 0.0), (9002, 5000.0, None), (9003, None, None)]
    df = spark.createDataFrame([(0.5,), (1.5,), (n - 0.5,), (-3.0,), (6000.0,), (None,)], "v double")
    out = J.interval_join(df, "v", spark.createDataFrame(bins, "bin int, lo double, hi double"), "lo", "hi")
    assert {r["v"]: r["bin"] for r in out.collect()} == {0.5: 0, 1.5: 1, n - 0.5: n - 1, -3.0: None, 6000.0: None, None: None}


def test_large_bin_table_is_not_broadcast(spark):
    bins = spark.range(5000).select(F.col("id").alias("bin"), F.col("id").cast("double").alias("lo"), (F.col("id") + 1.0).alias("hi"))
    df = spark.range(1, 4000, 7).select((F.col("id") + 0.5).alias("v"))
    out = J.interval_join(df, "v", bins, "lo", "hi")
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("bin = floor(v)").count() == df.count() == out.count()


def test_lookup_never_fans_out(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 0)], "k int, v string, o int")
    assert rows(J.lookup_one(base, dim, ["k"], ["o"]).select("k", "v")) == [(1, "a"), (2, None), (None, None)]


def test_hot_row_numbers_are_not_shuffled(spark):
    numbered = spark.range(1, 20_001).select(F.col("id").alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("name"))
    df = spark.range(3000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4 * 10_000).alias("k"), "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        out = J.row_by_number(df, numbered, "k")
        got = out.groupBy("k", "name").count().collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {(r["k"], r["name"], r["count"]) for r in got} == {(None, None, 750), (10_000, "10000" * 20, 750), (20_000, "20000" * 20, 750), (30_000, None, 750)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_missing_keys_match_on_request(spark):
    a = spark.createDataFrame([(None, 1), (5, 2)], "k int, x int")
    b = spark.createDataFrame([(None, "m")], "k int, y string")
    assert rows(J.lookup(a, b, ["k"], match_missing=True).select("x", "y")) == [(1, "m"), (2, None)]
    assert rows(J.lookup(a, b, ["k"]).select("x", "y")) == [(1, None), (2, None)]


def test_resolution_routes(spark):
    base = spark.createDataFrame([("1", "a"), ("9", "b"), (None, "c")], "id string, name string")
    by_id = spark.createDataFrame([("1", "T2"), ("1", "T1")], "id string, t string")
    by_name = spark.createDataFrame([("b", "T3")], "name string, t string")
    out = J.resolve_ids(base, by_id, by_name, "id", "name", "t", "NO_ID_").select("name", "t", "route")
    assert rows(out) == [("a", "T1", "use_id"), ("b", "T3", "use_name"), ("c", "NO_ID_c", "unresolved")]


def test_upsert_appends_and_guards(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, known double")
    src = spark.createDataFrame([("b", 4.0, "r2"), ("b", 2.0, "r1"), ("c", 6.0, "r1"), ("a", 8.0, "r9")], "k string, v double, ref string")
    out = J.upsert_means(base, src, "k", {"v": "mean"}, {"ref": "refs"}, {"mean": ["known"]})
    assert rows(out.select("k", "known", "mean", "refs")) == [("a", 1.0, None, "r9"), ("b", None, 3.0, "r1, r2"), ("c", None, 6.0, "r1")]


def test_priority_union(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 9.0, "x"), (2, 2.0, "y")], "k int, v double, w string")
    assert rows(sets.priority_union(a, b, "k", "s", ("a", "b")).select("k", "v", "w", "s")) == [(1, 1.0, None, "a"), (2, 2.0, "y", "b")]


def test_repeated_values_survive_concatenation(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None)], "k int, v string")
    assert rows(G.concat_values(df, ["k"], "v", "t")) == [(1, "a, b, b")]
    assert rows(G.concat_values(df, ["k"], "v", "t", distinct=True)) == [(1, "a, b")]


def test_poisoned_nearest_first(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 2.0), (2, None), (3, 3.0), (3, 5.0)], "g int, v double")
    assert rows(G.drop_poisoned_groups(df, ["g"], F.col("v") > 4)) == [(2, 2.0), (2, None)]
    assert rows(G.keep_nearest(df, ["g"], "v", 4.0)) == [(1, 5.0), (2, 2.0), (3, 3.0), (3, 5.0)]
    assert rows(G.keep_first(df.where("v is not null"), ["g"], ["v"])) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_sparsest_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, None, None)], "id int, a double, b double")
    assert sorted(r["id"] for r in G.drop_sparsest_rows(df, ["a", "b"]).collect()) == [1, 2]
    even = df.where("id < 3")
    assert sorted(r["id"] for r in G.drop_sparsest_rows(even, ["a", "b"]).collect()) == [1, 2]
    assert G.complete_columns(even, ["a", "b"]) == ["b"]


@pytest.mark.parametrize("wide", [60])
def test_wide_tables_plan_quickly(spark, wide):
    """A filter on many derived columns must not reach the optimizer."""
    df = spark.range(20).select("id", *[F.when(F.col("id") % (i + 2) != 0, F.col("id") * 1.5).alias(f"c{i}") for i in range(wide)])
    cols = [f"c{i}" for i in range(wide)]
    assert G.drop_sparsest_rows(df, cols).count() == 19


def test_histogram_counts_sum(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") * 0.37).alias("v"), (F.col("id") % 3).alias("g"))
    h = G.histogram(df, "v", ["g"])
    assert h.agg(F.sum("n"), F.min("bin"), F.max("bin")).first() == (900, 1, 30)
    assert G.histogram(df, "v", limits=(0.0, 100.0)).agg(F.sum("n")).first()[0] == df.where("v between 0 and 100").count()


def test_unit_text(spark):
    cases = {
        "cm/s": 1e6, "10'-6cm/s": 1.0, "10^-7 cm/s": 0.1, "nm/s": 0.1, "10^-5 cm/min": 10 / 60, "10 e-6 cm s-1": 1.0,
        "cm/s*10E6": 1.0, "10'6cm/s": 1.0, "furlong": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("f", H.unit_factor(H.unit_text("u")))
    for r in df.collect():
        want = cases[r["u"]]
        assert r["f"] is None if want is None else r["f"] == pytest.approx(want)


def test_harmonised_units(spark):
    df = spark.createDataFrame([(u, 6.0) for u in (*H.UNIT_FACTORS, "nope")], "u string, v double")
    out = {r["u"]: r["v"] for r in H.harmonise_units(df, "u", "v").collect()}
    assert len(out) == 24 and out["10'-4 cm/s"] == 600 and out["10^-5 cm/min"] == pytest.approx(1.0) and out["nm/s"] == pytest.approx(0.6)


def test_provenance(spark):
    df = spark.createDataFrame([(1.0, 1, 5.0), (1.0, 0, 5.0), (None, None, 5.0), (1.0, 0, None), (None, None, None)], "p double, ad int, m double")
    got = [tuple(r["x"]) for r in df.select(C.pick_with_source("p", "ad", "m").alias("x")).collect()]
    assert got == [(1.0, "model"), (5.0, "measured"), (5.0, "measured"), (1.0, "model"), (None, "none")]


def test_eligibility(spark):
    df = spark.createDataFrame([(1, "2.5", "0.1"), (2, "<3", "0.1"), (3, "ND", "0.1"), (4, "2", "NF"), (5, "x", "1"), (6, None, "1")], "id int, c string, f string")
    assert [r["id"] for r in R.eligible(df, ["id"], ["c", "f"]).collect()] == [1]


def test_margin_overlap(spark):
    doses = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 1.0)], "id int, q95 double")
    expo = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.0)], "id int, u double")
    got = {r["id"]: (r["ber"], r["cross_min"], r["cross_max"]) for r in R.margins(doses, expo, "id", "u").collect()}
    assert got == {1: (2.0, None, None), 2: (0.5, 0.5, 1.0), 3: (None, None, None)}
