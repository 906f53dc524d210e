"""Truth table of the channel rules, adjustment and publishing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from permspark.plans import qc

LOW, HIGH = 0.4, 2.0


def wide(spark, rows):
    """rows: list of (value, recovery, comment, original) put into channel ab1; other channels empty."""
    schema = ["id int"]
    for ch in qc.CHANNELS:
        schema += [f"value_{ch} double", f"rec_{ch} double", f"comment_{ch} string", f"orig_{ch} string"]
    data = []
    for i, r in enumerate(rows):
        data.append((i, *r, *([None, None, None, None] * (len(qc.CHANNELS) - 1))))
    return spark.createDataFrame(data, ", ".join(schema))


CASES = [
    # value, recovery, comment, original -> value, comment
    ((5.0, 1.0, None, "x"), (5.0, None)),
    ((5.0, 1.0, "", "x"), (5.0, None)),
    ((5.0, 1.0, "", "ND"), (None, "ND")),
    ((5.0, 1.0, "LOD", "ND"), (5.0, "LOD")),
    ((5.0, 1.0, "low_rec", "x"), (5.0, "low_rec")),
    ((5.0, 1.0, "check", "x"), (None, "check")),
    ((0.0, 1.0, "LOD", "x"), (None, "ND")),
    ((-1.0, 1.0, None, "x"), (None, "ND")),
    ((-1.0, 0.1, None, "x"), (None, "ND")),
    ((5.0, None, None, "x"), (None, None)),
    ((5.0, 0.39, None, "x"), (None, "low_rec")),
    ((5.0, 0.4, None, "x"), (5.0, None)),
    ((5.0, 2.0, None, "x"), (5.0, None)),
    ((5.0, 2.01, None, "x"), (None, "high_rec")),
    ((5.0, 2.01, "LOD", "x"), (None, "LOD")),
    ((None, 0.1, None, "x"), (None, "low_rec")),
    ((None, 1.0, None, "ND"), (None, "ND")),
]


def test_channel_rules(spark):
    out = qc.check_channels(wide(spark, [c[0] for c in CASES]), LOW, HIGH).orderBy("id").collect()
    got = [(r["v_ab1"], r["c_ab1"]) for r in out]
    assert got == [c[1] for c in CASES]


def test_no_cut_offs_keep_everything_with_a_recovery(spark):
    out = qc.check_channels(wide(spark, [(5.0, 9.9, None, "x"), (5.0, None, None, "x")]), None, None).orderBy("id").collect()
    assert [(r["v_ab1"], r["c_ab1"]) for r in out] == [(5.0, None), (None, None)]


def triplicate(spark, values, recs):
    df = wide(spark, [(values[0], recs[0], None, "x")])
    for i in (1, 2):
        df = df.withColumns({f"value_ab{i + 1}": F.lit(values[i]).cast("double"), f"rec_ab{i + 1}": F.lit(recs[i]).cast("double")})
    return df


def test_masked_mean_and_sd(spark):
    df = triplicate(spark, [10.0, 20.0, 60.0], [1.0, 0.5, 3.0])
    r = qc.process(df, LOW, HIGH, None).first()
    assert r["rec_ab"] == 0.75 and r["ab"] == 15.0
    assert r["sd_ab"] == pytest.approx(50**0.5) and r["ba"] is None and r["efflux"] is None


def test_adjustment_only_above_threshold(spark):
    df = triplicate(spark, [10.0, 10.0, 10.0], [0.5, 0.5, 0.5])
    assert qc.process(df, LOW, HIGH, 9.0).first()["ab"] == 20.0
    assert qc.process(df, LOW, HIGH, 10.0).first()["ab"] == 10.0
    r = qc.process(df, LOW, HIGH, 9.0).first()
    assert r["ab0"] == 10.0


def test_publish_flags_filtered_rows(spark):
    df = triplicate(spark, [10.0, 10.0, 10.0], [0.1, 0.1, 0.1]).unionByName(triplicate(spark, [10.0] * 3, [1.0] * 3))
    rows = qc.publish(df, ["id"], LOW, HIGH, 5.0).collect()
    assert sorted(r["filtered"] for r in rows) == ["", "Y"]
    bad = [r for r in rows if r["filtered"] == "Y"][0]
    assert bad["ab"] is None and bad["ab_unfilt"] == 10.0 and bad["rec_ab_unfilt"] == pytest.approx(0.1)


def test_entity_statistics(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 1.0, 10.0, 1.0, 0.1, 0.1, 1.0, 1.0), (1, 1000.0, 1.0, 10.0, None, 0.3, 0.1, None, 1.0)],
        "e int, ab double, ba double, ab0 double, ba0 double, efflux double, efflux0 double, rec_ab double, rec_ba double",
    )
    r = qc.entity_statistics(df, ["e"]).first()
    assert r["gm_ab"] == pytest.approx(100.0) and r["lsd_ab"] == pytest.approx(2**0.5)
    assert r["cv_ab"] == pytest.approx(2**0.5 / 100) and r["n_rec_ab"] == 1 and r["n_rows"] == 2
    assert r["mean_efflux"] == pytest.approx(0.2) and r["sd_rec_ab"] is None


def test_plan_has_one_shuffle(spark):
    """QC, adjustment and statistics cost a single exchange."""
    from permspark.catalog import QUERIES, load_all

    load_all()
    plan = QUERIES["entity_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "l_shipdate" not in plan.split("ReadSchema")[1]
