"""Readers, writers and name rules on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from permspark.sources import names, readers, writers


def test_name_rules():
    assert names.normal_name("% Assay Active") == "percent_Assay_Active"
    assert names.normal_name("RATE_(AOH)_CM3/MOLECULE*SEC") == "RATE_AOH_CM3perMOLECULExSEC"
    assert names.normal_name("﻿A-b.c:d=e?", lower=True) == "abccolndeqeq"
    assert names.positional_names(["id", "F%", "ref", "F%"]) == ["id", "F%...2", "ref", "F%...4"]


def test_captioned_csv(spark, tmp_path):
    p = tmp_path / "caption.csv"
    p.write_text('"A caption, with\na line break",,\nSubstance,Organ,Peff (x10-4 cm/s)\nantipyrine,Colon,1.2\nantipyrine,Colon,1.2\natenolol,,NA\n')
    df = readers.read_captioned(spark, str(p), ["Substance", "Organ", "Peff (x10-4 cm/s)"])
    assert df.count() == 3 and df.distinct().count() == 2
    df = readers.read_positional(spark, str(p), ["s", "o", "p"], F.col("p").try_cast("double").isNotNull())
    assert [tuple(r) for r in df.collect()] == [("antipyrine", "Colon", "1.2")] * 2


def test_captioned_csv_keeps_rows_with_one_field(spark, tmp_path):
    p = tmp_path / "caption.csv"
    p.write_text("Caption,,\nSubstance,Organ,Peff\natenolol,,\nantipyrine,Colon,1.2\n")
    df = readers.read_captioned(spark, str(p), ["Substance", "Organ", "Peff"], caption="Caption")
    assert sorted(r[0] for r in df.collect()) == ["antipyrine", "atenolol"]


def test_header_check(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("b,a\n1,2\n")
    assert readers.read_delimited(spark, str(p), "b string, a string", check_header=True).count() == 1
    with pytest.raises(Exception):
        readers.read_delimited(spark, str(p), "a string, b string", check_header=True).collect()


def test_bom_and_quoted_header(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_bytes("﻿KEY,\"PREFERRED NAME\",% Active\nhttps://x/1,\"a, b\",2.5\n".encode())
    df = readers.read_delimited(spark, str(p), "id string, name string, active double")
    assert [tuple(r) for r in df.collect()] == [("https://x/1", "a, b", 2.5)]


def test_whitespace_pairs_and_ids(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("KEY  status   n\nD1   ok 3\n\n D2\tbad   4\n")
    assert [tuple(r) for r in readers.read_whitespace(spark, str(p), ["KEY", "status", "n"]).collect()] == [("D1", "ok", "3"), ("D2", "bad", "4")]
    p = tmp_path / "s.smi"
    p.write_text("CC(=O)O\tD1\nc1ccccc1\tD2\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(p)).collect()] == [("CC(=O)O", "D1"), ("c1ccccc1", "D2")]
    assert readers.read_ids(spark, str(p), "line").count() == 2


def test_sheets_keep_their_tag(spark, tmp_path):
    for n, rows in (("one", "1,a\n"), ("two", "2,b\n3,c\n")):
        (tmp_path / f"{n}.csv").write_text("k,v\n" + rows)
    df = readers.read_sheets(spark, {n: str(tmp_path / f"{n}.csv") for n in ("one", "two")}, "k int, v string")
    assert {(r["k"], r["sheet"]) for r in df.collect()} == {(1, "one"), (2, "two"), (3, "two")}


def test_csv_sink_writes_missing_as_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'x "y", z'), (2, "b", "w")], "k int, a string, b string")
    path = str(tmp_path / "out")
    writers.write_csv(df.coalesce(1), path, ["k", "a", "b"])
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "k,a,b" and text[1].startswith("1,,")
    back = readers.read_delimited(spark, path, "k int, a string, b string")
    assert {tuple(r) for r in back.collect()} == {(1, None, 'x "y", z'), (2, "b", "w")}


def test_sections_prune(spark, tmp_path):
    df = spark.createDataFrame([("auc", 1.0), ("cmax", 2.0)], "measure string, v double")
    writers.write_sections(df, str(tmp_path / "s"), "measure")
    one = writers.load_stage(spark, str(tmp_path), "s").where("measure = 'auc'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(measure" in one._jdf.queryExecution().executedPlan().toString()


def test_stage_lives_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    df = writers.staged(spark.range(5).toDF("id"))
    assert df.count() == 5 and all(root.replace("file:", "") in f for f in df.inputFiles())


def test_overlay(spark):
    base = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    over = spark.createDataFrame([(1, 9.0), (2, 8.0)], "k int, v double")
    assert {tuple(r) for r in readers.overlay(base, over, "k", ["v"]).collect()} == {(1, 1.0), (2, 8.0)}
    assert {tuple(r) for r in readers.overlay(base, over, "k", ["v"], overwrite=True).collect()} == {(1, 9.0), (2, 8.0)}


def test_stages_are_dropped_together(spark, tmp_path, monkeypatch):
    assert spark.sparkContext.applicationId in writers.scratch_dir(spark)
    monkeypatch.setattr(writers, "_stage_root", lambda session: f"{tmp_path}/permspark/app")
    one, two = writers.staged(spark.range(5)), writers.staged(spark.range(7))
    assert one.count() + two.count() == 12 and len(list(tmp_path.glob("permspark/*/*"))) == 2
    writers.drop_stages(spark)
    assert not list(tmp_path.glob("permspark/*")) and writers.staged(spark.range(3)).count() == 3
