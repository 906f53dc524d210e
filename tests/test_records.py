"""Quoted CSV in splits of any size against the one-task reader; inferred types."""

from __future__ import annotations

import random

import pytest

from permspark.sources import readers, records

SCHEMA = "id string, text string, n string"


def quoted(field):
    return '"' + field.replace('"', '""') + '"'


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("csv"), random.Random(3)
    words = ["plain", "two words", "a, b", 'said "so"', "line\nend", "\n\n", "é\n\"x\"\n", "", " lead"]
    for k in range(3):
        rows = [f'{k}-{i},{quoted("".join(r.choice(words) for _ in range(r.randint(0, 6))))},{i}' for i in range(25)]
        rows[7] = f'{k}-7,"{"long " * 40}' + "\n" * 30 + '",7'
        (root / f"part{k}.csv").write_text("﻿" * (k == 0) + "\n".join(rows) + "\n" * (k != 1))
    return str(root)


@pytest.mark.parametrize("size", ["150b", "2k", "128m"])
def test_splits_equal_one_task(spark, files, size):
    want = sorted(map(tuple, readers.read_delimited(spark, files, SCHEMA, header=False, multiline=True).fillna("").collect()))
    want = [(a.removeprefix("﻿"), *rest) for a, *rest in want]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        if size == "150b":
            assert spark.read.text(files).rdd.getNumPartitions() > 9
        df = records.read_quoted(spark, files, SCHEMA)
        got = sorted(map(tuple, df.fillna("").collect()))
        assert sorted(got) == sorted(want) and len(got) == 75
        assert records.read_quoted(spark, files, SCHEMA, skip=2).where("n in ('0', '1')").count() == 0
        assert records.read_quoted(spark, files, SCHEMA, skip=2).count() == 69
        places = records.read_records(spark, files).where("record <> ''").orderBy("file", "block", "line").collect()
        assert [p.record.split(",")[0].split("-")[1] for p in places] == [str(i) for _ in range(3) for i in range(25)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_numbered_columns(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('"A banner\nof two lines",,\nid,F%,F%\n1,2,"3\n4"\n')
    df = readers.read_numbered(spark, str(p), ["id", "F%", "F%"], skip=2)
    assert df.columns == ["id", "F%...2", "F%...3"] and [tuple(r) for r in df.collect()] == [("1", "2", "3\n4")]


def test_types_come_from_all_rows(spark, tmp_path):
    p = tmp_path / "t.csv"
    rows = [f"{i},{i / 4},TRUE,2020-01-{1 + i % 28:02},x{i},,NA,{i}" for i in range(300)]
    rows[299] = "+7,1e-3,F,2020-12-31,9,, ,1.5"
    p.write_text("whole,real,truth,day,text,empty,missing,late\n" + "\n".join(rows) + "\n")
    df = records.read_inferred(spark, str(p))
    assert dict(df.dtypes) == {"whole": "bigint", "real": "double", "truth": "boolean", "day": "date", "text": "string", "empty": "boolean", "missing": "boolean", "late": "double"}
    assert df.where("whole = 7 AND NOT truth AND real = 0.001 AND late = 1.5").count() == 1 and df.where("missing IS NULL").count() == 300
    p.write_text("day,whole\n2021-02-30,1234567890123456789012\n2021-02-28,1\n")
    assert dict(records.read_inferred(spark, str(p)).dtypes) == {"day": "string", "whole": "double"}
    p.write_text("a,b\n")
    assert dict(records.read_inferred(spark, str(p)).dtypes) == {"a": "boolean", "b": "boolean"}
