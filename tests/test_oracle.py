"""Every registered query against its SQL twin, or for shape where SQL has none."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from permspark import catalog
from tools.check import check, connect

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    text, _ = check(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert text.startswith(("ok", "rows-only")) and "TYPES" not in text, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "gm_ab" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names():
    for name in catalog.QUERIES:
        assert "pipeline" not in name and not re.match(r"op\d", name)


def test_library_stays_distributed():
    """No RDDs, local checkpoints, cross joins or row-at-a-time UDFs in the library."""
    for path in (ROOT / "permspark").rglob("*.py"):
        text = path.read_text()
        for banned in (".rdd", "localCheckpoint", "crossJoin", "F.udf", "monotonically_increasing_id", "mapPartitions"):
            assert banned not in text, (path, banned)
