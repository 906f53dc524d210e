"""Delimited sources with given schemas; `records` reads quoted line ends and infers types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from permspark.sources.names import positional_names
from permspark.sources.records import read_quoted


def read_delimited(
    spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True, multiline: bool = False, check_header: bool = False
) -> DataFrame:
    """Columns are named by position; check_header makes reading fail if a header has other names. One task reads a multiline file; `read_quoted` has many."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", not check_header)
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )


def read_pairs(spark: SparkSession, path, names=("structure", "id")) -> DataFrame:
    """Headerless two-column tab-separated file."""
    return read_delimited(spark, path, ", ".join(f"`{n}` string" for n in names), sep="\t", header=False)


def read_ids(spark: SparkSession, path, name: str = "id") -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias(name))


def read_whitespace(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Columns separated by runs of blanks; the header line is recognised by its own text."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    table = rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return table.where(~(F.col(names[0]).eqNullSafe(names[0]) & F.col(names[-1]).eqNullSafe(names[-1])))


def read_positional(spark: SparkSession, path, names: list[str], is_data: Column) -> DataFrame:
    """Files with a caption, a banner or a late header: name columns by position, keep the records for which `is_data` holds."""
    return read_quoted(spark, path, ", ".join(f"`{n}` string" for n in names)).where(is_data)


def read_numbered(spark: SparkSession, path, headers: list[str], skip: int = 1, sep: str = ",") -> DataFrame:
    """Files whose header names repeat: text columns by position, repeated names with their number, `skip` leading records left out."""
    return read_quoted(spark, path, ", ".join(f"`{n}` string" for n in positional_names(headers)), skip=skip, sep=sep)


def read_captioned(spark: SparkSession, path, names: list[str], caption: str | None = None) -> DataFrame:
    """First record a caption, second record the header; all other records are data. Large files are read by many tasks.

    With the caption's text, only that caption and records equal to the names are left out, wherever a file begins.
    """
    schema = ", ".join(f"`{n}` string" for n in names)
    if caption is None:
        return read_quoted(spark, path, schema, skip=2)
    named = F.lit(True)
    for n in names:
        named = named & F.col(f"`{n}`").eqNullSafe(n)
    return read_quoted(spark, path, schema).where(~named & ~F.col(f"`{names[0]}`").eqNullSafe(caption))


def read_sheets(spark: SparkSession, paths: dict[str, str], schema: str, tag: str = "sheet") -> DataFrame:
    """Append equally shaped inputs, remembering which one each row came from."""
    parts = [read_delimited(spark, p, schema).withColumn(tag, F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def overlay(base: DataFrame, over: DataFrame, key: str, cols: list[str], overwrite: bool = False) -> DataFrame:
    """Fill the named columns of base from a keyed overlay, or let the overlay win.

    Store an aggregated overlay (`staged`) if base has hot keys, so that these are split.
    """
    o = over.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    joined = base.join(o, key, "left")
    pick = {
        c: (F.coalesce(f"__{c}", c) if overwrite else F.coalesce(c, f"__{c}")) if c in base.columns else F.col(f"__{c}")
        for c in cols
    }
    return joined.withColumns(pick).drop(*[f"__{c}" for c in cols])
