"""Unions, id-list algebra and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stack(tables: list[DataFrame], fill: bool = False) -> DataFrame:
    """Append by column name, optionally filling columns that a table lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), tables)


def tagged(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.withColumn(col, F.lit(value))


def id_union(lists: list[DataFrame], col: str) -> DataFrame:
    ids = [d.select(F.col(d.columns[0]).cast("string").alias(col)) for d in lists]
    return stack(ids).where(F.col(col).isNotNull()).distinct()


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def priority_union(first: DataFrame, second: DataFrame, key: str, tag: str, names: tuple[str, str]) -> DataFrame:
    """All of `first`, plus the rows of `second` whose key `first` lacks."""
    extra = second.join(first.select(key), key, "left_anti")
    return tagged(first, tag, names[0]).unionByName(tagged(extra, tag, names[1]), allowMissingColumns=True)


def pivot_mean_sd(df: DataFrame, key: str, prop: str, value: str, props: list[str]) -> DataFrame:
    """One row per key with mean and sd per property, one grouped pass."""
    aggs = []
    for p in props:
        v = F.when(F.col(prop) == p, F.col(value))
        aggs += [F.avg(v).alias(f"{p}_meas"), F.stddev_samp(v).alias(f"{p}_meas_sd")]
    return df.groupBy(key).agg(*aggs)


def long_to_methods(df: DataFrame, keys: list[str], method: str, value: str, methods: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(method, methods).agg(F.max(value))


def melt(df: DataFrame, ids: list[str], cols: list[str], name: str = "label", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def spread_array(df: DataFrame, array_col: str, names: list[str], each=None) -> DataFrame:
    """Array column to named columns, with an optional transform of each element."""
    a = F.col(array_col)
    picks: dict[str, Column] = {}
    for i, n in enumerate(names):
        item = F.get(a, F.lit(i))
        picks[n] = each(item) if each else item
    return df.withColumns(picks).drop(array_col)
