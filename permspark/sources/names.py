"""Column-name normalisation; touches metadata only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

# Literal replacements, applied in this order.
REPLACEMENTS = (
    ("(", ""),
    (")", ""),
    ("/", "per"),
    ("*", "x"),
    (" ", "_"),
    ("%", "percent"),
    ("?", "q"),
    ("-", ""),
    (".", ""),
    (":", "coln"),
    ("=", "eq"),
)


def normal_name(name: str, lower: bool = False) -> str:
    name = name.removeprefix("﻿")
    for old, new in REPLACEMENTS:
        name = name.replace(old, new)
    return name.lower() if lower else name


def normalise_names(df: DataFrame, lower: bool = False) -> DataFrame:
    return df.toDF(*[normal_name(c, lower) for c in df.columns])


def positional_names(headers: list[str]) -> list[str]:
    """Names that occur more than once get their 1-based position appended ('F...3')."""
    seen = Counter(headers)
    return [h if seen[h] == 1 else f"{h}...{i}" for i, h in enumerate(headers, 1)]


def with_affix(df: DataFrame, cols, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in cols})


def drop_matching(df: DataFrame, *fragments: str) -> DataFrame:
    """Drop every column whose name contains one of the fragments."""
    return df.drop(*[c for c in df.columns if any(f in c for f in fragments)])
