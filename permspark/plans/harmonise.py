"""Bring measurements from many sources to one endpoint, one unit and one identifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import as_col, number_or_null, ratio, signif
from permspark.operators.grouping import drop_poisoned_groups, keep_large_groups
from permspark.operators.joins import map_values
from permspark.operators.sets import stack
from permspark.sources.writers import staged

# Endpoint names that mean apparent permeability, and whether they are logarithms.
ENDPOINTS = {
    "logPapp": ("Papp", True),
    "LogP app": ("Papp", True),
    "Papp": ("Papp", False),
    "Permeability": ("Papp", False),
    "permeability": ("Papp", False),
    "Caco-2 Papp": ("Papp", False),
    "Papps": ("Papp", False),
    "Pc": ("Papp", False),
    "Permeability coefficient": ("Papp", False),
    "Permeability rate": ("Papp", False),
    "Caco-2 A-B": ("Papp", False),
}

# Unit spellings and the factor that brings them to 1e-6 cm/s.
UNIT_FACTORS = {
    "10^-6 cm/s": (1.0,),
    "ucm/s": (1.0,),
    "10e-6 cm s-1": (1.0,),
    "10'-6 cm/s": (1.0,),
    "10'-6cm/s": (1.0,),
    "10'6cm/s": (1.0,),
    "10-6 cm s-1": (1.0,),
    "10'-6/s": (1.0,),
    "10^-6/cm": (1.0,),
    "cm'-6/s": (1.0,),
    "10'-8m/s": (1.0,),
    "10'-4 cm/s": (100.0,),
    "10^-5 cm/s": (10.0,),
    "10'-5 cm/s": (10.0,),
    "10^-7 cm/s": (0.1,),
    "10'-7 cm/s": (0.1,),
    "nm/s": (0.1,),
    "10'-8cm/s": (0.01,),
    "10^-8cm/s": (0.01,),
    "10'-9cm/s": (0.001,),
    "10^-5 cm/min": (10.0 / 60,),
    "10e4*cm min-1": (100.0 / 60,),
    "10'-4 cm/min": (100.0 / 60,),
    "10'-6cm/min": (1.0 / 60,),
}

# Text rules of the free-form unit notation, applied in this order.
UNIT_TEXT_RULES = (("'", "^"), ("s-1", "/s"), (" ", ""), ("u", "10^-6"), ("nm", "10^-7cm"))
UNIT_TEXT_EXACT = {
    "cm/s*10E6": "10^-6cm/s",
    "10^6cm/s": "10^-6cm/s",
    "10^7cm/s": "10^-7cm/s",
    "10e-5*cm/min": "(10^-5)/60cm/s",
    "10^-5cm/min": "(10^-5)/60cm/s",
    "10e-6cm/s": "10^-6cm/s",
}
#: Parts of the names of permeability endpoints.
ENDPOINT_FRAGMENTS = ("app", "perm", "pc", "caco", "pm")


def harmonise_endpoints(df: DataFrame, endpoint: str, value: str) -> DataFrame:
    """One endpoint type; logarithms are undone and unknown endpoints dropped."""
    named = map_values(df, endpoint, ENDPOINTS, ["endpoint_type", "is_log"])
    v = F.col(value).cast("double")
    return named.withColumn(value, F.when(F.col("is_log"), F.pow(F.lit(10.0), v)).otherwise(v)).drop("is_log")


def harmonise_units(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Values in 1e-6 cm/s; rows with an unknown unit are dropped."""
    known = map_values(df, unit, UNIT_FACTORS, ["__factor"])
    return known.withColumn(value, F.col(value) * F.col("__factor")).drop("__factor")


def unit_text(unit) -> Column:
    """Normal spelling of a free-form unit."""
    text = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), UNIT_TEXT_RULES, as_col(unit))
    out = None
    for k, v in UNIT_TEXT_EXACT.items():
        out = F.when(text == k, F.lit(v)) if out is None else out.when(text == k, F.lit(v))
    return out.otherwise(text)


def unit_factor(text) -> Column:
    """Factor to 1e-6 cm/s of a normal spelling such as 'cm/s', '10^-7cm/s' or '(10^-5)/60cm/s'."""
    text = as_col(text)
    power = F.regexp_extract(text, r"^\(?10\^(-?\d+)\)?(/\d+)?cm/s$", 1).try_cast("double")
    divisor = F.coalesce(F.regexp_extract(text, r"/(\d+)cm/s$", 1).try_cast("double"), F.lit(1.0))
    return F.when(text == "cm/s", F.lit(1e6)).otherwise(ratio(F.pow(F.lit(10.0), power + 6), divisor))


def is_permeability(endpoint) -> Column:
    name = F.lower(as_col(endpoint))
    return reduce(lambda a, b: a | b, [name.contains(f) for f in ENDPOINT_FRAGMENTS])


def published_fallback(df: DataFrame, unit: str, value: str, published_unit: str, published_value: str) -> DataFrame:
    """Value and unit as published where the standard unit is blank; a missing unit is not blank."""
    blank = F.coalesce(F.trim(F.col(unit)) == "", F.lit(False))
    return df.withColumns({value: F.when(blank, F.col(published_value)).otherwise(F.col(value)), unit: F.when(blank, F.col(published_unit)).otherwise(F.col(unit))})


def literature_filter(
    df: DataFrame, endpoint: str, unit: str, value: str, relation: str, source: str, more_than: int = 10, max_log10: float = 4.0
) -> DataFrame:
    """Free-form literature rows to values in 1e-6 cm/s.

    Keeps permeability endpoints with a rate unit and an exact relation, from sources with more than
    `more_than` rows; a source with any implausible value is removed altogether.
    """
    usable_unit = ~F.coalesce(F.col(unit).isin("", "-", "%"), F.lit(False)) & ~F.col(unit).contains("%")
    rated = F.col(unit).contains("min") | F.col(unit).contains("s") | F.col(unit).contains("hr")
    kept = df.where(
        is_permeability(endpoint) & usable_unit & rated & F.col(source).isNotNull() & (F.col(unit) != "nM/s")
        & F.coalesce(F.col(relation).isin("", "="), F.lit(False))
    )
    big = df.groupBy(source).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than).select(source)
    kept = kept.join(staged(big), source, "left_semi")  # stored, so a hot source can be split
    valued = kept.withColumn("use_value", F.col(value) * unit_factor(unit_text(unit)))
    valued = valued.withColumn("log10_value", F.when(F.col("use_value") > 0, F.log10("use_value")))
    return drop_poisoned_groups(valued, [source], F.col("log10_value") > max_log10)


def training_values(df: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Values at reporting precision, positive ones only, exact duplicate rows once."""
    rounded = df.withColumn(value, signif(number_or_null(value), digits))
    return rounded.where(F.col(value) > 0).distinct()


def collect_sources(tables: dict[str, DataFrame], columns: list[str], tag: str = "source") -> DataFrame:
    """Sources brought to one schema, missing columns NULL, exact duplicates removed."""
    parts = [
        t.select(*[F.col(c) for c in columns if c in t.columns]).withColumn(tag, F.lit(name)) for name, t in tables.items()
    ]
    return stack(parts, fill=True).distinct()


def large_sources(df: DataFrame, source: str, more_than: int) -> DataFrame:
    return keep_large_groups(df, [source], more_than)
