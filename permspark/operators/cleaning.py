"""Row-level corrections, provenance picks and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import as_col, half_even, number_or_null
from permspark.operators.ordered import join_keys, spread


def update_where(df: DataFrame, rules: list[tuple[str, Column, object]]) -> DataFrame:
    """Predicate-guarded assignments applied in order: (column, condition, new value)."""
    for name, cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.when(cond, value).otherwise(F.col(name)))
    return df


def apply_overrides(df: DataFrame, cols, prefix: str = "update_") -> DataFrame:
    """Take the override where one exists; drops the override columns."""
    return df.withColumns({c: F.coalesce(f"{prefix}{c}", c) for c in cols}).drop(*[f"{prefix}{c}" for c in cols])


def point_corrections(df: DataFrame, key: str, fixes: dict[str, dict[str, object]]) -> DataFrame:
    """Literal corrections {column: {key value: corrected value}}."""
    out = {}
    for col, table in fixes.items():
        expr = None
        for k, v in table.items():
            expr = F.when(F.col(key) == k, F.lit(v)) if expr is None else expr.when(F.col(key) == k, F.lit(v))
        out[col] = F.coalesce(expr, F.col(col))
    return df.withColumns(out)


def expand_struct(df: DataFrame, struct_col: Column) -> DataFrame:
    """Several columns out of one struct-valued expression."""
    return df.select("*", struct_col.alias("__s")).select("*", "__s.*").drop("__s")


def cast_numbers(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: number_or_null(c) for c in cols})


def pick_with_source(predicted, in_domain, measured) -> Column:
    """struct(value, source): the measurement where the model has no trustworthy prediction."""
    predicted, measured = as_col(predicted), as_col(measured)
    distrust = predicted.isNull() | (as_col(in_domain) == 0)
    use_measured = distrust & measured.isNotNull()
    return F.struct(
        F.when(use_measured, measured).otherwise(predicted).alias("value"),
        F.when(use_measured, F.lit("measured"))
        .when(predicted.isNull(), F.lit("none"))
        .otherwise(F.lit("model"))
        .alias("source"),
    )


def measured_else_model(measured, predicted) -> Column:
    measured = as_col(measured)
    return F.struct(
        F.coalesce(measured, as_col(predicted)).alias("value"),
        F.when(measured.isNull(), F.lit("model")).otherwise(F.lit("measured")).alias("source"),
    )


def filtered_flag(raw, checked) -> Column:
    """'Y' where a raw value exists but did not survive checking."""
    return F.when(as_col(raw).isNotNull() & as_col(checked).isNull(), F.lit("Y")).otherwise(F.lit(""))


def first_id(*cols) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def label_members(df: DataFrame, key: str, members: DataFrame, yes: str, no: str, out: str = "class") -> DataFrame:
    """Label by membership of the key in an id list (first column of `members`)."""
    ids = members.select(F.col(members.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    hit = join_keys(df, spread(ids.withColumn("__hit", F.lit(True)), [key]), [key], "left")
    return hit.withColumn(out, F.when(F.col("__hit"), F.lit(yes)).otherwise(F.lit(no))).drop("__hit")


def ordered_category(c, levels: list[str]) -> Column:
    """Ordinal (1-based) of a category, for sorting; unknown levels are NULL."""
    out = None
    for i, level in enumerate(levels, 1):
        out = F.when(as_col(c) == level, F.lit(i)) if out is None else out.when(as_col(c) == level, F.lit(i))
    return out


def threshold_class(c, breaks: list[float], low: float, high: float) -> Column:
    """low / high, or low / med / high, over [low limit, high limit]."""
    c = as_col(c)
    edges = [float(b) for b in breaks]
    names = ["low", "high"] if len(edges) == 1 else ["low", "med", "high"]
    out = F.when((c < edges[0]) & (c >= low), F.lit(names[0]))
    if len(edges) == 2:
        out = out.when((c >= edges[0]) & (c < edges[1]), F.lit(names[1]))
    return out.when((c >= edges[-1]) & (c <= high), F.lit(names[-1]))


def consensus_bin(c) -> Column:
    """Aggregate: half-even rounded mean of bin numbers."""
    return half_even(F.avg(as_col(c))).cast("int")


def clean_ids(df: DataFrame, col: str, prefix: str, junk: str, pattern: str) -> DataFrame:
    """Strip a literal URL prefix and a junk suffix, keep well-formed ids, once each, sorted."""
    text = F.replace(F.replace(F.col(col), F.lit(prefix), F.lit("")), F.lit(junk), F.lit(""))
    kept = df.where(F.col(col).rlike(pattern)).select(F.trim(text).alias(col))
    return kept.distinct().orderBy(col)
