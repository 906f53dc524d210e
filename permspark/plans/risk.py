"""Dose equivalents, bioactivity : exposure margins, scenario ranks and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import log10, ratio, signif
from permspark.operators.joins import align_scenarios
from permspark.operators.ordered import average_rank, quantiles
from permspark.operators.sets import melt, spread_array

# The reported quantiles and their names.
DOSE_QUANTILES = {"q025": 0.025, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q975": 0.975}

# Text marks of a censored or failed measurement.
CENSORED = ("ND", "NF")


def eligible(df: DataFrame, required: list[str], text_fields: list[str]) -> DataFrame:
    """Rows whose required fields exist and whose text fields are neither censored nor unparsable."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*required, *text_fields]])
    for c in text_fields:
        ok = ok & ~F.col(c).contains("<") & ~F.col(c).isin(*CENSORED)
    parsed = {f"{c}_value": F.col(c).try_cast("double") for c in text_fields}
    kept = df.where(ok).withColumns(parsed)
    return kept.dropna(subset=list(parsed))


def sample_quantiles(samples: DataFrame, keys: list[str], value: str, out: str = "css") -> DataFrame:
    """The seven reported quantiles of a table of samples as one array per entity."""
    q = quantiles(samples, keys, value, DOSE_QUANTILES)
    return q.select(*keys, F.array(*DOSE_QUANTILES).alias(out), "n_total")


def dose_equivalents(css: DataFrame, potency: DataFrame, entity: str, potency_col: str, array_col: str = "css") -> DataFrame:
    """Potency divided by every concentration quantile, as named columns."""
    df = css.join(potency.select(entity, potency_col), entity)
    return spread_array(df, array_col, list(DOSE_QUANTILES), lambda c: ratio(potency_col, c))


def margins(doses: DataFrame, exposure: DataFrame, entity: str, upper: str) -> DataFrame:
    """BER = q95 / upper exposure; where it is below 1, the overlap from q95 to that exposure."""
    out = doses.join(exposure.select(entity, upper), entity, "left").withColumn("ber", ratio("q95", upper))
    cross = F.col("ber") < 1
    return out.withColumns({"cross_min": F.when(cross, F.col("q95")), "cross_max": F.when(cross, F.col(upper))})


def scenario_ranks(df: DataFrame, scenario: str, measured: Column, digits: int = 9) -> DataFrame:
    """Rank of BER within its scenario, and within the scenario's measured entities."""
    base = df.withColumns({"__b": F.round("ber", digits), "__bm": F.when(measured, F.round("ber", digits))})
    one = average_rank(base, [scenario], "__b", "ber_rank")
    return average_rank(one, [scenario], "__bm", "ber_rank_measured").drop("__b", "__bm")


def compare_ranks(df: DataFrame, entity: str, scenario: str, values: dict[str, str]) -> DataFrame:
    """Ranks of both scenarios side by side, entity by entity."""
    return align_scenarios(df, [entity], scenario, values, ["ber_rank", "ber_rank_measured"])


def effective_factors(df: DataFrame, entity: str, scenario: str, values: dict[str, str], analytic: DataFrame, factor: str) -> DataFrame:
    """Ratio of the scenario medians beside the analytic factor."""
    a, b = list(values.values())[:2]
    wide = align_scenarios(df, [entity], scenario, values, ["q50"])
    return wide.withColumn("effective", ratio(f"q50_{a}", f"q50_{b}")).join(analytic.select(entity, factor), entity, "left")


def low_absorption_report(
    df: DataFrame, entity: str, scenario: str, values: dict[str, str], absorption: DataFrame, limit: float = 0.5, digits: int = 3
) -> DataFrame:
    """Poorly absorbed entities with doses and margins of both scenarios, least bioavailable first."""
    low = absorption.where(F.col("f_abs") < limit)
    wide = align_scenarios(df.join(low.select(entity), entity, "left_semi"), [entity], scenario, values, ["q95", "ber"])
    cols = [c for c in wide.columns if c != entity]
    out = low.join(wide, entity).select(entity, "f_abs", "f_gut", "f_hep", "f_bio", *cols)
    rounded = {c: signif(c, digits) for c in out.columns if c != entity}
    return out.orderBy("f_bio", entity).withColumns(rounded)


def histogram_table(df: DataFrame, entity: str, measures: dict[str, str]) -> DataFrame:
    """Several measures as (entity, label, value) rows."""
    renamed = df.select(entity, *[F.col(c).alias(label) for c, label in measures.items()])
    return melt(renamed, [entity], list(measures.values()))


def narrative(absorption: DataFrame, margins_df: DataFrame, entity: str) -> DataFrame:
    """Headline numbers: medians, expected reduction, margin in orders of magnitude, poorly absorbed."""
    a = quantiles(absorption, [], "f_abs", {"m": 0.5}).first()["m"]
    g = quantiles(absorption, [], "f_gut", {"m": 0.5}).first()["m"]
    b = quantiles(margins_df, [], "ber", {"m": 0.5}).first()["m"]
    one = absorption.agg(
        F.count("*").alias("n_entities"),
        F.sum((F.col("f_abs") < 0.5).cast("bigint")).alias("n_poorly_absorbed"),
        F.max(F.lit(a)).alias("a"),
        F.max(F.lit(g)).alias("g"),
        F.max(F.lit(b)).alias("b"),
    )
    med_abs, med_gut = signif("a", 3), signif("g", 3)
    return one.select(
        "n_entities",
        "n_poorly_absorbed",
        med_abs.alias("median_f_abs"),
        med_gut.alias("median_f_gut"),
        signif("b", 2).alias("median_ber"),
        signif(F.lit(1.0) - med_abs * med_gut, 2).alias("reduction"),
        signif(log10("b"), 1).alias("orders_of_magnitude"),
    )
