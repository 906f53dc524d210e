"""Evaluation of predictions against observations, inter-laboratory calibration, route adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import as_col, log10, ratio, signif
from permspark.operators.grouping import attach, keep_diverse_groups
from permspark.operators.ordered import medians, medians_of
from permspark.operators.sets import long_to_methods, melt
from permspark.operators.stats import agreement_subtotals, ols, tls
from permspark.sources.writers import staged


def evaluation_pairs(df: DataFrame, key: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Long table (key..., evaluation, observed, predicted) of named column pairs, in one pass."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("evaluation"),
                F.col(obs).cast("double").alias("observed"),
                F.col(pred).cast("double").alias("predicted"),
            )
            for name, (obs, pred) in pairs.items()
        ]
    )
    return df.select(*key, F.inline(cells)).dropna(subset=["observed", "predicted"])


def stack_observations(df: DataFrame, key: list[str], sources: dict[str, str], predicted: str) -> DataFrame:
    """Observations of several sources in one column, each beside the same prediction."""
    long = melt(df, [*key, predicted], list(sources), "reference", "observed")
    names = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])
    return long.withColumn("reference", F.element_at(names, F.col("reference"))).dropna(subset=["observed", predicted])


def log_metrics(df: DataFrame, observed: str, log_predicted: str, keys=(), digits: int = 4) -> DataFrame:
    """Test-set RMSE and R2 in log10 space, with the published rounding of every squared residual."""
    y = log10(observed)
    known = df.where(y.isNotNull() & F.col(log_predicted).isNotNull()).withColumn("__y", y)
    if keys:
        known = attach(known, keys, F.avg("__y").alias("__m"))
        mean: Column = F.col("__m")
    else:
        mean = known.select(F.avg("__y")).scalar()
    gap, dev = F.col("__y") - F.col(log_predicted), F.col("__y") - mean
    out = known.groupBy(*keys).agg(
        F.avg(signif(gap * gap, digits)).alias("mse"),
        F.sum(signif(gap * gap, digits)).alias("pred_var"),
        F.sum(signif(dev * dev, digits)).alias("tot_var"),
        F.count("*").alias("n"),
    )
    return out.select(
        *keys, "n", signif(F.sqrt("mse"), digits).alias("rmse"),
        signif(F.lit(1.0) - ratio("pred_var", "tot_var"), digits).alias("r2"),
    )


def calibrate_labs(values: DataFrame, reference: DataFrame, lab: str, entity: str, value: str, ref: str, at_least: int = 5) -> DataFrame:
    """Per-entity medians of measurements calibrated to the reference, lab by lab.

    Per-lab entity medians are paired with the reference; labs with enough paired entities get a least
    squares and a total least squares line, which are applied to all their entities.
    """
    per = staged(medians(values, [lab, entity], value, "x"))
    ref_one = reference.select(entity, F.col(ref).alias("y")).where("y is not null")
    paired = keep_diverse_groups(per.join(ref_one, entity), [lab], entity, at_least)
    paired = staged(paired.select(lab, "x", "y"))
    lines = ols(paired, "x", "y", [lab]).select(lab, "slope", "intercept").join(
        tls(paired, "x", "y", [lab]).drop("n"), lab
    )
    applied = staged(
        per.join(lines, lab).select(
            entity,
            "x",
            (F.col("x") * F.col("slope") + F.col("intercept")).alias("cal_ols"),
            (F.col("x") * F.col("tls_slope") + F.col("tls_intercept")).alias("cal_tls"),
        )
    )
    return medians_of(applied, [entity], {"cal_ols": "median_ols", "cal_tls": "median_tls", "x": "median_raw"})


def route_adjusted(df: DataFrame, keep: list[str], route: str, oral: str, base: str, factors: dict[str, Column]) -> DataFrame:
    """Predictions per method as rows: base times the method's factor on the oral route only."""
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"),
                F.when(F.col(route) == oral, F.col(base) * as_col(f)).otherwise(F.col(base)).alias("predicted"),
            )
            for m, f in factors.items()
        ]
    )
    return df.select(*keep, F.inline(cells))


def method_table(df: DataFrame, predicted: str, observed: str, keys: list[str], route: str, methods: list[str]) -> DataFrame:
    """Agreement per route and in total, measures as rows and methods as columns."""
    sums = agreement_subtotals(df, predicted, observed, keys, route).withColumn("n", F.col("n").cast("double"))
    ids = [k for k in keys if k != "method"]
    long = melt(sums, [*ids, "method", route], ["r2", "rmse", "cor", "n"], "variable", "value")
    return long_to_methods(long, [*ids, route, "variable"], "method", "value", methods)
