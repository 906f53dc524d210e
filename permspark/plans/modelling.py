"""Model building and comparison: binning schemes, bin intervals, class values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from permspark.functions.scalar import cut_index, log10, packed_interval, unpack_interval
from permspark.operators import models as M
from permspark.operators.features import cluster_cuts
from permspark.operators.grouping import keep_nearest
from permspark.operators.ordered import quantiles
from permspark.operators.sampling import SplitOptions, balanced_roles, reserve_sample
from permspark.operators.sets import long_to_methods, priority_union, stack, tagged
from permspark.operators.stats import class_agreement
from permspark.sources.writers import staged


def bin_intervals(
    train: DataFrame, test: DataFrame, train_bin: str, predicted_bin: str, value: str, keys=(), digits: int = 2
) -> DataFrame:
    """Per bin the training median and the 95 % interval of the test values predicted into it.

    Returns (keys..., bin, med, low, high, text) with the text 'm (lo - hi)'.
    """
    keys = list(keys)
    med = quantiles(train, [*keys, train_bin], value, {"med": 0.5}).select(*keys, F.col(train_bin).alias("bin"), "med")
    ends = quantiles(test, [*keys, predicted_bin], value, {"low": 0.025, "high": 0.975})
    ends = ends.select(*keys, F.col(predicted_bin).alias("bin"), "low", "high")
    both = med.join(ends, [*keys, "bin"], "left")
    return both.withColumn("text", packed_interval("med", "low", "high", digits))


def class_values(df: DataFrame, predicted: str, intervals: DataFrame) -> DataFrame:
    """Predicted class to its value and interval (struct med, low, high)."""
    table = intervals.select(F.col("bin").alias(predicted), unpack_interval("text").alias("__v"))
    joined = df.join(table, predicted, "left")
    return joined.select("*", F.col("__v.med").alias("value"), F.col("__v.low").alias("value_low"), F.col("__v.high").alias("value_high")).drop("__v")


def regression_classes(df: DataFrame, predicted: str, boundaries_from: DataFrame, observed: str, observed_bin: str) -> DataFrame:
    """Three classes from a regression: cut at the largest observations of bins 1 and 2."""

    def top(b):
        return boundaries_from.where(F.col(observed_bin) == b).select(F.max(observed)).scalar()

    return df.withColumn("predicted_bin", M.class_boundaries(F.col(predicted), top(1), top(2)))


def regression_classes_by_ends(df: DataFrame, predicted: str, boundaries_from: DataFrame, observed: str, observed_bin: str) -> DataFrame:
    """Three classes from a regression: class 1 below the largest observation of bin 1, class 3 above the smallest of bin 3."""
    ends = boundaries_from.agg(
        F.max(F.when(F.col(observed_bin) == 1, F.col(observed))).alias("__low"), F.min(F.when(F.col(observed_bin) == 3, F.col(observed))).alias("__high")
    )
    low, high = ends.select("__low").scalar(), ends.select("__high").scalar()
    return df.withColumn("predicted_bin", M.outer_classes(F.col(predicted), low, high))


def structure_means(df: DataFrame, structure: str, value: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Mean and sd of log10 values per structure, with means of further columns {column: name}."""
    known = df.where(F.col(structure).isNotNull() & (F.col(value) > 0))
    aggs = [F.avg(log10(value)).alias("mean_log"), F.stddev_samp(log10(value)).alias("sd_log")]
    aggs += [F.avg(c).alias(name) for c, name in (extra or {}).items()]
    return known.groupBy(F.col(structure).alias("structure")).agg(*aggs)


#: Fixed value: the efflux of literature rows, which have none of their own.
LITERATURE_EFFLUX = 1e-5


def training_sets(
    own: DataFrame, literature: DataFrame, reserved: DataFrame, options: SplitOptions, validation: int = 50, target_ph: float = 7.4,
    validation_seed: int = 20417,
) -> DataFrame:
    """Role tables of the literature set, the own set and both combined, told apart by `dataset`.

    own: (structure, value, efflux); literature: (structure, value, ph); reserved: (structure).
    Literature values count only at the pH nearest the target. A few literature-only structures are
    reserved for validation, beside the ids reserved from the start. In the combined set own data win.
    """
    lit = staged(structure_means(keep_nearest(literature, ["structure"], "ph", target_ph), "structure", "value"))
    mine = staged(structure_means(own, "structure", "value", {"efflux": "mean_efflux"}))
    base = reserved.select("structure").distinct()
    pool = lit.select("structure").join(own.select("structure"), "structure", "left_anti").join(base, "structure", "left_anti")
    reserve = staged(base.union(reserve_sample(pool, "structure", validation, validation_seed)))
    pooled = replace(options, by_source=False)
    no_efflux = replace(pooled, efflux_break=None)
    combined = priority_union(mine, lit, "structure", "source", ("own", "literature")).withColumn(
        "mean_efflux", F.when(F.col("source") == "literature", F.lit(LITERATURE_EFFLUX)).otherwise(F.col("mean_efflux"))
    )
    parts = {
        "literature": balanced_roles(lit, "structure", "mean_log", reserve=reserve, options=replace(no_efflux, train_size=None)),
        "own": balanced_roles(mine, "structure", "mean_log", efflux="mean_efflux", reserve=reserve, options=replace(pooled, train_size=None)),
        "combined": balanced_roles(staged(combined), "structure", "mean_log", "source", "mean_efflux", reserve, options),
    }
    tables = [tagged(t, "dataset", name) for name, t in parts.items()]
    return stack(tables, fill=True)


def scheme_table(
    train: DataFrame, test: DataFrame, cols, value: str, key: str, bins=(2, 3, 4, 5), chosen: int = 3, **forest
) -> DataFrame:
    """Accuracy, kappa and bin intervals for every number of bins, and for a regression cut into three classes by the training values.

    Rows are metrics, columns are schemes. `chosen` names the scheme with which the regression is compared; it has three bins.
    """
    if chosen != 3 or chosen not in bins:
        raise ValueError("a regression is cut into three classes: chosen must be 3, and one of the schemes")
    spark = train.sparkSession
    both = train.withColumn("__t", F.lit(0)).unionByName(test.withColumn("__t", F.lit(1))).withColumn("__lv", log10(value))
    # The classes are a property of all measurements, so cut points come from train and test together.
    cuts = cluster_cuts(both, "__lv", bins)
    for k in bins:
        both = both.withColumn(f"bin{k}", cut_index("__lv", cuts[k]))
    both = both.persist()
    try:
        tr, te = both.where("__t = 0"), both.where("__t = 1")
        rows: list[tuple[str, str, str]] = []
        for k in bins:
            label = f"bin{k}"
            model = M.fit_forest(tr.withColumn("y", F.col(label) - 1.0), cols, "y", True, **forest)
            scored = M.score_complete(model, te, cols, key).join(te.select(key, label, value), key)
            scored = scored.withColumn("pred", (F.col("prediction") + 1).cast("int")).persist()
            rows += _metric_rows(f"bins_{k}", scored, "pred", label)
            rows += [
                (f"bins_{k}", f"Bin{r['bin']}", r["text"])
                for r in bin_intervals(tr, scored, label, "pred", value).collect()
            ]
            scored.unpersist()
        model = M.fit_forest(tr, cols, "__lv", False, **forest)
        scored = M.score_complete(model, te, cols, key).join(te.select(key, f"bin{chosen}"), key)
        scored = scored.withColumn("__p", F.pow(F.lit(10.0), "prediction"))
        classes = regression_classes_by_ends(scored, "__p", tr, value, f"bin{chosen}")
        rows += _metric_rows("continuous", classes, "predicted_bin", f"bin{chosen}")
    finally:
        both.unpersist()
    long = spark.createDataFrame(rows, "scheme string, metric string, value string")
    return long_to_methods(long, ["metric"], "scheme", "value", ["continuous", *[f"bins_{k}" for k in bins]])


def _metric_rows(scheme: str, scored: DataFrame, predicted: str, observed: str) -> list[tuple[str, str, str]]:
    r = class_agreement(scored, predicted, observed).first()

    def text(v):
        return None if v is None else f"{v:.3g}"

    return [(scheme, "Accuracy", text(r["accuracy"])), (scheme, "Kappa", text(r["kappa"]))]
