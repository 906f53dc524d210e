"""Grouped summaries, results carried on every row, group filters, counts and histograms.

A summary that must appear on every row is an aggregate joined back, not an unbounded window: the
aggregate combines on the map side, few groups are broadcast, and a shuffled join of many groups can be
split when one key is hot, while a window would buffer the whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import as_col, log10, ratio, row_missing
from permspark.operators.ordered import join_keys
from permspark.sources.writers import staged


# --- aggregate expressions -------------------------------------------------------------------


def mean_sd_n(c, prefix: str) -> list[Column]:
    c = as_col(c)
    return [F.avg(c).alias(f"{prefix}_mean"), F.stddev_samp(c).alias(f"{prefix}_sd"), F.count(c).alias(f"{prefix}_n")]


def geometric_mean(c) -> Column:
    return F.pow(F.lit(10.0), F.avg(log10(c)))


def log_sd(c) -> Column:
    return F.stddev_samp(log10(c))


def count_if(cond) -> Column:
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).cast("bigint")


def share_if(cond) -> Column:
    return F.avg(cond.cast("double"))


def representative(c, order) -> Column:
    """The value on the first row of a stated order; unlike a bare first() it is deterministic."""
    return F.min_by(as_col(c), order)


def range_over(cols) -> list[Column]:
    cols = [as_col(c) for c in cols]
    if len(cols) == 1:
        return [F.min(cols[0]).alias("min_all"), F.max(cols[0]).alias("max_all")]
    return [F.min(F.least(*cols)).alias("min_all"), F.max(F.greatest(*cols)).alias("max_all")]


# --- results on every row ---------------------------------------------------------------------


def join_back(df: DataFrame, reduced: DataFrame, keys, how: str) -> DataFrame:
    """Join a grouped result to its rows.

    The result is stored first, so that its true size is known: a small one is broadcast by Spark's own
    size threshold and the rows are not shuffled at all; a large one is a plain scan, and adaptive
    execution can split a hot key of the shuffled join.
    """
    return join_keys(df, staged(reduced), keys, how)


def attach(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """Group results on every row of the group."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    return join_back(df, stats, keys, "left")


def attach_distinct(df: DataFrame, keys, member: str, out: str) -> DataFrame:
    keys = list(keys)
    stats = distinct_members(df, keys, member).groupBy(*keys).agg(F.count("*").alias(out))
    return join_back(df, stats, keys, "left")


def distinct_members(df: DataFrame, keys, member: str) -> DataFrame:
    return df.where(F.col(member).isNotNull()).select(*keys, member).distinct()


def distinct_counts(df: DataFrame, member: str, tests: dict[str, Column], keys=()) -> DataFrame:
    """Distinct members satisfying each of several conditions.

    Members are reduced first with one flag per condition, so k conditions cost one shuffle instead
    of the k-fold expansion of several count(distinct).
    """
    flags = [F.max(t.cast("int")).alias(n) for n, t in tests.items()]
    members = df.where(F.col(member).isNotNull()).groupBy(*keys, member).agg(*flags)
    return members.groupBy(*keys).agg(*[count_if(F.col(n) == 1).alias(n) for n in tests])


def sketched_counts(
    df: DataFrame, member: str, tests: dict[str, Column], keys=(), together: Sequence[tuple[str, str]] = (), size: int = 16
) -> DataFrame:
    """Distinct members for each condition, and for pairs of conditions both and either, from mergeable theta sketches.

    No member is shuffled, only sketches of 2**size entries at most. Counts up to that are exact; above, `<name>_error` bounds the relative
    error of a count in 95 % of cases, for a pair relative to the members that meet either condition. Pairs give `<a>_and_<b>` and `<a>_or_<b>`.
    """
    sketches = df.groupBy(*keys).agg(*[F.theta_sketch_agg(F.when(t, F.col(member)), F.lit(size)).alias(f"__{n}") for n, t in tests.items()])
    parts = {n: F.col(f"__{n}") for n in tests}
    for a, b in together:
        parts[f"{a}_and_{b}"] = F.theta_intersection(f"__{a}", f"__{b}")
        parts[f"{a}_or_{b}"] = F.theta_union(f"__{a}", f"__{b}", F.lit(size))
    counts = {n: F.theta_sketch_estimate(s) for n, s in parts.items()}
    whole = {n: counts[n.replace("_and_", "_or_")] if "_and_" in n else c for n, c in counts.items()}
    errors = [F.when(whole[n] < 2**size, F.lit(0.0)).otherwise(F.lit(2 * 2 ** (-size / 2))).alias(f"{n}_error") for n in counts]
    return sketches.select(*keys, *[c.alias(n) for n, c in counts.items()], *errors)


# --- group filters -----------------------------------------------------------------------------


def keep_large_groups(df: DataFrame, keys, more_than: int) -> DataFrame:
    keys = list(keys)
    big = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than)
    return join_back(df, big.select(*keys), keys, "left_semi")


def keep_diverse_groups(df: DataFrame, keys, member: str, at_least: int) -> DataFrame:
    keys = list(keys)
    big = distinct_members(df, keys, member).groupBy(*keys).agg(F.count("*").alias("__n"))
    return join_back(df, big.where(F.col("__n") >= at_least).select(*keys), keys, "left_semi")


def drop_poisoned_groups(df: DataFrame, keys, violation: Column) -> DataFrame:
    """Remove all rows of a group in which any row violates the rule."""
    keys = list(keys)
    return join_back(df, df.where(violation).select(*keys).distinct(), keys, "left_anti")


def keep_nearest(df: DataFrame, keys, value: str, target: float) -> DataFrame:
    """Rows whose value is nearest to the target within the group; ties all stay."""
    gap = F.abs(F.col(value) - F.lit(float(target)))
    best = attach(df.withColumn("__gap", gap), keys, F.min("__gap").alias("__best"))
    return best.where(F.col("__gap") == F.col("__best")).drop("__gap", "__best")


def keep_first(df: DataFrame, keys, order_cols) -> DataFrame:
    """One row per key, the first in a total order; combines on the map side, no sort."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def complete_rows(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def any_present(cols) -> Column:
    """True unless every one of the columns is missing."""
    return reduce(lambda a, b: a | b, [as_col(c).isNotNull() for c in cols])


def drop_sparsest_rows(df: DataFrame, cols) -> DataFrame:
    """Remove the rows with the most missing values, unless all incomplete rows are equally bad.

    The counted table is stored: it is read three times, and a filter on a stored count spares the
    optimizer from reasoning about every descriptor column.
    """
    counted = staged(df.withColumn("__miss", row_missing(cols)))
    holes = counted.where(F.col("__miss") > 0)
    worst = holes.select(F.max("__miss")).scalar()
    least = holes.select(F.min("__miss")).scalar()
    drop = F.coalesce((worst > least) & (F.col("__miss") == worst), F.lit(False))
    return counted.where(~drop).drop("__miss")


def complete_columns(df: DataFrame, cols) -> list[str]:
    """Names of the columns without a missing value (one aggregate row comes to the driver)."""
    row = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


# --- text, counts, histograms --------------------------------------------------------------------


def concat_values(df: DataFrame, keys, col: str, out: str, sep: str = ", ", distinct: bool = False) -> DataFrame:
    """Ordered concatenation per group, repeats kept unless `distinct`.

    Repeats are counted before the shuffle and only written out in the final string, which is by its
    nature one value per group.
    """
    keys = list(keys)
    pairs = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").cast("int").alias("__n"))
    runs = F.sort_array(F.collect_list(F.struct(F.col(col).cast("string").alias("v"), F.col("__n").alias("n"))))
    if distinct:
        words = F.transform(runs, lambda r: r["v"])
    else:
        words = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["n"])))
    return pairs.groupBy(*keys).agg(F.array_join(words, sep).alias(out))


def contingency(df: DataFrame, predicted: str, observed: str, keys=()) -> DataFrame:
    return df.groupBy(*keys, predicted, observed).agg(F.count("*").alias("n"))


def histogram(
    df: DataFrame, value: str, keys=(), bins: int = 30, log: bool = False, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Counts in equal-width bins of the value or of its log10; values outside the limits are dropped."""
    x = log10(value) if log else F.col(value).cast("double")
    tagged = df.select(*keys, x.alias("__x")).where(F.col("__x").isNotNull())
    if limits is None:
        lo, hi = tagged.select(F.min("__x")).scalar(), tagged.select(F.max("__x")).scalar()
    else:
        lo, hi = F.lit(float(limits[0])), F.lit(float(limits[1]))
        tagged = tagged.where((F.col("__x") >= lo) & (F.col("__x") <= hi))
    width = (hi - lo) / F.lit(float(bins))
    index = F.least(F.lit(bins), F.floor(F.coalesce(ratio(F.col("__x") - lo, width), F.lit(0.0))).cast("int") + 1)
    return tagged.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))


def column_statistics(df: DataFrame, cols) -> DataFrame:
    """Count, range, mean and sd of every named column as rows (column, n, lo, hi, mean, sd).

    A column without any value still gets its row.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = doubles.unpivot([], list(cols), "column", "value")
    return long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )


def column_profile(df: DataFrame, cols) -> DataFrame:
    """Mean and sd per column as rows: the training profile."""
    return column_statistics(df, cols).select("column", "mean", "sd", "n")


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def best_setting(df: DataFrame, error: str, setting: str, keys=()) -> DataFrame:
    """Setting with the least error; among equals the larger setting."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(F.col(error), -F.col(setting))).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in cols])
