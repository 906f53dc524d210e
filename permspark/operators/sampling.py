"""Deterministic stratified sampling, splits and role assignment.

A row's place in its stratum is the order of a seeded hash of its key, so samples repeat exactly on
any cluster. The n smallest hashes are found without sorting a stratum: rows are counted per hash
prefix, whole prefixes are taken while they fit, and only the one prefix that straddles n is ordered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.functions.scalar import half_even, hash_hex, hash_int
from permspark.operators.cleaning import consensus_bin, threshold_class
from permspark.operators.ordered import join_keys, spread
from permspark.sources.writers import staged

PREFIX_DIGITS = 3


def sample_strata(df: DataFrame, strata: list[str], key: list[str], size: Column, seed: int) -> DataFrame:
    """Exactly `size` rows per stratum (all of a smaller stratum), lowest hashes first.

    `size` may use n_stratum, the stratum's row count. `key` must identify a row. The input is read
    three times, so an expensive one should be stored first.
    """
    hashed = df.withColumn("__h", hash_hex(seed, *key)).withColumn("__b", hash_int("__h", 1, PREFIX_DIGITS))
    counts = hashed.groupBy(*strata, "__b").agg(F.count("*").alias("__in"))
    run = Window.partitionBy(*strata).orderBy("__b")
    totals = counts.select(
        *strata,
        "__b",
        "__in",
        F.coalesce(F.sum("__in").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__in").over(Window.partitionBy(*strata)).alias("n_stratum"),
    ).withColumn("__take", size.cast("bigint") - F.col("__before"))
    whole = totals.where(F.col("__in") <= F.col("__take")).select(*strata, "__b")
    edge = totals.where((F.col("__take") > 0) & (F.col("__in") > F.col("__take"))).select(*strata, "__b", "__take")
    on = [*strata, "__b"]
    taken = join_keys(hashed, whole, on, "left_semi")
    place = F.row_number().over(Window.partitionBy(*on).orderBy("__h", *key))
    partial = join_keys(hashed, edge, on).withColumn("__rn", place).where(F.col("__rn") <= F.col("__take"))
    return taken.unionByName(partial.drop("__take", "__rn")).drop("__h", "__b")


def reserve_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n ids in hash order: a top-n, so every task keeps at most n candidates."""
    h = hash_hex(seed, key)
    return df.select(key).distinct().withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def rounded_size(smallest: Column, rule: str = "ten") -> Column:
    """Sample size from the smallest class: tens after taking 5 off, or the size itself."""
    if rule == "ten":
        return half_even((smallest - 5).cast("double"), -1)
    return half_even(smallest.cast("double"), 1)


def grouped_split(
    df: DataFrame, entity: str, bin_col: str, fraction: float, seed: int, forced_train: list | None = None
) -> DataFrame:
    """Test flag per row: entities are split within their consensus bin, all their rows together."""
    members = staged(df.groupBy(entity).agg(consensus_bin(bin_col).alias("consensus")))
    size = half_even(F.col("n_stratum").cast("double") * F.lit(fraction))
    test = sample_strata(members, ["consensus"], [entity], size, seed).select(entity, F.lit(1).alias("__t"))
    if forced_train:
        test = test.where(~F.col(entity).isin(forced_train))
    flags = members.join(test, entity, "left").withColumn("test", F.coalesce("__t", F.lit(0))).drop("__t")
    return join_keys(df, spread(flags, [entity]), [entity], "left")


@dataclass(frozen=True)
class SplitOptions:
    """Options of the balanced training-set selection."""

    breaks: tuple[float, ...] = (0.9,)
    limits: tuple[float, float] = (-2.0, 2.5)
    efflux_break: float | None = None
    efflux_size: int = 10
    gap: bool = False
    rounding: str = "ten"
    flatten: int | tuple[float, ...] | None = None
    drop_high_efflux: bool = False
    train_size: int | None = None
    by_source: bool = True
    seed: int = 10192018
    efflux_seed: int = 5212019
    reserve_ids: tuple = field(default=())


def equal_subbins(c: str, cls: str, breaks, limits, k: int) -> Column:
    """Class label with the number of its equal-width sub-bin, as class_k."""
    out = None
    for name, lo, hi in (("low", limits[0], breaks[0]), ("high", breaks[0], limits[1])):
        step = (hi - lo) / k
        for i in range(k):
            a, b = lo + i * step, (hi if i == k - 1 else lo + (i + 1) * step)
            test = (F.col(cls) == name) & (F.col(c) > F.lit(a)) & (F.col(c) <= F.lit(b))
            label = F.lit(f"{name}_{i + 1}")
            out = F.when(test, label) if out is None else out.when(test, label)
    return out


def list_subbins(c: str, cls: str, edges) -> Column:
    out = None
    for i in range(len(edges) - 1):
        test = F.col(cls).isNotNull() & (F.col(c) > F.lit(float(edges[i]))) & (F.col(c) <= F.lit(float(edges[i + 1])))
        label = F.concat(F.col(cls), F.lit(f"_{i + 1}"))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def balanced_roles(
    df: DataFrame, key: str, value: str, source: str | None = None, efflux: str | None = None,
    reserve: DataFrame | None = None, options: SplitOptions = SplitOptions(),
) -> DataFrame:
    """Add `category` and `role` (train, test, reserve, train_efflux, high_efflux) per entity.

    Reserved ids are set aside, then the efflux sample, then every (category, source) stratum of the
    rest gives the same number of training entities; what is left is the test set.
    """
    o = options
    strata_source = F.col(source) if (source and o.by_source) else F.lit("all")
    out = df.withColumn("__src", strata_source).withColumn("role", F.lit(None).cast("string"))
    if reserve is not None:
        ids = reserve.select(F.col(reserve.columns[0]).alias(key)).distinct().withColumn("__r", F.lit(True))
        out = out.join(ids, key, "left").withColumn("role", F.when(F.col("__r"), F.lit("reserve"))).drop("__r")
    # One row per entity, read several times by every sampling step: store it between the steps.
    out = staged(out)
    if o.efflux_break is not None and efflux:
        side = F.when(F.col(efflux) <= o.efflux_break, F.lit("low")).when(F.col(efflux) > o.efflux_break, F.lit("high"))
        out = out.withColumn("efflux_category", side)
        known = out.where(F.col(efflux).isNotNull()).select(key, "efflux_category")
        chosen = sample_strata(known, ["efflux_category"], [key], F.lit(o.efflux_size), o.efflux_seed)
        out = out.join(chosen.select(key, F.lit(True).alias("__e")), key, "left").withColumn(
            "role", F.when(F.col("__e"), F.lit("train_efflux")).otherwise(F.col("role"))
        ).drop("__e")
        if o.drop_high_efflux:
            out = out.withColumn(
                "role", F.when(F.col("efflux_category") == "high", F.lit("high_efflux")).otherwise(F.col("role"))
            )
        out = staged(out)
    out = out.withColumn("__cat", threshold_class(value, list(o.breaks), *o.limits))
    if o.flatten is not None and len(o.breaks) == 1:
        if isinstance(o.flatten, int):
            out = out.withColumn("__cat", equal_subbins(value, "__cat", o.breaks, o.limits, o.flatten))
        else:
            out = out.withColumn("__cat", list_subbins(value, "__cat", o.flatten))
    open_rows = out.where(F.col("role").isNull() & F.col("__cat").isNotNull()).select(key, "__cat", "__src")
    if o.gap:
        open_rows = open_rows.where(F.col("__cat").isin("low", "high"))
    if o.train_size is not None:
        size = F.lit(o.train_size)
    else:
        sizes = open_rows.groupBy("__cat", "__src").agg(F.count("*").alias("n"))
        size = rounded_size(sizes.select(F.min("n")).scalar(), o.rounding)
    train = sample_strata(open_rows, ["__cat", "__src"], [key], size, o.seed)
    out = out.join(train.select(key, F.lit(True).alias("__t")), key, "left")
    if o.gap:
        mid = sum(o.breaks) / len(o.breaks)
        category = threshold_class(value, [mid], *o.limits)
    else:
        category = F.split("__cat", "_")[0]
    role = F.when(F.col("__t"), F.lit("train")).otherwise(F.coalesce("role", F.lit("test")))
    return out.withColumn("category", category).withColumn("role", role).drop("__t", "__cat", "__src")
