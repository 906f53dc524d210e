"""Exact ranks, quantiles and sequence numbers that never sort a whole group in one task.

A window over one partition, or percentile() over one hot key, puts a group into a single task. Here rows (or their distinct
(key, value) counts) are range-partitioned by key and order columns, whatever their types, and stored with the number of their range.
Ranges are about equally deep: one hot key, or a far outlier, is cut into as many of them as its rows fill. Totals per key and range add
up to offsets, and only the rows of one key and range are ever ordered together. Neither the size of a group nor the place of the cuts
changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.sources.writers import staged


def null_safe_on(left: DataFrame, right: DataFrame, pairs) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def join_keys(df: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys where missing equals missing, keeping the keys of `df` once."""
    if not keys:
        raise ValueError("join_keys needs at least one key")
    right = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = null_safe_on(df, right, [(k, f"__k_{k}") for k in keys])
    return df.join(right, cond, how).drop(*[f"__k_{k}" for k in keys])


def spread(df: DataFrame, keys) -> DataFrame:
    """Deal a reduced table by its keys ahead of a join.

    Adaptive execution splits a hot partition of the large side only when both sides are plain shuffle stages. Spark leaves this
    repartition out where the table already is partitioned so, as an aggregate by the same keys is: store that (`staged`) instead.
    """
    return df.repartition(*keys)


def _in_ranges(df: DataFrame, order, ranges: int | None) -> DataFrame:
    """Rows stored with their range `__range` of `order`; by default as many ranges as the session has shuffle partitions.

    The number is stored with the rows, so that totals and rows always speak of the same ranges, also after a lost executor.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def _range_totals(counts: DataFrame, keys) -> DataFrame:
    """Rows before each range and in the whole group; a group has at most one row per range here."""
    sums = counts.groupBy(*keys, "__range").agg(F.sum("n").alias("__in"))
    run = Window.partitionBy(*keys).orderBy("__range")
    return sums.select(
        *keys,
        "__range",
        "__in",
        F.coalesce(F.sum("__in").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__in").over(Window.partitionBy(*keys)).alias("n_total"),
    )


def _value_counts(df: DataFrame, keys, value: str, ranges: int | None, weight: Column | None = None) -> DataFrame:
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    return _in_ranges(counts, [*keys, value], ranges)


def _running(counts: DataFrame, totals: DataFrame, keys, value: str) -> DataFrame:
    run = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_keys(counts, totals, [*keys, "__range"])
    return joined.withColumn("n_before", F.col("__before") + F.coalesce(F.sum("n").over(run), F.lit(0)))


def ranked_values(df: DataFrame, keys, value: str, weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """One row per distinct (keys, value): n, n_before (rows below) and n_total.

    With a `weight` these are sums of the weight instead of row counts.
    """
    keys = list(keys)
    counts = _value_counts(df, keys, value, ranges, weight)
    return _running(counts, _range_totals(counts, keys), keys, value).select(*keys, value, "n", "n_before", "n_total")


def average_rank(df: DataFrame, keys, value: str, out: str = "rank", ranges: int | None = None) -> DataFrame:
    """Rank with ties averaged, within keys (or overall); a missing value has no rank."""
    keys = list(keys)
    ranks = ranked_values(df, keys, value, ranges=ranges).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out)
    )
    return join_keys(df, spread(ranks, [*keys, value]), [*keys, value], "left")


def quantiles_by_ranges(df: DataFrame, keys, value: str, probs: dict[str, float], ranges: int | None = None) -> DataFrame:
    """The result of `quantiles` from stored counts of all distinct values, cut into ranges."""
    keys = list(keys)
    counts = _value_counts(df, keys, value, ranges)
    totals = _range_totals(counts, keys)

    def position(p: float) -> Column:
        return (F.col("n_total") - 1) * F.lit(float(p))

    def target(p: float, up: int) -> Column:
        return F.least(F.floor(position(p)) + up, F.col("n_total") - 1)

    wanted = F.lit(False)
    for p in probs.values():
        for up in (0, 1):
            k = target(p, up)
            wanted = wanted | ((F.col("__before") <= k) & (k < F.col("__before") + F.col("__in")))
    near = _running(counts, totals.where(wanted), keys, value)

    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))

    picks = []
    for name, p in probs.items():
        picks += [value_at(target(p, 0)).alias(f"__lo_{name}"), value_at(target(p, 1)).alias(f"__hi_{name}")]
    found = near.groupBy(*keys).agg(*picks, F.max("n_total").alias("n_total"))
    if not keys:
        found = found.where(F.col("n_total") > 0)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (position(p) - F.floor(position(p)))).alias(name))
    return found.select(*keys, *out, "n_total")


#: Size of a sketch, and the rank error it is trusted with: twice what it keeps to in 99 % of cases.
SKETCH = 2048
RANK_ERROR = 2 * 2.296 / SKETCH**0.9021
#: Groups of fewer values lie between the brackets as a whole.
SMALL = int(2 / RANK_ERROR)
#: Steps of the ranks by which brackets are narrowed.
GRID = 512
#: Values of a group between the brackets of its quantiles that one task may put in order.
BRACKETED = 1_000_000
#: Groups of fewer values, in multiples of SMALL, are put in order without sketches. Buckets of groups that are counted to find the others.
WHOLE, BUCKETS = 24, 1 << 20


def _large_groups(rows: DataFrame, groups: list[str], least: int) -> DataFrame:
    """Groups of `least` rows at least, stored. Only the groups of buckets with as many rows are counted one by one."""
    dealt = rows.select(*groups, F.pmod(F.xxhash64(*groups), F.lit(BUCKETS)).alias("__bucket"))
    full = staged(dealt.groupBy("__bucket").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("__bucket"))
    if not full.head(1):
        return full.select(*[F.lit(None).cast(dealt.schema[g].dataType).alias(g) for g in groups])
    counts = dealt.join(full, "__bucket", "left_semi").groupBy(*groups).agg(F.count("*").alias("__n"))
    return staged(counts.where(F.col("__n") >= least).select(*groups))


def _brackets(rows: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """Per group, `__n` and a bracket `__lo<i>` to `__hi<i>` around the values next to each quantile, from one sketch."""
    ranks = [0.0, 1.0, *(min(max(p + e, 0.0), 1.0) for p in probs for e in (-RANK_ERROR, RANK_ERROR))]
    sketched = rows.groupBy(*groups).agg(F.kll_sketch_agg_double("__v", F.lit(SKETCH)).alias("__s"), F.count("__v").alias("__n"))
    at = F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(r) for r in ranks]))
    found = sketched.where(F.col("__n") > 0).select(*groups, "__n", at.alias("__q"))

    def end(k: int, whole: int) -> Column:
        return F.get("__q", F.when(F.col("__n") < SMALL, F.lit(whole)).otherwise(F.lit(k)))

    ends = [end(2 + 2 * i + side, side).alias(f"__{name}{i}") for i in range(len(probs)) for side, name in ((0, "lo"), (1, "hi"))]
    return staged(found.select(*groups, "__n", *ends))


def _narrowed(rows: DataFrame, groups: list[str], probs: list[float], brackets: DataFrame) -> DataFrame:
    """Narrower brackets, from sketches of the values within them and the counts of those below."""
    met = join_keys(rows, brackets, groups)
    aggs = [F.first("__n").alias("__n")]
    for i in range(len(probs)):
        own = F.when(F.col("__v").between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), F.col("__v"))
        aggs += [F.kll_sketch_agg_double(own, F.lit(SKETCH)).alias(f"__s{i}"), F.count(own).alias(f"__c{i}")]
        aggs += [F.count_if(F.col("__v") < F.col(f"__lo{i}")).alias(f"__b{i}")]
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    ends = []
    for i, p in enumerate(probs):
        rank = (F.floor((F.col("__n") - 1) * F.lit(float(p))) - F.col(f"__b{i}")) / F.col(f"__c{i}")
        margin = RANK_ERROR + 1 / F.col(f"__c{i}")
        at = F.kll_sketch_get_quantile_double(f"__s{i}", grid)
        for name, place in (("lo", F.floor((rank - margin) * GRID)), ("hi", F.ceil((rank + margin + 1 / F.col(f"__c{i}")) * GRID))):
            ends.append(F.get(at, F.least(F.greatest(place, F.lit(0)), F.lit(GRID)).cast("int")).alias(f"__{name}{i}"))
    return staged(met.groupBy(*groups).agg(*aggs).select(*groups, "__n", *ends))


def _bracketed(rows: DataFrame, groups: list[str], probs: dict[str, float], brackets: DataFrame, bracketed: int, interpolated) -> DataFrame:
    """Quantiles `__q<i>` and `__n` of the groups that have brackets."""
    inside = 2 * RANK_ERROR * (brackets.agg(F.max("__n")).first()[0] or 0)
    while inside > bracketed:
        brackets = _narrowed(rows, groups, list(probs.values()), brackets)
        inside *= 2 * (RANK_ERROR + 1 / GRID)

    # equal slots lie between the same ends of brackets; values outside of all brackets are counted only
    over = [F.col("__v") >= F.col(f"__lo{i}") for i in range(len(probs))]
    past = [F.col("__v") > F.col(f"__hi{i}") for i in range(len(probs))]
    slot, kept = F.lit(0), F.lit(False)
    for o, h in zip(over, past):
        slot, kept = slot + o.cast("int") + h.cast("int"), kept | (o & ~h)
    near = join_keys(rows, brackets, groups).select(*groups, "__n", slot.alias("__slot"), F.when(kept, F.col("__v")).alias("__v"))
    near = near.groupBy(*groups, "__n", "__slot", "__v").agg(F.count("*").alias("__in"))
    run = Window.partitionBy(*groups).orderBy("__slot", "__v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__before", F.coalesce(F.sum("__in").over(run), F.lit(0)))
    found = staged(interpolated(near))
    missed = F.lit(False)
    for i in range(len(probs)):
        missed = missed | F.col(f"__q{i}").isNull()
    if found.where(missed).head(1):
        again = join_keys(rows, found.where(missed).select(*groups), groups)
        again = quantiles_by_ranges(again, groups, "__v", {f"__q{i}": p for i, p in enumerate(probs.values())})
        found = staged(found.where(~missed).unionByName(again.withColumnRenamed("n_total", "__n")))
    return found


def quantiles(
    df: DataFrame, keys, value: str, probs: dict[str, float], ranges: int | None = None, bracketed: int = BRACKETED
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, as named columns plus n_total.

    Groups of some thousand values are put in order as they are, after one shuffle. Of larger ones, mergeable sketches bracket every
    quantile; a second pass counts what lies below and keeps only the values inside the brackets, so few of their values are shuffled and no
    table of all values is stored. The counts are exact, and show if a sketch was further off than it is trusted to be; such groups, if
    any, go through ranges of all their values, which `ranges` asks for in any case.

    Groups whose values are all missing give no row; use `keep_groups` to add them back as NULL. NaN counts as missing.
    """
    keys, names = list(keys), list(probs)
    if ranges is not None:
        return quantiles_by_ranges(df, keys, value, probs, ranges)
    groups = [f"__g{i}" for i in range(max(len(keys), 1))]
    given = [F.col(k).alias(g) for k, g in zip(keys, groups)] or [F.lit(0).alias(groups[0])]
    rows = df.select(*given, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))

    def position(p: float) -> Column:
        return (F.col("__n") - 1) * F.lit(float(p))

    def value_at(k: Column) -> Column:
        k = F.least(k, F.col("__n") - 1)
        return F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__in")), F.col("__v")))

    def interpolated(near: DataFrame) -> DataFrame:
        picks = []
        for i, p in enumerate(probs.values()):
            picks += [value_at(F.floor(position(p))).alias(f"__a{i}"), value_at(F.floor(position(p)) + 1).alias(f"__b{i}")]
        found = near.groupBy(*groups, "__n").agg(*picks)
        out = []
        for i, p in enumerate(probs.values()):
            lo, hi = F.col(f"__a{i}"), F.col(f"__b{i}")
            out.append((lo + (hi - lo) * (position(p) - F.floor(position(p)))).alias(f"__q{i}"))
        return found.select(*groups, *out, "__n")

    large = _large_groups(rows, groups, WHOLE * SMALL)
    some = bool(large.head(1))
    few = join_keys(rows, large, groups, "left_anti") if some else rows
    group = Window.partitionBy(*groups)
    ordered = few.withColumn("__before", F.row_number().over(group.orderBy("__v")) - 1).withColumn("__n", F.count("*").over(group))
    found = staged(interpolated(ordered.withColumn("__in", F.lit(1))))
    if some:
        brackets = _brackets(join_keys(rows, large, groups, "left_semi"), groups, list(probs.values()))
        found = found.unionByName(_bracketed(rows, groups, probs, brackets, bracketed, interpolated))
    named = [F.col(g).alias(k) for k, g in zip(keys, groups)] + [F.col(f"__q{i}").alias(n) for i, n in enumerate(names)]
    return found.select(*named, F.col("__n").alias("n_total"))


def medians(df: DataFrame, keys, value: str, out: str = "median", ranges: int | None = None) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, ranges).drop("n_total")


def medians_of(df: DataFrame, keys, values: dict[str, str]) -> DataFrame:
    """Medians of several columns per group, {column: output name}, in one pass; groups without values keep a row of NULLs."""
    keys = list(keys)
    each = F.array(*[F.struct(F.lit(i).alias("__i"), F.col(c).cast("double").alias("__x")) for i, c in enumerate(values)])
    found = quantiles(df.select(*keys, F.inline(each)), [*keys, "__i"], "__x", {"__m": 0.5})
    picks = [F.max(F.when(F.col("__i") == i, F.col("__m"))).alias(name) for i, name in enumerate(values.values())]
    wide = found.groupBy(*keys).agg(*picks)
    return keep_groups(wide, df, keys) if keys else wide


def keep_groups(summary: DataFrame, df: DataFrame, keys) -> DataFrame:
    """Re-attach groups that had no usable value."""
    return join_keys(df.select(*keys).distinct(), summary, list(keys), "left")


def sequence_index(df: DataFrame, order_cols, keys=(), out: str = "row_id", ranges: int | None = None) -> DataFrame:
    """1-based row number in the order of `order_cols` (of any type, missing first), with n_total.

    Numbers run over the whole table, or within `keys`. Ranges are cut by all order columns, so many rows with one value of the first are
    many ranges, too; each range is numbered on its own and shifted by the rows of earlier ranges. `order_cols` should tell rows apart:
    among rows equal in all of them any order may come out.
    """
    order_cols, keys = list(order_cols), list(keys)
    tagged = _in_ranges(df, [*keys, *order_cols], ranges)
    totals = _range_totals(tagged.select(*keys, "__range", F.lit(1).alias("n")), keys).drop("__in")
    within = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order_cols))
    return (
        join_keys(tagged.withColumn("__rn", within), totals, [*keys, "__range"])
        .withColumn(out, (F.col("__before") + F.col("__rn")).cast("bigint"))
        .drop("__range", "__rn", "__before")
    )
