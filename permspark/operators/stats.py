"""Regression, agreement, classification and resampling statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructType

from permspark.functions.distributions import t_p_value, t_upper_quantile
from permspark.functions.scalar import hash_hex, hash_int, hash_text, ratio, signif
from permspark.operators.grouping import attach, contingency
from permspark.operators.ordered import sequence_index


def ols(df: DataFrame, x: str, y: str, keys=(), p_value: bool = False) -> DataFrame:
    """Least squares y ~ x per group: slope, intercept, r2, n, t statistic (NULL for an exact fit) and degrees of freedom."""
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y_, x_).alias("slope"),
        F.regr_intercept(y_, x_).alias("intercept"),
        F.regr_r2(y_, x_).alias("r2"),
        F.regr_count(y_, x_).alias("n"),
    )
    fit = fit.withColumn("df", F.col("n") - 2).withColumn(
        "t_stat", F.signum("slope") * F.sqrt(ratio(F.col("r2") * F.col("df"), F.lit(1.0) - F.col("r2")))
    )
    if not p_value:
        return fit
    exact = (F.col("r2") >= 1) & (F.col("df") > 0)
    return fit.withColumn("p_value", F.when(exact, F.lit(0.0)).otherwise(t_p_value("t_stat", F.col("df").cast("double"))))


def tls_terms(x: str, y: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    x_, y_ = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return [
        F.var_samp(x_).alias("__sxx"),
        F.var_samp(y_).alias("__syy"),
        F.covar_samp(x_, y_).alias("__sxy"),
        F.avg(x_).alias("__mx"),
        F.avg(y_).alias("__my"),
        F.count(x_).alias("n"),
    ]


def tls(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Total least squares: the first principal axis of (x, y)."""
    return _tls_line(df.groupBy(*keys).agg(*tls_terms(x, y))).select(*keys, "tls_slope", "tls_intercept", "n")


def _tls_line(df: DataFrame) -> DataFrame:
    gap = F.col("__syy") - F.col("__sxx")
    twice = 2 * F.col("__sxy")
    root = F.sqrt(gap * gap + twice * twice)
    # two equal forms; each avoids subtracting nearly equal numbers on its side
    slope = F.when(gap >= 0, ratio(gap + root, twice)).otherwise(ratio(twice, root - gap))
    return df.withColumn("tls_slope", slope).withColumn(
        "tls_intercept", F.col("__my") - F.col("tls_slope") * F.col("__mx")
    )


def tls_residuals(df: DataFrame, x: str, y: str, keys) -> DataFrame:
    """Fitted value and residual of the group's principal axis on every complete row."""
    known = df.dropna(subset=[x, y])
    line = _tls_line(attach(known, keys, *tls_terms(x, y)))
    fitted = F.col("tls_slope") * F.col(x) + F.col("tls_intercept")
    return line.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop(
        "__sxx", "__syy", "__sxy", "__mx", "__my", "n"
    )


def agreement_terms(predicted: str, observed: str) -> list[Column]:
    """Aggregates for agreement() on complete pairs."""
    both = F.col(predicted).isNotNull() & F.col(observed).isNotNull()
    p = F.when(both, F.col(predicted).cast("double"))
    o = F.when(both, F.col(observed).cast("double"))
    return [
        (F.var_pop(o) * F.count(o)).alias("sst"),
        F.sum((o - p) * (o - p)).alias("sse"),
        F.corr(p, o).alias("cor"),
        F.count(o).alias("n"),
    ]


def agreement_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("r2", F.lit(1.0) - ratio("sse", "sst")).withColumn("rmse", F.sqrt(ratio("sse", "n")))


def agreement(df: DataFrame, predicted: str, observed: str, keys=()) -> DataFrame:
    """SST, SSE, R2 = 1 - SSE/SST, RMSE, correlation and N."""
    return agreement_columns(df.groupBy(*keys).agg(*agreement_terms(predicted, observed)))


def agreement_subtotals(df: DataFrame, predicted: str, observed: str, keys: list[str], route: str) -> DataFrame:
    """Agreement per route and over all routes in one pass (route 'All')."""
    cols = [F.col(k) for k in keys]
    grouped = df.groupingSets([[*cols, F.col(route)], cols], *cols, F.col(route)).agg(
        F.grouping(route).alias("__all"), *agreement_terms(predicted, observed)
    )
    named = grouped.withColumn(route, F.when(F.col("__all") == 1, F.lit("All")).otherwise(F.col(route))).drop("__all")
    return agreement_columns(named)


def rmse(observed: str, predicted: str, digits: int | None = None) -> Column:
    """Root mean squared difference, with `digits` significant digits if they are given."""
    gap = F.col(observed) - F.col(predicted)
    out = F.sqrt(F.avg(gap * gap))
    return out if digits is None else signif(out, digits)


def prediction_interval(df: DataFrame, x: str, y: str, confidence: float = 0.95, points: int = 1000) -> DataFrame:
    """Band around y = x on an even grid over the range of x."""
    known = df.dropna(subset=[x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    one = known.agg(
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.avg("x").alias("xbar"),
        F.count("*").alias("n"),
        (F.var_pop("x") * F.count("*")).alias("sxx"),
        F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("sse"),
    )
    one = one.withColumn("mse", ratio("sse", F.col("n") - 2)).withColumn(
        "t", t_upper_quantile(F.lit((1 - confidence) / 2), (F.col("n") - 2).cast("double"))
    )
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "xn", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    )
    spread = F.col("xn") - F.col("xbar")
    half = F.col("t") * F.sqrt(
        F.col("mse") * (F.lit(1.0) + ratio(F.lit(1.0), "n") + ratio(spread * spread, "sxx"))
    )
    return grid.select(
        "i", "xn", (F.col("xn") + half).alias("upper"), (F.col("xn") - half).alias("lower"), half.alias("half_width")
    )


def class_agreement(df: DataFrame, predicted: str, observed: str, keys=()) -> DataFrame:
    """Accuracy and Cohen's kappa for any number of classes, from the contingency counts.

    Numeric labels of different types are compared as numbers.
    """
    keys = list(keys)
    kinds = {df.schema[c].dataType for c in (predicted, observed)}
    if len(kinds) > 1 and all(isinstance(k, NumericType) for k in kinds):
        df = df.withColumns({c: F.col(c).cast("double") for c in (predicted, observed)})
    table = contingency(df.dropna(subset=[predicted, observed]), predicted, observed, keys)
    sides = F.array(
        F.struct(F.col(predicted).cast("string").alias("cls"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("o")),
        F.struct(F.col(observed).cast("string").alias("cls"), F.lit(0).cast("bigint").alias("p"), F.col("n").alias("o")),
    )
    hit = F.when(F.col(predicted).cast("string") == F.col(observed).cast("string"), F.col("n")).otherwise(F.lit(0))
    marg = (
        table.select(*keys, hit.alias("__hit"), F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.cls").alias("cls"))
        # each cell appears once per side, so its hits are counted twice
        .agg(F.sum("s.p").alias("p"), F.sum("s.o").alias("o"), F.sum("__hit").alias("hit2"))
    )
    out = marg.groupBy(*keys).agg(
        F.sum("o").alias("n"),
        (F.sum("hit2") / 2).alias("hits"),
        F.sum(F.col("p").cast("double") * F.col("o")).alias("po"),
    )
    acc = ratio("hits", "n")
    chance = ratio("po", F.col("n").cast("double") * F.col("n"))
    return out.select(*keys, "n", acc.alias("accuracy"), ratio(acc - chance, F.lit(1.0) - chance).alias("kappa"))


def binary_agreement(df: DataFrame, predicted: str, observed: str, keys=(), high="high", low="low") -> DataFrame:
    """Class accuracies, balanced accuracy and kappa for two classes."""
    p, o = F.col(predicted), F.col(observed)

    def n(cond) -> Column:
        return F.sum(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))

    one = df.dropna(subset=[predicted, observed]).groupBy(*keys).agg(
        n(F.lit(True)).alias("ntot"),
        n(p == o).alias("nright"),
        n((p == high) & (o == high)).alias("hh"),
        n((p == low) & (o == low)).alias("ll"),
        n(o == high).alias("oh"),
        n(o == low).alias("ol"),
        n(p == high).alias("ph"),
        n(p == low).alias("pl"),
    )
    acc = ratio("nright", "ntot")
    chance = ratio(F.col("oh") * F.col("ph") + F.col("ol") * F.col("pl"), F.col("ntot") * F.col("ntot"))
    return one.select(
        *keys,
        F.col("ntot").cast("bigint").alias("n"),
        acc.alias("accuracy"),
        ratio(acc - chance, F.lit(1.0) - chance).alias("kappa"),
        ratio("hh", "oh").alias("high_accuracy"),
        ratio("ll", "ol").alias("low_accuracy"),
        ((ratio("hh", "oh") + ratio("ll", "ol")) / 2).alias("balanced_accuracy"),
    )


# --- bootstrap -----------------------------------------------------------------------------------


def with_subsets(df: DataFrame, observed: str, cut: float, out: str = "subset") -> DataFrame:
    """Each pair once under 'all' and once under 'low' (obs <= cut) or 'high'."""
    part = F.when(F.col(observed) <= cut, F.lit("low")).otherwise(F.lit("high"))
    return df.withColumn(out, F.explode(F.array(F.lit("all"), part)))


def rep_blocks(reps: int) -> Column:
    """Blocks of four replicates: one hash per block gives four 32-bit numbers."""
    return F.explode(F.sequence(F.lit(0), F.lit((reps + 3) // 4 - 1)))


def block_numbers(block: str, hex_col: str, name: str) -> Column:
    """Rows (rep, eight hex digits) of one block's hash."""
    return F.inline(
        F.array(
            *[
                F.struct((F.col(block) * 4 + i + 1).alias("rep"), F.substring(hex_col, 1 + 8 * i, 8).alias(name))
                for i in range(4)
            ]
        )
    )


def bootstrap_draws(
    df: DataFrame, keys: list[str], id_col: str, reps: int, seed: int, partitions: int | None = None
) -> DataFrame:
    """n draws with replacement per group and replicate: the drawn rows with their `rep`.

    Row i of a group makes draw i of every replicate, so the draws are generated in parallel; they
    meet the drawn rows in an equi-join on (group, position), whose keys are evenly spread by hashing.
    The hint says that the rows are the small side: Spark takes the draws for no larger than the table
    they are exploded from and would broadcast them.
    """
    rows = sequence_index(df, [id_col], keys=keys, out="__pos").withColumnRenamed("n_total", "__n")
    source = rows.select(*keys, "__pos", "__n")
    if partitions:
        source = source.repartition(partitions)
    blocks = source.select("*", rep_blocks(reps).alias("__blk")).withColumn("__h", hash_hex(seed, *keys, "__blk", "__pos"))
    spun = blocks.select(*keys, "__n", block_numbers("__blk", "__h", "__x")).where(F.col("rep") <= reps)
    draws = spun.select(*keys, "rep", (hash_int("__x") % F.col("__n") + 1).alias("__pos"))
    return draws.join(rows.drop("__n").hint("shuffle_hash"), [*keys, "__pos"]).drop("__pos")


def replicate_statistics(draws: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """Adjusted R2 of obs ~ pred and RMSE per replicate."""
    per = draws.groupBy(*keys, "rep").agg(
        F.count("*").alias("n"), F.corr(predicted, observed).alias("__r"), rmse(observed, predicted).alias("rmse")
    )
    r2 = F.col("__r") * F.col("__r")
    adj = F.lit(1.0) - (F.lit(1.0) - r2) * ratio(F.col("n") - 1, F.col("n") - 2)
    return per.withColumn("adj_r2", adj).drop("__r")


def bootstrap_summary(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95 % interval over replicates; a group holds one row per replicate."""
    q = [0.025, 0.5, 0.975]
    arr = stats.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count("*").alias("replicates"),
        F.percentile("adj_r2", F.array(*[F.lit(p) for p in q])).alias("__r"),
        F.percentile("rmse", F.lit(0.5)).alias("rmse_median"),
    )
    names = ["r2_low", "r2_median", "r2_high"]
    return arr.select(
        *keys, "n", "replicates", *[F.get("__r", F.lit(i)).alias(c) for i, c in enumerate(names)], "rmse_median"
    )


def bootstrap(
    df: DataFrame, keys: list[str], id_col: str, observed: str, predicted: str, reps: int = 10000, seed: int = 1234,
    partitions: int | None = None,
) -> DataFrame:
    """Median and 95 % interval of adjusted R2 and the median RMSE over replicates.

    `partitions` spreads an input that comes in fewer tasks than there are cores; leave it out for
    large tables, or use bootstrap_poisson for them.
    """
    known = df.dropna(subset=[observed, predicted])
    draws = bootstrap_draws(known, keys, id_col, reps, seed, partitions)
    return bootstrap_summary(replicate_statistics(draws, keys, observed, predicted), keys)


# Cumulative Poisson(1) probabilities, enough for 32-bit uniforms.
POISSON_CDF = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.9999988747974020,
    0.9999998885745217,
    0.9999999899522336,
    0.9999999991683890,
)


def poisson_weight(uniform: Column) -> Column:
    out = F.lit(0)
    for c in POISSON_CDF:
        out = out + (uniform >= F.lit(c)).cast("int")
    return out


#: Draws whose weights a task holds at a time, and the sums it keeps of a group and replicate.
HELD, SUMS = 1 << 22, ("n", "so", "sp", "soo", "spp", "sop", "see")


def poisson_weights(heads: list[str], ids: list[str], reps: int) -> np.ndarray:
    """poisson_weight of hash_hex(seed, *keys, block, id) for every row and replicate; heads are the texts before the block."""
    blocks = [f":{b}:".encode() for b in range((reps + 3) // 4)]
    digests = b"".join(md5(h + b + i).digest() for h, i in zip(map(str.encode, heads), map(str.encode, ids)) for b in blocks)
    numbers = np.frombuffer(digests, dtype=">u4").reshape(len(heads), -1)[:, :reps]
    return np.searchsorted(np.ceil(np.array(POISSON_CDF) * 2.0**32), numbers.astype(float), side="right").astype(float)


def _weighted_sums(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of each replicate; rows that it doesn't draw stay out, infinite ones, too."""
    finite = np.isfinite(values).all(axis=1)
    out = weights[finite].T @ values[finite]
    for w, v in zip(weights[~finite], values[~finite]):
        drawn = w > 0
        out[drawn] += w[drawn, None] * v
    return out


def _poisson_sums(n_keys: int, reps: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys..., rep, sums) of the rows (keys..., head, id, o, p, e) of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in range(n_keys)]
        _, first, group = np.unique(np.stack([*codes, np.zeros(batch.num_rows, int)], axis=1), axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        heads, ids = (batch.column(n_keys + k).to_pylist() for k in range(2))
        o, p, e = (batch.column(n_keys + 2 + k).to_numpy(zero_copy_only=False) for k in range(3))
        values = np.stack([np.ones(len(o)), o, p, o * o, p * p, o * p, e], axis=1)
        sums, step = np.zeros((len(first), reps, len(SUMS))), max(1, HELD // reps)
        for low in range(0, batch.num_rows, step):
            part = slice(low, low + step)
            weights = poisson_weights(heads[part], ids[part], reps)
            for g in np.unique(group[part]):
                mine = group[part] == g
                sums[g] += _weighted_sums(weights[mine], values[part][mine])
        at = pa.array(np.repeat(first, reps))
        columns = [*(batch.column(k).take(at) for k in range(n_keys)), pa.array(np.tile(np.arange(1, reps + 1, dtype=np.int32), len(first)))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in sums.reshape(-1, len(SUMS)).T.copy())], names=[*batch.schema.names[:n_keys], "rep", *SUMS])


def bootstrap_poisson(
    df: DataFrame, keys: list[str], id_col: str, observed: str, predicted: str, reps: int, seed: int = 1234,
    partitions: int | None = None,
) -> DataFrame:
    """Bootstrap for large groups: every row draws its own Poisson(1) multiplicity per replicate.

    No join and no index, and no row is repeated for its replicates: a task weighs each batch of rows for all replicates at once and
    reduces it to one partial sum per (group, replicate). Sums are taken around the group means to stay accurate. `partitions` as in bootstrap.
    """
    known = df.dropna(subset=[observed, predicted])
    centred = attach(known, keys, F.avg(observed).alias("__mo"), F.avg(predicted).alias("__mp"))
    if partitions:
        centred = centred.repartition(partitions)
    o, p = F.col(observed) - F.col("__mo"), F.col(predicted) - F.col("__mp")
    gap = F.col(observed) - F.col(predicted)
    numbers = [c.cast("double").alias(name) for c, name in ((o, "__o"), (p, "__p"), (gap * gap, "__e"))]
    rows = centred.select(*keys, hash_text(F.lit(str(seed)), *keys).alias("__head"), hash_text(id_col).alias("__id"), *numbers)
    schema = StructType([rows.schema[k] for k in keys]).add("rep", IntegerType())
    for name in SUMS:
        schema = schema.add(name, DoubleType())
    drawn = rows.mapInArrow(partial(_poisson_sums, len(keys), reps), schema)
    sums = drawn.groupBy(*keys, "rep").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in SUMS[1:]]).where("n > 0")
    n = F.col("n")
    cov = F.col("sop") - F.col("so") * F.col("sp") / n
    r2 = ratio(cov * cov, (F.col("soo") - F.col("so") ** 2 / n) * (F.col("spp") - F.col("sp") ** 2 / n))
    stats = sums.select(
        *keys,
        "rep",
        "n",
        F.sqrt(F.col("see") / n).alias("rmse"),
        (F.lit(1.0) - (F.lit(1.0) - r2) * ratio(n - 1, n - 2)).alias("adj_r2"),
    )
    return bootstrap_summary(stats, keys)
