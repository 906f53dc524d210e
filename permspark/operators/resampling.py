"""Bootstrap with exact multinomial counts, for many replicates of large groups.

A replicate of a group draws as many rows as the group has, with replacement. Instead of drawing them one by one, the draws are split: over the
two halves of the group's ranges of rows by a binomial, over the halves of a half, and so on down to one range; there they fall on its rows. Every split is
seeded by the group and the node, for all replicates at once. So each range finds its own share without hearing of the others, all shares add up to the
size of the group, and only partial sums of each range and replicate are shuffled, never rows times replicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from permspark.functions.distributions import t_p_value
from permspark.functions.scalar import hash_hex, number_text, ratio
from permspark.operators.grouping import attach
from permspark.operators.ordered import sequence_index

#: Rows of a range, and replicates whose counts are held at a time.
RANGE, AT_ONCE = 4096, 128
SUMS = ("n", "so", "sp", "soo", "spp", "sop", "see")


def share(seed: int, group: int, n: int, number: int, reps: int, size: int = RANGE) -> np.ndarray:
    """Draws of each replicate that fall on one range of a group of n rows."""
    low, high, count = 0, -(-n // size), np.full(reps, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = (middle - low) * size, min(high * size, n) - low * size
        first = np.random.default_rng([seed, group, low, high]).binomial(count, left / whole)
        low, high, count = (low, middle, first) if number < middle else (middle, high, count - first)
    return count


def range_sums(seed: int, group: int, n: int, number: int, values: np.ndarray, reps: int, size: int = RANGE) -> np.ndarray:
    """For each replicate the sums of the columns of `values`, weighted by how often the rows of the range are drawn."""
    count, m, out = share(seed, group, n, number, reps, size), len(values), np.empty((reps, values.shape[1]))
    random = np.random.default_rng([seed, group, number, number])
    for k in range(0, reps, AT_ONCE):
        part = count[k : k + AT_ONCE]
        drawn = random.integers(0, m, size=int(part.sum())) + np.repeat(np.arange(len(part)) * m, part)
        out[k : k + AT_ONCE] = np.bincount(drawn, minlength=len(part) * m).reshape(len(part), m) @ values
    return out


def _partial_sums(seed: int, reps: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each range and replicate, from rows (group, range, n, o, p, e) sorted by group and range; ranges may span batches."""
    held: list[np.ndarray] = []
    key = None

    def done():
        group, number, n = key
        o, p, e = np.concatenate(held).T
        values = np.stack([np.ones(len(o)), o, p, o * o, p * p, o * p, e], axis=1)
        sums = range_sums(seed, int(group, 16), n, number, values, reps, size)
        columns = [pa.array([group] * reps), pa.array(np.arange(1, reps + 1, dtype=np.int32)), *(pa.array(c) for c in sums.T.copy())]
        return pa.RecordBatch.from_arrays(columns, names=["__g", "rep", *SUMS])

    for batch in batches:
        groups, numbers, totals = (batch.column(k).to_pylist() for k in range(3))
        values = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], axis=1) if batch.num_rows else None
        start = 0
        for k in range(1, batch.num_rows + 1):
            if k < batch.num_rows and groups[k] == groups[start] and numbers[k] == numbers[start]:
                continue
            now = (groups[start], numbers[start], totals[start])
            if held and now != key:
                yield done()
                held = []
            key, start_, start = now, start, k
            held.append(values[start_:k])
    if held:
        yield done()


def bootstrap_split(
    df: DataFrame, keys: list[str], id_col: str, observed: str, predicted: str, reps: int = 10_000, seed: int = 1234, size: int = RANGE
) -> DataFrame:
    """(keys, n, replicates, r2_low, r2_median, r2_high, p_median, rmse_median) of obs ~ pred over the replicates.

    R2 is adjusted; its interval holds 95 % of the replicates. p_median is the p-value of the slope at the median R2: it falls as R2
    grows, so this is the median of the replicates' p-values. Rows with a missing value are left out; a replicate without spread has no R2.
    """
    known = df.dropna(subset=[observed, predicted])
    centred = attach(known, keys, F.avg(observed).alias("__mo"), F.avg(predicted).alias("__mp"))
    numbered = sequence_index(centred, [id_col, observed, predicted], keys=keys, out="__pos")
    gap = F.col(observed) - F.col(predicted)
    o, p = F.col(observed) - F.col("__mo"), F.col(predicted) - F.col("__mp")
    group = F.substring(hash_hex(seed, *keys), 1, 16).alias("__g")
    number = F.floor((F.col("__pos") - 1) / size).cast("int").alias("__range")
    rows = numbered.select(*keys, group, number, F.col("n_total").alias("__n"), *[c.cast("double").alias(f"__{i}") for i, c in enumerate((o, p, gap * gap))])
    ranged = rows.drop(*keys).repartition("__g", "__range").sortWithinPartitions("__g", "__range")
    schema = "__g string, rep int, " + ", ".join(f"{s} double" for s in SUMS)
    sums = ranged.mapInArrow(partial(_partial_sums, seed, reps, size), schema).groupBy("__g", "rep").agg(*[F.sum(s).alias(s) for s in SUMS])
    n = F.col("n")
    cov, vo, vp = (F.col(a) - F.col(b) * F.col(c) / n for a, b, c in (("sop", "so", "sp"), ("soo", "so", "so"), ("spp", "sp", "sp")))
    r2 = ratio(cov * cov, vo * vp)
    each = sums.select("__g", n, F.sqrt(F.col("see") / n).alias("rmse"), r2.alias("r2"), (1 - (1 - r2) * ratio(n - 1, n - 2)).alias("adj_r2"))
    found = each.groupBy("__g").agg(
        F.max("n").cast("long").alias("n"), F.count("*").alias("replicates"), F.percentile("adj_r2", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("__q"),
        F.percentile("r2", F.lit(0.5)).alias("__r2"), F.percentile("rmse", F.lit(0.5)).alias("rmse_median"),
    )
    t = F.sqrt(ratio(F.col("__r2") * (n - 2), 1 - F.col("__r2")))
    found = found.withColumn("p_median", F.when(F.col("__r2") >= 1, F.lit(0.0)).otherwise(t_p_value(t, n - 2)))
    ends = [F.get("__q", F.lit(i)).alias(c) for i, c in enumerate(("r2_low", "r2_median", "r2_high"))]
    named = known.select(*keys).distinct().withColumn("__g", group)
    out = named.join(found.select("__g", "n", "replicates", *ends, "p_median", "rmse_median"), "__g")
    return out.drop("__g")


def evaluation_report(summary: DataFrame, evaluation: str, subset: str, digits: int = 2) -> DataFrame:
    """(evaluation, n, r2, r2_range, rmse, rmse_low, rmse_high) as texts with significant digits, from rows for the subsets all, low and high."""

    def of(name: str, column: str):
        return F.max(F.when(F.col(subset) == name, F.col(column)))

    wide = summary.groupBy(evaluation).agg(
        of("all", "n").alias("n"), *[of("all", c).alias(c) for c in ("r2_low", "r2_median", "r2_high")],
        *[of(s, "rmse_median").alias(f"rmse_{s}") for s in ("all", "low", "high")],
    )
    text = {c: number_text(c, digits) for c in wide.columns if c not in (evaluation, "n")}
    spread = F.concat(text["r2_low"], F.lit(" - "), text["r2_high"])
    return wide.select(
        evaluation, "n", text["r2_median"].alias("r2"), spread.alias("r2_range"), text["rmse_all"].alias("rmse"), text["rmse_low"].alias("rmse_low"), text["rmse_high"].alias("rmse_high")
    )
