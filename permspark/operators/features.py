"""Descriptor screening, imputation, rank correlation, binning and the applicability domain."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.functions.distributions import normal_two_sided
from permspark.functions.scalar import cut_index, ratio
from permspark.operators.grouping import column_statistics, keep_first
from permspark.operators.ordered import quantiles


# --- tables of descriptors -----------------------------------------------------------------------


def wide_descriptors(df: DataFrame, array_col: str, n: int, prefix: str, keep: list[str]) -> DataFrame:
    """Array of descriptors to one double column each."""
    return df.select(*keep, *[F.get(array_col, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)])


def combine_descriptors(first: DataFrame, second: DataFrame, key: str, required: str, order_cols, suffix: str) -> DataFrame:
    """Two descriptor sets per key: names of the first win, the second is reduced to one row per key.

    Rows of the first need a value in `required`; the second's own columns carry the suffix.
    """
    own = [c for c in second.columns if c != key and c not in first.columns]
    one = keep_first(second, [key], order_cols).select(key, *[F.col(c).alias(f"{c}{suffix}") for c in own])
    return first.where(F.col(required).isNotNull()).join(one, key)


# --- screening -----------------------------------------------------------------------------------


def information_table(df: DataFrame, cols, min_cv: float = 0.05) -> DataFrame:
    """Per column: count, range, mean, sd and whether it carries too little information.

    Columns become rows first: each task then reduces its part to one small row per column, and the
    plan stays the same size for a thousand descriptors.
    """
    rows = column_statistics(df, cols)
    low = (
        (F.col("n") == 0)
        | (F.col("lo") == F.col("hi"))
        | F.col("sd").isNull()
        | F.coalesce(F.abs(ratio("sd", "mean")) < F.lit(min_cv), F.lit(False))
    )
    return rows.withColumn("low_information", low)


def low_information(df: DataFrame, cols, min_cv: float = 0.05) -> list[str]:
    return [r["column"] for r in information_table(df, cols, min_cv).where("low_information").select("column").collect()]


def near_zero_variance(df: DataFrame, cols, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """Per column: ratio of the two commonest values and percent of distinct values."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    counts = doubles.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    top = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rn", F.row_number().over(top)).where("rn <= 2")
    lead = best.groupBy("column").agg(
        F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("rn") == 2, F.col("n"))).alias("n2")
    )
    spread = counts.groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"))
    freq = F.coalesce(ratio("n1", "n2"), F.lit(0.0))
    share = ratio("distinct", "rows") * 100
    return spread.join(lead, "column").select(
        "column", freq.alias("freq_ratio"), share.alias("percent_unique"),
        ((F.col("distinct") == 1) | ((freq > freq_cut) & (share <= unique_cut))).alias("near_zero"),
    )


@dataclass(frozen=True)
class Profile:
    """Training mean and sd per column; a handful of numbers, kept on the driver."""

    mean: dict[str, float]
    sd: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols) -> "Profile":
        rows = column_statistics(df, cols).collect()
        return cls({r["column"]: r["mean"] for r in rows}, {r["column"]: r["sd"] for r in rows})


def impute(df: DataFrame, profile: Profile, cols=None) -> DataFrame:
    """Missing values become the training mean."""
    cols = cols or list(profile.mean)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(profile.mean[c])) for c in cols})


def assembled(df: DataFrame, cols, out: str = "features", invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=invalid).transform(df)


def correlation_matrix(df: DataFrame, cols, method: str = "spearman") -> np.ndarray:
    """k x k matrix; ranks and products are computed on the cluster, only the matrix comes back."""
    vectors = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    return Correlation.corr(vectors, "v", method).first()[0].toArray()


def correlation_pairs(df: DataFrame, cols, method: str = "spearman") -> DataFrame:
    cols = list(cols)
    m = correlation_matrix(df, cols, method)
    rows = [(cols[i], cols[j], float(m[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def redundant_columns(matrix: np.ndarray, names, cutoff: float = 0.9) -> list[str]:
    """Of each pair above the cut-off drop the column that correlates more with the rest.

    Columns are visited from the highest mean |rho| down, and means are refreshed after each drop.
    The input is the k x k matrix, so this is a short driver step.
    """
    rho = np.abs(np.asarray(matrix, dtype=float)).copy()
    np.fill_diagonal(rho, np.nan)
    order = sorted(range(len(names)), key=lambda i: (-np.nanmean(rho[i]), i))
    live = set(order)
    for a, i in enumerate(order):
        for j in order[a + 1:]:
            if i not in live:
                break
            if j not in live or not rho[i, j] > cutoff:
                continue
            alive = sorted(live)
            mean_i = np.nanmean(rho[i, alive])
            others = [k for k in alive if k != j]
            mean_rest = np.nanmean(rho[np.ix_(others, alive)])
            live.discard(i if mean_i > mean_rest else j)
    return [names[i] for i in range(len(names)) if i not in live]


def significant_columns(df: DataFrame, cols, label: str, p: float = 0.1, categorical: bool = False) -> list[str]:
    """Univariate screening by false-positive rate."""
    cols = list(cols)
    selector = UnivariateFeatureSelector(featuresCol="__f", outputCol="__s", labelCol=label, selectionMode="fpr")
    selector.setFeatureType("continuous").setLabelType("categorical" if categorical else "continuous")
    model = selector.setSelectionThreshold(p).fit(assembled(df, cols, "__f"))
    return [cols[i] for i in model.selectedFeatures]


#: Newton steps at most, and the change of the coefficients at which a model is settled.
NEWTON, SETTLED = 30, 1e-10


def univariate_logistic(df: DataFrame, cols, label: str) -> DataFrame:
    """(column, n, intercept, slope, se, z, p_value, separated): a logistic model of a 0/1 label on each column alone.

    Columns become rows, so that one aggregate a Newton step moves all models on: five sums per column, and the few coefficients come back
    as a small table. Columns are standardised on the way. A column whose classes don't overlap is `separated`: its slope has no finite
    estimate, and it counts as significant (p = 0). A constant column, or one that meets one class only, has no model (NULL).
    """
    cols, spark = list(cols), df.sparkSession
    cells = F.array(*[F.struct(F.lit(i).alias("__i"), F.col(c).cast("double").alias("__x")) for i, c in enumerate(cols)])
    rows = df.select(F.col(label).cast("double").alias("__y"), F.inline(cells)).where("__x IS NOT NULL AND NOT isnan(__x) AND __y IS NOT NULL")
    ends = [f(F.when(F.col("__y") == y, F.col("__x"))).alias(f"{n}{y}") for y in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))]
    shape = rows.groupBy("__i").agg(F.count("*").alias("n"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("sd"), *ends).collect()
    split = {r["__i"] for r in shape if r.sd and None not in (r.lo0, r.lo1) and (r.hi0 <= r.lo1 or r.hi1 <= r.lo0)}
    open_ = {r["__i"]: (0.0, 0.0) for r in shape if r.sd and None not in (r.lo0, r.lo1) and r["__i"] not in split}
    scale, fitted = {r["__i"]: (r.mean, r.sd) for r in shape}, {}
    for _ in range(NEWTON):
        if not open_:
            break
        state = spark.createDataFrame([(i, a, b, *scale[i]) for i, (a, b) in open_.items()], "__j int, __a double, __b double, __m double, __s double")
        met = rows.join(F.broadcast(state), F.col("__i") == F.col("__j"))  # a row for each column
        x = (F.col("__x") - F.col("__m")) / F.col("__s")
        met = met.select("__i", "__y", x.alias("x"), (F.lit(1.0) / (1 + F.exp(-(F.col("__a") + F.col("__b") * x)))).alias("p"))
        w, e = F.col("p") * (1 - F.col("p")), F.col("__y") - F.col("p")
        sums = met.groupBy("__i").agg(
            F.sum(e).alias("g0"), F.sum(e * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11")
        )
        for r in sums.collect():  # a row for each column
            i, det = r["__i"], r.h00 * r.h11 - r.h01**2
            a, b = open_[i]
            da, db = (r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det
            open_[i] = (a + da, b + db)
            if max(abs(da), abs(db)) < SETTLED:
                fitted[i] = (*open_.pop(i), (r.h00 / det) ** 0.5)
    out = []
    for r in sorted(shape, key=lambda r: r["__i"]):
        i, (mean, sd) = r["__i"], scale[r["__i"]]
        a, b, se = fitted.get(i, (None, None, None))
        model = (a - b * mean / sd, b / sd, se / sd, b / se) if se else (None, None, None, None)
        out.append((cols[i], r.n, *model, i in split))
    table = spark.createDataFrame(out, "column string, n long, intercept double, slope double, se double, z double, separated boolean")
    p = F.when(F.col("separated"), F.lit(0.0)).otherwise(normal_two_sided(F.col("z")))
    return table.withColumn("p_value", p)


def logistic_screen(df: DataFrame, cols, label: str, p: float = 0.1) -> list[str]:
    """Columns related to a 0/1 label at p, each by a logistic model of its own."""
    kept = {r["column"] for r in univariate_logistic(df, cols, label).where(F.col("p_value") < p).collect()}
    return [c for c in cols if c in kept]


# --- binning ---------------------------------------------------------------------------------------


def equal_frequency_cuts(df: DataFrame, value: str, bins) -> dict[int, list[float]]:
    """Interior quantile cut points for each number of bins; one pass, a few numbers to the driver."""
    probs = {f"q{k}_{i}": i / k for k in bins for i in range(1, k)}
    row = quantiles(df, [], value, probs).first()
    return {k: [row[f"q{k}_{i}"] for i in range(1, k)] for k in bins}


def equal_frequency_bins(df: DataFrame, value: str, bins, prefix: str = "bin") -> DataFrame:
    """A quantile bin column per number of bins; equal values always share a bin."""
    cuts = equal_frequency_cuts(df, value, bins)
    return df.withColumns({f"{prefix}{k}": cut_index(value, c) for k, c in cuts.items()})


def cluster_cuts(df: DataFrame, value: str, bins, iterations: int = 20) -> dict[int, list[float]]:
    """1-D k-means for each number of bins; cut points halfway between neighbouring centres.

    Centres start at equally spaced exact quantiles, and each round is one aggregate over the distinct values with their counts, so
    the cuts don't depend on how the rows are partitioned. A cluster that loses its values keeps its centre.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    known = known.persist()
    try:
        start = quantiles(df, [], value, {f"q{k}_{i}": (2 * i + 1) / (2 * k) for k in bins for i in range(k)}).first()
        if start is None:
            return {k: [] for k in bins}
        centres = {k: [float(start[f"q{k}_{i}"]) for i in range(k)] for k in bins}
        for _ in range(iterations):
            cuts = {k: [(a + b) / 2 for a, b in zip(c, c[1:])] for k, c in centres.items()}
            sums = []
            for k, c in cuts.items():
                for i in range(k):
                    here = cut_index("__v", c) == i + 1
                    sums += [F.sum(F.when(here, F.col("__v") * F.col("__n"))).alias(f"s{k}_{i}"), F.sum(F.when(here, F.col("__n"))).alias(f"n{k}_{i}")]
            row = known.agg(*sums).first()
            moved = {k: [row[f"s{k}_{i}"] / row[f"n{k}_{i}"] if row[f"n{k}_{i}"] else c[i] for i in range(k)] for k, c in centres.items()}
            still = all(abs(a - b) <= 1e-9 * max(1.0, abs(a)) for k in centres for a, b in zip(centres[k], moved[k]))
            centres = {k: sorted(c) for k, c in moved.items()}
            if still:
                break
    finally:
        known.unpersist()
    return {k: [(a + b) / 2 for a, b in zip(c, c[1:])] for k, c in centres.items()}


# --- applicability domain -----------------------------------------------------------------------------


def applicability(df: DataFrame, cols, profile: Profile, limit: float = 3.0, z: float = 1.28, out: str = "in_domain") -> DataFrame:
    """Standardised-descriptor rule: 1 inside the training domain, 0 outside.

    In when no descriptor is extreme, out when all are, otherwise by mean + z * sd of the
    standardised distances. A descriptor that is constant in training is extreme wherever it differs. A row with a
    missing descriptor has neither score nor domain.
    """
    far = float("inf")

    def gap(c) -> Column:
        off = F.abs(F.col(c) - F.lit(profile.mean[c]))
        return F.when(off > 0, F.lit(far)).otherwise(off) if profile.sd[c] == 0 else off / F.lit(profile.sd[c])

    gaps = F.array(*[gap(c) for c in cols])
    k = float(len(cols))
    scored = df.withColumn("__s", gaps).withColumn("__mean", F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / k)
    squares = F.aggregate("__s", F.lit(0.0), lambda a, x: a + (x - F.col("__mean")) * (x - F.col("__mean")))
    scored = scored.withColumns(
        {"__max": F.array_max("__s"), "__min": F.array_min("__s"), "__sd": F.sqrt(ratio(squares, F.lit(k - 1)))}
    )
    known = ~F.exists("__s", lambda x: x.isNull())
    mixed = F.when(F.col("__max") == far, F.lit(far)).otherwise(F.col("__mean") + F.lit(z) * F.col("__sd"))
    mixed = F.when(known, mixed)
    inside = (
        F.when(~known, F.lit(None).cast("int"))
        .when(F.col("__max") <= limit, F.lit(1))
        .when(F.col("__min") > limit, F.lit(0))
        .when(mixed <= limit, F.lit(1))
        .otherwise(F.lit(0))
    )
    return scored.withColumn("domain_score", mixed).withColumn(out, inside).drop("__s", "__mean", "__max", "__min", "__sd")
