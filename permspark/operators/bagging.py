"""Bagged forests whose bags are known: out-of-bag error, search for the subset size, permutation importance.

Spark's own forests draw their bags unseen. Here every (tree, row) draws how often the row counts from a hash of the row's key, so a bag is a
weight column. Trees are fitted one by one on those weights, several at a time, and rows that weigh nothing for a tree are its out-of-bag
rows, on any cluster and for any order of the rows. Votes are counted row by row, without a shuffle. A row's weights are drawn once and
stored beside its features: every pass of a fit, a vote or an exchange of values would draw them again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import hash_hex, hash_int
from permspark.operators.features import assembled
from permspark.operators.grouping import best_setting
from permspark.operators.models import SEED, dealt, forest
from permspark.operators.ordered import sequence_index
from permspark.sources.writers import staged

#: Cumulated Poisson probabilities with mean 1, as far as a hash of 32 bits can tell them apart.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]
#: Trees that vote in one pass over the rows, and trees that are fitted at a time.
VOTERS, FITTED_AT_ONCE = 25, 8


def bag_weight(tree: int, key: Sequence[str], seed: int = SEED) -> Column:
    """How often a row counts in a tree's bag: 0, 1, 2, ... with Poisson probabilities."""
    draw = hash_int(hash_hex(seed, F.lit(tree), *key)) / F.lit(2.0**32)
    # the lambda goes over the draw alone: over the probabilities, each would draw again
    return F.get(F.transform(F.array(draw), lambda u: sum(((u >= p).cast("int") for p in POISSON), F.lit(0))), F.lit(0))


@dataclass
class Bag:
    """Trees and their bags. `rows` holds key, label, features and `__bag`, the weights in all bags, stored in memory in an order of its own."""

    trees: list
    rows: DataFrame
    key: list[str]
    label: str
    classes: list[float] | None
    seed: int
    cols: list[str] = field(default_factory=list)

    def done(self) -> None:
        self.rows.unpersist()

    def blocks(self):
        """(tree numbers, models that write each into its own column)"""
        for k in range(0, len(self.trees), VOTERS):
            yield range(k, min(k + VOTERS, len(self.trees)))

    def predicted(self, df: DataFrame, numbers: Sequence[int], features: str = "features") -> DataFrame:
        """Adds `__p<tree>` and `__w<tree>`, a tree's prediction and the row's weight in its bag, to rows with `__bag`."""
        df = df.withColumns({f"__w{t}": F.get("__bag", F.lit(t)).cast("int") for t in numbers})
        for t in numbers:
            model = self.trees[t].copy()
            model.setFeaturesCol(features)
            model.setPredictionCol(f"__p{t}")
            if self.classes is not None:
                model.setRawPredictionCol("").setProbabilityCol("")
            df = model.transform(df)
        return df


def bag_rows(df: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], trees: int, seed: int) -> DataFrame:
    """The `rows` of a Bag."""
    bags = F.array(*[bag_weight(t, key, seed).cast("tinyint") for t in range(trees)]).alias("__bag")
    return assembled(dealt(df, cols, label), cols).select(*key, F.col(label).cast("double").alias(label), "features", bags).persist()


def fit_bag(
    df: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], classify: bool, trees: int = 500, depth: int = 10,
    mtry: int | None = None, seed: int = SEED, like: Bag | None = None,
) -> Bag:
    """Trees fitted on hash-drawn bags; rows need distinct keys, and no missing label or descriptor.

    `like` is an earlier result for the same rows, number of trees and seed: its rows and bags are shared.
    """
    cols, key = list(cols), list(key)
    rows = bag_rows(df, cols, label, key, trees, seed) if like is None else like.rows
    classes = sorted(r[0] for r in rows.select(label).distinct().collect()) if classify else None

    def fit(t: int):
        bag = rows.withColumn("__w", F.get("__bag", F.lit(t)).cast("double")).where(F.col("__w") > 0)
        one = forest(label, classify, 1, depth, mtry, seed + t, bootstrap=False, subsamplingRate=1.0, weightCol="__w")
        return one.fit(bag)

    pool = ThreadPool(min(FITTED_AT_ONCE, trees))
    try:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(trees), chunksize=1)
    finally:
        pool.close()
    return Bag(fitted, rows, key, label, classes, seed, cols)


def out_of_bag(bag: Bag) -> DataFrame:
    """(key..., label, n_trees, vote): trees that left the row out, and their majority (ties: the smallest class) or mean.

    A row that is in every bag has no vote.
    """
    kinds = bag.classes if bag.classes is not None else [None]
    votes = bag.rows.withColumn("__v", F.array(*[F.lit(0.0) for _ in kinds])).withColumn("n_trees", F.lit(0))
    for numbers in bag.blocks():
        met = bag.predicted(votes, numbers)
        out = {t: (F.col(f"__w{t}") == 0).cast("double") for t in numbers}
        count = sum((out[t] for t in numbers), F.lit(0.0)).cast("int")

        def gained(kind) -> Column:
            worth = (lambda p: p) if kind is None else (lambda p: (p == kind).cast("double"))
            return sum((out[t] * worth(F.col(f"__p{t}")) for t in numbers), F.lit(0.0))

        more = F.array(*[F.get("__v", F.lit(k)) + gained(kind) for k, kind in enumerate(kinds)])
        votes = staged(met.select(*bag.key, bag.label, "features", "__bag", more.alias("__v"), (F.col("n_trees") + count).alias("n_trees")))
    if bag.classes is None:
        vote = F.get("__v", F.lit(0)) / F.col("n_trees")
    else:
        vote = F.get(F.array(*[F.lit(c) for c in kinds]), (F.array_position("__v", F.array_max("__v")) - 1).cast("int"))
    return votes.select(*bag.key, bag.label, "n_trees", F.when(F.col("n_trees") > 0, vote).alias("vote"))


def out_of_bag_error(bag: Bag) -> float:
    """Share of wrong votes, or mean squared error, over the rows with a vote."""
    miss = F.col("vote") - F.col(bag.label)
    wrong = (miss != 0).cast("double") if bag.classes is not None else miss * miss
    return float(out_of_bag(bag).where("vote IS NOT NULL").select(F.avg(wrong)).first()[0])


def search_mtry(
    df: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], classify: bool, factor: float = 1.25, improve: float = 0.005, **kw
) -> DataFrame:
    """(mtry, error, step): subset sizes tried by out-of-bag error.

    From the usual start the size is divided, then multiplied, by `factor`, in either direction as long as the error falls by the
    share `improve` with each step. step is the order of the trials. All trials share the rows and their bags.
    """
    cols = list(cols)
    bags: list[Bag] = []
    errors: dict[int, float] = {}

    def error(mtry: int) -> float:
        if mtry not in errors:
            bag = fit_bag(df, cols, label, key, classify, mtry=mtry, like=bags[0] if bags else None, **kw)
            bags.append(bag)
            errors[mtry] = out_of_bag_error(bag)
        return errors[mtry]

    start = max(1, math.isqrt(len(cols)) if classify else len(cols) // 3)
    for smaller in (True, False):
        size, last = start, error(start)
        while True:
            size = max(1, math.ceil(size / factor)) if smaller else min(len(cols), math.floor(size * factor))
            if size in errors or last <= 0 or 1 - error(size) / last < improve:
                break
            last = errors[size]
    bags[0].done()
    rows = [(m, e, k) for k, (m, e) in enumerate(errors.items())]
    return df.sparkSession.createDataFrame(rows, "mtry int, error double, step int")


def best_mtry(tried: DataFrame) -> int:
    """Least error, the larger size among equals."""
    return int(best_setting(tried, "error", "mtry").first()["mtry"])


def donors(rows: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Every row with the features of another, drawn by hash: rows are numbered by two hashes, and equal numbers meet."""
    order = [[hash_hex(s, *key).alias(f"__h{s - seed}"), *key] for s in (seed, seed + 1)]
    numbered = []
    for s, cols in enumerate(order):
        data = rows.select("*", cols[0])
        numbered.append(sequence_index(data, [f"__h{s}", *key], out="__r").drop("n_total", f"__h{s}"))
    given = numbered[1].select(F.col("__r").alias("__n"), F.col("features").alias("__donor"))
    return numbered[0].join(given, F.col("__r") == F.col("__n")).drop("__r", "__n")


def permutation_importance(bag: Bag, seed: int = SEED) -> DataFrame:
    """(feature, loss, spread, score, rank): what out-of-bag accuracy a tree loses when one feature's values are moved between rows.

    Mean and standard deviation over the trees, and the mean by its standard error. For a regression the loss is the growth of the mean
    squared error. One feature at a time takes the value of the row's donor, so every (row, feature) is voted on once.
    """
    stored = staged(donors(bag.rows, bag.key, seed).select(*bag.key, bag.label, "__bag", vector_to_array("features").alias("__x"), vector_to_array("__donor").alias("__d")))
    plain = stored.withColumn("__j", F.lit(-1)).withColumn("features", array_to_vector("__x"))
    each = stored.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(bag.cols) - 1))).alias("__j"))
    moved = F.transform("__x", lambda x, i: F.when(i == F.col("__j"), F.get("__d", i)).otherwise(x))
    rows = plain.unionByName(each.withColumn("features", array_to_vector(moved))).select(*bag.key, bag.label, "__bag", "__j", "features")
    parts = []
    for numbers in bag.blocks():
        met = bag.predicted(rows, numbers)
        sums = []
        for t in numbers:
            miss = F.col(f"__p{t}") - F.col(bag.label)
            bad = (miss != 0).cast("double") if bag.classes is not None else miss * miss
            sums.append(F.avg(F.when(F.col(f"__w{t}") == 0, bad)).alias(f"__e{t}"))
        wide = met.groupBy("__j").agg(*sums)
        lists = F.array(*[F.struct(F.lit(t).alias("tree"), F.col(f"__e{t}").alias("error")) for t in numbers])
        parts.append(staged(wide.select("__j", F.inline(lists))))
    errors = parts[0]
    for part in parts[1:]:
        errors = errors.unionAll(part)
    base = errors.where("__j < 0").select("tree", F.col("error").alias("__base"))
    loss = errors.where("__j >= 0").join(base, "tree").select("__j", (F.col("error") - F.col("__base")).alias("loss"))
    done = loss.groupBy("__j").agg(F.avg("loss").alias("loss"), F.stddev_samp("loss").alias("spread"), F.count("loss").alias("n"))
    score = F.try_divide(F.col("loss"), F.col("spread") / F.sqrt("n"))
    table = [(r["__j"], r["loss"], r["spread"], r["score"]) for r in done.withColumn("score", score).collect()]  # a row for each feature
    table.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    ranked = [(bag.cols[j], a, s, z, k) for k, (j, a, s, z) in enumerate(table, 1)]
    return bag.rows.sparkSession.createDataFrame(ranked, "feature string, loss double, spread double, score double, rank int")
