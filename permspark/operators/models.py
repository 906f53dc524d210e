"""Random-forest modelling on Spark ML: tuning, elimination, scoring and quantile forests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.functions.scalar import hash_hex, hash_int, row_missing
from permspark.operators.features import assembled
from permspark.operators.grouping import best_setting, top_k
from permspark.operators.ordered import sequence_index, spread
from permspark.sources.writers import staged

SEED = 12345


def forest(label: str, classify: bool, trees: int = 100, depth: int = 10, mtry: int | None = None, seed: int = SEED, **kw):
    cls = RandomForestClassifier if classify else RandomForestRegressor
    subset = "auto" if mtry is None else str(mtry)
    return cls(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, seed=seed, **kw
    )


def evaluator(label: str, classify: bool):
    if classify:
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return RegressionEvaluator(labelCol=label, metricName="rmse")


#: Training rows for each partition. Bagging draws by partition, so their number follows the data, not the cluster.
ROWS_PER_PART = 200_000


def dealt(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Rows in partitions and an order that depend on the rows alone, so that a seed gives the same forest on any cluster."""
    parts = 8 + df.count() // ROWS_PER_PART
    return df.repartition(parts, *cols, label).sortWithinPartitions(*cols, label)


def fit_forest(df: DataFrame, cols: Sequence[str], label: str, classify: bool, **kw):
    return forest(label, classify, **kw).fit(assembled(dealt(df, cols, label), cols))


def fold_column(key, folds: int, repeat: int, seed: int = SEED) -> Column:
    """Fold number from a hash of the row key, a new allocation for every repeat."""
    return (hash_int(hash_hex(seed + repeat, *key)) % folds).cast("int")


def mtry_grid(n_features: int, classify: bool, factor: float = 1.25, steps: int = 2) -> list[int]:
    """Candidate subset sizes around the usual start value."""
    start = max(1, int(n_features**0.5))
    sizes = {start}
    up = down = start
    for _ in range(steps):
        up = min(n_features, max(up + 1, int(-(-up * factor // 1))))
        down = max(1, min(down - 1, int(down / factor)))
        sizes |= {up, down}
    return sorted(sizes)


def repeated_cv(
    df: DataFrame, cols, label: str, key, classify: bool, mtry: Sequence[int], folds: int = 5, repeats: int = 10, **kw
) -> DataFrame:
    """Mean cross-validated metric per subset size: (mtry, metric, error); the same however the rows are partitioned."""
    spark = df.sparkSession
    data = assembled(dealt(df, cols, label), cols).persist()
    try:
        totals = {m: 0.0 for m in mtry}
        for repeat in range(repeats):
            folded = data.withColumn("__fold", fold_column(key, folds, repeat))
            est = forest(label, classify, **kw)
            grid = ParamGridBuilder().addGrid(est.featureSubsetStrategy, [str(m) for m in mtry]).build()
            cv = CrossValidator(
                estimator=est, estimatorParamMaps=grid, evaluator=evaluator(label, classify), numFolds=folds,
                foldCol="__fold", parallelism=4,
            )
            for m, v in zip(mtry, cv.fit(folded).avgMetrics):
                totals[m] += v / repeats
    finally:
        data.unpersist()
    rows = [(int(m), float(v), float(1 - v if classify else v)) for m, v in totals.items()]
    return spark.createDataFrame(rows, "mtry int, metric double, error double")


def tune_mtry(results: DataFrame) -> int:
    """Least error, the larger size among equals."""
    return int(best_setting(results, "error", "mtry").first()["mtry"])


def importance_rows(model, cols) -> list[tuple[str, float]]:
    return [(c, float(s)) for c, s in zip(cols, model.featureImportances.toArray())]


def importance_table(spark, model, cols) -> DataFrame:
    ranked = sorted(importance_rows(model, cols), key=lambda r: (-r[1], r[0]))
    rows = [(c, s, i) for i, (c, s) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "feature string, score double, rank int")


def eliminate_features(
    df: DataFrame, cols, label: str, key, classify: bool, sizes: Sequence[int], folds: int = 5, repeats: int = 1, **kw
) -> tuple[DataFrame, DataFrame]:
    """Recursive elimination with re-ranking inside each resample.

    Returns the metric per size (size, metric, error) and the scores kept at every size
    (size, resample, feature, score).
    """
    spark, cols = df.sparkSession, list(cols)
    sizes = sorted({min(s, len(cols)) for s in sizes} | {len(cols)}, reverse=True)
    data = df.persist()
    metrics: list[tuple[int, int, float]] = []
    scores: list[tuple[int, int, str, float]] = []
    ev = evaluator(label, classify)
    try:
        for repeat in range(repeats):
            folded = data.withColumn("__fold", fold_column(key, folds, repeat))
            for fold in range(folds):
                train, held = folded.where(F.col("__fold") != fold), folded.where(F.col("__fold") == fold)
                resample, current = repeat * folds + fold, cols
                for size in sizes:
                    if size < len(current):
                        current = [c for c, _ in sorted(ranked, key=lambda r: (-r[1], r[0]))[:size]]
                    model = fit_forest(train, current, label, classify, **kw)
                    ranked = importance_rows(model, current)
                    metrics.append((size, resample, float(ev.evaluate(model.transform(assembled(held, current))))))
                    scores += [(size, resample, c, s) for c, s in ranked]
    finally:
        data.unpersist()
    table = spark.createDataFrame(metrics, "size int, resample int, metric double")
    mean = table.groupBy("size").agg(F.avg("metric").alias("metric"))
    mean = mean.withColumn("error", F.lit(1.0) - F.col("metric") if classify else F.col("metric"))
    return mean, spark.createDataFrame(scores, "size int, resample int, feature string, score double")


def chosen_features(scores: DataFrame, size: int) -> DataFrame:
    """Top features by mean score over the resamples of one size."""
    mean = scores.where(F.col("size") == size).groupBy("feature").agg(F.avg("score").alias("score"))
    return top_k(mean, "score", size, "feature")


def score_complete(model, df: DataFrame, cols, key: str, requested: DataFrame | None = None) -> DataFrame:
    """Predictions aligned to the requested ids; rows with a missing descriptor get NULL.

    Incomplete rows are scored like the others and blanked afterwards: a filter over hundreds of
    descriptor columns would cost the optimizer far more than the few wasted predictions.
    """
    ready = df.withColumn("__missing", row_missing(cols))
    scored = model.transform(assembled(ready, cols, invalid="keep"))
    guarded = F.when(F.col("__missing") == 0, F.col(model.getPredictionCol())).alias("prediction")
    out = scored.select(key, guarded)
    return out if requested is None else requested.select(key).join(out, key, "left")


def class_boundaries(value, low_max: Column, mid_max: Column) -> Column:
    """Regression output to three classes by the upper ends of the lower classes."""
    return F.when(value < low_max, F.lit(1)).when(value < mid_max, F.lit(2)).otherwise(F.lit(3))


def outer_classes(value, low_max: Column, high_min: Column) -> Column:
    """Regression output to three classes by the inner ends of the outer classes; where they overlap the lower class wins."""
    return F.when(value < low_max, F.lit(1)).when(value > high_min, F.lit(3)).otherwise(F.lit(2))


# --- quantile forest --------------------------------------------------------------------------------


def leaf_rows(model, df: DataFrame, cols, keep: list[str]) -> DataFrame:
    """(keep..., tree, leaf) for every tree of the forest."""
    model = model.copy()
    model.setLeafCol("__leaf")
    leaves = vector_to_array("__leaf")
    return model.transform(assembled(df, cols)).select(*keep, F.posexplode(leaves).alias("tree", "leaf"))


RADIX = 32


def quantile_forest(model, train: DataFrame, new: DataFrame, cols, label: str, key: str, probs: dict[str, float]) -> DataFrame:
    """Weighted training quantiles: a training value weighs 1 / leaf size in each tree it shares.

    Training rows are reduced to (tree, leaf, value) shares. A new row never meets all values of its leaves: every quantile's rank among
    the training values is found one base-32 digit at a time. Per level a (row, probability) meets at most 32 digit totals per tree,
    whatever the leaf sizes. Weights are relative to the row's leaves that hold training rows; a row without any is left out.
    """
    train = train.where(F.col(label).isNotNull())
    cells = staged(leaf_rows(model, train, cols, [label]).groupBy("tree", "leaf", label).agg(F.count("*").alias("n")))
    sizes = cells.groupBy("tree", "leaf").agg(F.sum("n").alias("size"))
    shares = staged(cells.join(sizes, ["tree", "leaf"]).select("tree", "leaf", label, (F.col("n") / F.col("size")).alias("w")))
    leaves = leaf_rows(model, new, cols, [key]).join(sizes.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    leaves = staged(leaves.select(key, "tree", "leaf"))
    ranks = staged(sequence_index(shares.select(label).distinct(), [label], out="__r").select(label, (F.col("__r") - 1).alias("__r")))
    top = ranks.agg(F.max("__r")).first()[0] or 0
    levels = 1
    while RADIX**levels <= top:
        levels += 1
    coded = staged(shares.join(ranks, label).select("tree", "leaf", "__r", "w"))
    weight = leaves.groupBy(key).agg(F.count("*").cast("double").alias("weight"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) - 1e-9).alias("p")) for n, p in probs.items()])
    state = weight.select(key, "weight", F.inline(wanted)).select(key, "name", (F.col("p") * F.col("weight")).alias("goal")).withColumns(
        {"prefix": F.lit(0).cast("bigint"), "before": F.lit(0.0)}
    )
    for level in range(levels):
        unit = RADIX ** (levels - 1 - level)
        code = F.floor(F.col("__r") / F.lit(unit))
        totals = coded.groupBy("tree", "leaf", F.floor(code / RADIX).alias("prefix"), (code % RADIX).alias("digit")).agg(
            F.sum("w").alias("w")
        )
        met = leaves.join(state, key).join(spread(totals, ["tree", "leaf", "prefix"]), ["tree", "leaf", "prefix"])
        digits = met.groupBy(key, "name", "goal", "prefix", "before", "digit").agg(F.sum("w").alias("w"))
        run = Window.partitionBy(key, "name").orderBy("digit")
        upto = F.col("before") + F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0))
        reached = digits.withColumn("upto", upto).withColumn(
            "last", F.max("digit").over(Window.partitionBy(key, "name"))
        ).where((F.col("upto") >= F.col("goal")) | (F.col("digit") == F.col("last")))
        chosen = reached.groupBy(key, "name", "goal").agg(
            F.min_by(F.struct("prefix", "digit", (F.col("upto") - F.col("w")).alias("before")), "digit").alias("c")
        )
        state = staged(
            chosen.select(key, "name", "goal", (F.col("c.prefix") * RADIX + F.col("c.digit")).alias("prefix"), F.col("c.before").alias("before"))
        )
    values = state.join(ranks, state["prefix"] == ranks["__r"])
    return values.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col(label))).alias(n) for n in probs])
