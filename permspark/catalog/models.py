"""Model queries on `embeddings`: the target is built from some descriptors and, as noise, element 0; the rest are descriptors.

Forests have no SQL twin; they are seeded and checked for shape, quantile forests, bags and importances also against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, rounded, table
from permspark.catalog.basics import sql_signif
from permspark.catalog.features import descriptors
from permspark.functions import scalar as S
from permspark.operators import bagging as B
from permspark.operators import models as M
from permspark.operators import stats as T
from permspark.plans import modelling as P
from permspark.sources.writers import staged

COLS = [f"d{i}" for i in range(1, 64)]
#: The target: one strong, one weaker and two joint descriptors; the classes are about thirds.
TARGET = "2 * d1 - d2 + 8 * d3 * d4 + 0.3 * d0"
CLASS_CUTS = (-0.13, 0.13)
FOREST = {"trees": 20, "depth": 5}


def _data(spark, sf) -> DataFrame:
    """Descriptors, a three-class label and a test flag (one row in five)."""
    df = descriptors(spark, sf)
    fold = S.hash_int(S.hash_hex(11, "vec_id")) % 5
    target = F.expr(TARGET)
    df = df.withColumns({"t": target, "y": (S.cut_index(target, CLASS_CUTS) - 1).cast("double"), "test": (fold == 0).cast("int")})
    # stored once, because every fit reads it again; a small input is spread over the cores first
    return staged(df.repartition(spark.sparkContext.defaultParallelism))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("test = 0"), df.where("test = 1")


@query("rf_class_eval")
def rf_class_eval(spark, sf) -> DataFrame:
    """Hold-out accuracy and kappa of a classification forest."""
    train, test = _split(_data(spark, sf))
    model = M.fit_forest(train, COLS, "y", True, **FOREST)
    scored = M.score_complete(model, test, COLS, "vec_id").join(test.select("vec_id", "y"), "vec_id")
    return T.class_agreement(scored, "prediction", "y")


@query("rf_reg_eval")
def rf_reg_eval(spark, sf) -> DataFrame:
    """Hold-out agreement of a regression forest."""
    train, test = _split(_data(spark, sf))
    model = M.fit_forest(train, COLS, "t", False, **FOREST)
    scored = M.score_complete(model, test, COLS, "vec_id").join(test.select("vec_id", "t"), "vec_id")
    return T.agreement(scored, "prediction", "t")


@query("cv_tuning")
def cv_tuning(spark, sf) -> DataFrame:
    """Cross-validated error per number of candidate columns, best one flagged."""
    out = M.repeated_cv(_data(spark, sf), COLS, "y", ["vec_id"], True, M.mtry_grid(len(COLS), True, steps=1), 3, 1, trees=10, depth=4)
    return out.withColumn("best", F.col("mtry") == M.tune_mtry(out))


def _elimination(spark, sf):
    return M.eliminate_features(_data(spark, sf), COLS, "y", ["vec_id"], True, [4, 12], 2, 1, trees=10, depth=4)


@query("rfe_path")
def rfe_path(spark, sf) -> DataFrame:
    """Metric per number of descriptors along the elimination path."""
    return _elimination(spark, sf)[0]


@query("rfe_features")
def rfe_features(spark, sf) -> DataFrame:
    """Descriptors chosen by mean importance over the resamples."""
    return M.chosen_features(_elimination(spark, sf)[1], 12)


@query("feature_importance")
def feature_importance(spark, sf) -> DataFrame:
    model = M.fit_forest(_data(spark, sf), COLS, "y", True, **FOREST)
    return M.importance_table(spark, model, COLS)


_WEIGHT_SQL = "(SELECT sum((u >= p)::INT) FROM unnest([{}]) x(p))".format(", ".join(map(repr, B.POISSON)))


@query(
    "bag_weights",
    f"""WITH draws AS (SELECT vec_id, tree, ('0x' || substr(md5('{M.SEED}:' || tree || ':' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM embeddings, range(0, 40) t(tree)),
    weighed AS (SELECT vec_id, tree, {_WEIGHT_SQL} AS w FROM draws)
    SELECT vec_id, sum(w)::BIGINT AS in_bags, count_if(w = 0)::BIGINT AS n_out, max(w)::INTEGER AS most FROM weighed GROUP BY vec_id""",
)
def bag_weights(spark, sf) -> DataFrame:
    """How often each row is drawn for 40 bags, and how many leave it out."""
    each = table(spark, sf, "embeddings").select("vec_id", F.array(*[B.bag_weight(t, ["vec_id"]) for t in range(40)]).alias("w"))
    total = F.aggregate("w", F.lit(0), lambda a, x: a + x).cast("long")
    return each.select("vec_id", total.alias("in_bags"), F.size(F.filter("w", lambda x: x == 0)).cast("long").alias("n_out"), F.array_max("w").alias("most"))


@query("oob_votes")
def oob_votes(spark, sf) -> DataFrame:
    """Each row's majority among the trees whose bags left it out."""
    bag = B.fit_bag(_data(spark, sf), COLS, "y", ["vec_id"], True, trees=20, depth=8)
    return B.out_of_bag(bag)


@query("mtry_search")
def mtry_search(spark, sf) -> DataFrame:
    """Subset sizes by out-of-bag error, as long as it falls; the best one flagged."""
    tried = B.search_mtry(_data(spark, sf), COLS, "y", ["vec_id"], True, trees=20, depth=8)
    return tried.withColumn("best", F.col("mtry") == B.best_mtry(tried))


@query("permutation_importance")
def permutation_importance(spark, sf) -> DataFrame:
    """Out-of-bag accuracy lost when one descriptor at a time is moved between rows."""
    return B.permutation_importance(B.fit_bag(_data(spark, sf), COLS, "y", ["vec_id"], True, trees=20, depth=8))


@query(
    "importance_donors",
    f"""WITH n AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('{M.SEED}:' || vec_id), vec_id) AS a, row_number() OVER (ORDER BY md5('{M.SEED + 1}:' || vec_id), vec_id) AS b FROM embeddings)
    SELECT x.vec_id, x.embedding[2]::DOUBLE AS own, y.embedding[2]::DOUBLE AS given FROM n x JOIN n y ON x.a = y.b""",
)
def importance_donors(spark, sf) -> DataFrame:
    """The row whose values each row is given."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return B.donors(rows, ["vec_id"], M.SEED).select("vec_id", F.get("features", F.lit(1)).alias("own"), F.get("__donor", F.lit(1)).alias("given"))


@query("quantile_forest")
def quantile_forest(spark, sf) -> DataFrame:
    """5 / 50 / 95 % predictions from the training values that share a row's leaves."""
    train, test = _split(_data(spark, sf))
    model = M.fit_forest(train, COLS, "t", False, **FOREST)
    return M.quantile_forest(model, train, test, COLS, "t", "vec_id", {"q05": 0.05, "q50": 0.5, "q95": 0.95})


@query(
    "score_with_guard",
    "SELECT vec_id, vec_id % 9 <> 0 AS scored FROM embeddings",
)
def score_with_guard(spark, sf) -> DataFrame:
    """Every requested id comes back; rows with a missing descriptor have no prediction."""
    df = _data(spark, sf)
    model = M.fit_forest(df, COLS, "y", True, **FOREST)
    holes = df.withColumn("d3", F.when(F.col("vec_id") % 9 != 0, F.col("d3")))
    out = M.score_complete(model, holes, COLS, "vec_id", df.select("vec_id"))
    return out.select("vec_id", F.col("prediction").isNotNull().alias("scored"))


@query("bin_scheme_table")
def bin_scheme_table(spark, sf) -> DataFrame:
    """Binning schemes side by side."""
    df = _data(spark, sf).withColumn("pab", F.pow(F.lit(10.0), F.col("t") * 2))
    train, test = _split(df)
    return P.scheme_table(train, test, COLS, "pab", "vec_id", (2, 3, 4, 5), 3, trees=10, depth=4)


# --- without a forest, so that SQL can follow ---------------------------------------------------------

_T = """t AS (SELECT l_partkey, l_linestatus, l_extendedprice / 999.9991 AS x,
    CASE WHEN l_extendedprice / 999.9991 <= 20 THEN 1 WHEN l_extendedprice / 999.9991 <= 60 THEN 2 ELSE 3 END AS bin,
    CASE WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END AS pred FROM lineitem),
  m AS (SELECT bin, median(x) AS med FROM t WHERE l_linestatus = 'F' GROUP BY 1),
  e AS (SELECT pred AS bin, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM t WHERE l_linestatus = 'O' GROUP BY 1)"""


def _binned(spark, sf) -> DataFrame:
    x = F.col("l_extendedprice") / 999.9991
    return table(spark, sf, "lineitem").select(
        "l_partkey", "l_linestatus", x.alias("x"), S.cut_index(x, [20, 60]).alias("bin"), S.cut_index("l_quantity", [15, 35]).alias("pred")
    )


def _text(x: str) -> str:
    return f"regexp_replace(({sql_signif(x, 2)})::DECIMAL(38,12)::VARCHAR, '\\.?0+$', '')"


@query(
    "bin_intervals",
    f"""WITH {_T} SELECT bin, {q6('med')}, {q6('low')}, {q6('high')},
      {_text('med')} || ' (' || {_text('low')} || ' - ' || {_text('high')} || ')' AS text FROM m JOIN e USING (bin)""",
)
def bin_intervals(spark, sf) -> DataFrame:
    df = _binned(spark, sf)
    out = P.bin_intervals(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'"), "bin", "pred", "x")
    return rounded(out, ["med", "low", "high"])


@query(
    "class_values",
    f"""WITH {_T} SELECT l_partkey, pred, count(*) AS n, {q6('any_value(' + sql_signif('med', 2) + ')', 'value')},
      {q6('any_value(' + sql_signif('low', 2) + ')', 'value_low')}, {q6('any_value(' + sql_signif('high', 2) + ')', 'value_high')}
    FROM t JOIN m ON pred = m.bin JOIN e ON pred = e.bin GROUP BY ALL""",
)
def class_values(spark, sf) -> DataFrame:
    """Predicted class to value and interval."""
    df = _binned(spark, sf)
    iv = P.bin_intervals(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'"), "bin", "pred", "x")
    n = df.groupBy("l_partkey", "pred").agg(F.count("*").alias("n"))
    return rounded(P.class_values(n, "pred", iv), ["value", "value_low", "value_high"])


@query(
    "regression_classes",
    f"""WITH {_T}, b AS (SELECT max(CASE WHEN pred = 1 THEN x END) / 2 AS b1, max(CASE WHEN pred = 2 THEN x END) * 3 / 4 AS b2 FROM t WHERE l_linestatus = 'F')
    SELECT bin, CASE WHEN x < b1 THEN 1 WHEN x < b2 THEN 2 ELSE 3 END AS predicted_bin, count(*) AS n FROM t, b GROUP BY ALL""",
)
def regression_classes(spark, sf) -> DataFrame:
    """Regression output to classes by the upper ends of observed bins."""
    df = _binned(spark, sf)
    source = df.where("l_linestatus = 'F'").withColumn("o", F.when(F.col("pred") == 1, F.col("x") / 2).otherwise(F.col("x") * 3 / 4))
    out = P.regression_classes(df, "x", source, "o", "pred")
    return out.groupBy("bin", "predicted_bin").agg(F.count("*").alias("n"))


@query(
    "regression_classes_train",
    f"""WITH {_T}, b AS (SELECT max(CASE WHEN bin = 1 THEN x END) AS low, min(CASE WHEN bin = 3 THEN x END) * 0.9 AS high FROM t WHERE l_linestatus = 'F')
    SELECT bin, CASE WHEN x * 1.05 < low THEN 1 WHEN x * 1.05 > high THEN 3 ELSE 2 END AS predicted_bin, count(*) AS n FROM t, b GROUP BY ALL""",
)
def regression_classes_train(spark, sf) -> DataFrame:
    """Regression output to classes by the inner ends of the outer training bins, which overlap here."""
    df = _binned(spark, sf).withColumn("p", F.col("x") * 1.05)
    train = df.where("l_linestatus = 'F'").withColumn("o", F.when(F.col("bin") == 3, F.col("x") * 0.9).otherwise(F.col("x")))
    out = P.regression_classes_by_ends(df, "p", train, "o", "bin")
    return out.groupBy("bin", "predicted_bin").agg(F.count("*").alias("n"))
