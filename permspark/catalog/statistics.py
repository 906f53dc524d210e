"""Regression, agreement, classification and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, rounded, table
from permspark.catalog.basics import sql_signif
from permspark.functions import scalar as S
from permspark.operators import resampling as RS
from permspark.operators import stats as T
from permspark.operators.grouping import contingency
from permspark.plans import evaluate as E

# Stand-in pair on lineitem: a price and the discounted price plus a share of the quantity.
X = "l_extendedprice / 999.9991"
Y = "(l_extendedprice / 999.9991 * (1 - l_discount) + l_quantity / 53)"
XY_SQL = f"xy AS (SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_linenumber, {X} AS x, {Y} AS y FROM lineitem)"


def xy(spark, sf) -> DataFrame:
    price = F.col("l_extendedprice") / 999.9991
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", price.alias("x"),
        (price * (1 - F.col("l_discount")) + F.col("l_quantity") / 53).alias("y"),
    )


_OLS = f"""{q6('regr_slope(y, x)', 'slope')}, {q6('regr_intercept(y, x)', 'intercept')}, {q6('regr_r2(y, x)', 'r2')},
  regr_count(y, x)::BIGINT AS n, (regr_count(y, x) - 2)::BIGINT AS df,
  {q6('sign(regr_slope(y, x)) * sqrt(regr_r2(y, x) * (regr_count(y, x) - 2) / (1 - regr_r2(y, x)))', 't_stat', 4)}"""


def _fit(df: DataFrame) -> DataFrame:
    return rounded(df, ["slope", "intercept", "r2"]).withColumn("t_stat", F.round("t_stat", 4))


@query("ols_by_group", f"WITH {XY_SQL} SELECT l_suppkey, {_OLS} FROM xy GROUP BY 1")
def ols_by_group(spark, sf) -> DataFrame:
    return _fit(T.ols(xy(spark, sf), "x", "y", ["l_suppkey"]))


@query("ols_subset", f"WITH {XY_SQL} SELECT {_OLS} FROM xy WHERE x > 10 AND l_returnflag = 'R'")
def ols_subset(spark, sf) -> DataFrame:
    return _fit(T.ols(xy(spark, sf).where("x > 10 and l_returnflag = 'R'"), "x", "y"))


# The tail of t for whole degrees of freedom is a finite series in the cosine of atan(t / sqrt(df)).
_OLS_P_SQL = f"""f AS (SELECT l_suppkey, regr_slope(l_discount, l_quantity) AS slope, regr_intercept(l_discount, l_quantity) AS intercept,
    regr_r2(l_discount, l_quantity) AS r2, regr_count(l_discount, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1),
  t AS (SELECT *, n - 2 AS df, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t_stat FROM f),
  a AS (SELECT *, atan(abs(t_stat) / sqrt(df)) AS th FROM t),
  c AS (SELECT j, df2, exp(sum(CASE WHEN j = 0 THEN 0.0 WHEN df2 = 0 THEN ln((2.0 * j - 1) / (2.0 * j)) ELSE ln(2.0 * j / (2.0 * j + 1)) END) OVER (PARTITION BY df2 ORDER BY j)) AS k
    FROM range(0, (SELECT max(df) // 2 + 1 FROM t)) r(j), (VALUES (0), (1)) v(df2)),
  s AS (SELECT l_suppkey, sum(k * pow(cos(th), 2 * j + df2)) AS s FROM a JOIN c ON df % 2 = df2 AND j <= (df - 2 - df2) // 2 GROUP BY 1)
  SELECT a.l_suppkey, {q6('slope')}, {q6('intercept')}, {q6('r2')}, n, df, {q6('t_stat', 't_stat', 4)},
    {q6("1 - CASE WHEN df % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + sin(th) * coalesce(s, 0)) END", 'p_value', 8)}
  FROM a LEFT JOIN s USING (l_suppkey)"""


@query("ols_p_values", f"WITH {_OLS_P_SQL}")
def ols_p_values(spark, sf) -> DataFrame:
    """Slope p-values per supplier."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    return _fit(T.ols(li, "l_quantity", "l_discount", ["l_suppkey"], p_value=True)).withColumn("p_value", F.round("p_value", 8))


_TLS_SQL = """m AS (SELECT l_suppkey, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, avg(x) AS mx, avg(y) AS my, count(*) AS n
    FROM xy GROUP BY 1),
  line AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM m)"""


@query(
    "tls_by_group",
    f"WITH {XY_SQL}, {_TLS_SQL} SELECT l_suppkey, {q6('slope', 'tls_slope')}, {q6('my - slope * mx', 'tls_intercept')}, n FROM line",
)
def tls_by_group(spark, sf) -> DataFrame:
    return rounded(T.tls(xy(spark, sf), "x", "y", ["l_suppkey"]), ["tls_slope", "tls_intercept"])


@query(
    "tls_residuals",
    f"""WITH {XY_SQL}, {_TLS_SQL} SELECT xy.l_suppkey, l_returnflag, count(*) AS n,
      {q6('sqrt(avg(pow(y - (slope * x + my - slope * mx), 2)))', 'rms')}, {q6('max(slope * x + my - slope * mx)', 'top_fitted')}
    FROM xy JOIN line ON xy.l_suppkey = line.l_suppkey GROUP BY ALL""",
)
def tls_residuals(spark, sf) -> DataFrame:
    r = T.tls_residuals(xy(spark, sf), "x", "y", ["l_suppkey"])
    return r.groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("rms"),
        r6(F.max("fitted")).alias("top_fitted"),
    )


@query(
    "lab_calibration",
    f"""WITH {XY_SQL}, per AS (SELECT l_suppkey, l_partkey, median(log10(x)) AS x FROM xy GROUP BY ALL),
    ref AS (SELECT l_partkey, avg(log10(y)) AS y FROM xy WHERE l_returnflag = 'R' GROUP BY 1),
    pr AS (SELECT l_suppkey, x, y FROM per JOIN ref USING (l_partkey)
      WHERE l_suppkey IN (SELECT l_suppkey FROM per JOIN ref USING (l_partkey) GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 5)),
    {_TLS_SQL.replace('FROM xy', 'FROM pr')},
    o AS (SELECT l_suppkey, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pr GROUP BY 1),
    ap AS (SELECT l_partkey, x, x * b + a AS co, x * slope + my - slope * mx AS ct FROM per JOIN o USING (l_suppkey) JOIN line USING (l_suppkey))
    SELECT l_partkey, {q6('median(co)', 'median_ols', 5)}, {q6('median(ct)', 'median_tls', 5)}, {q6('median(x)', 'median_raw', 5)} FROM ap GROUP BY 1""",
)
def lab_calibration(spark, sf) -> DataFrame:
    df = xy(spark, sf).select("l_suppkey", "l_partkey", "l_returnflag", S.log10("x").alias("lx"), S.log10("y").alias("ly"))
    ref = df.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.avg("ly").alias("ly"))
    out = E.calibrate_labs(df, ref, "l_suppkey", "l_partkey", "lx", "ly")
    return rounded(out, ["median_ols", "median_tls", "median_raw"], 5)


_Z = 1.959963984540054
_T975 = (
    f"({_Z} + {(_Z**3 + _Z) / 4} / d + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (d * d) "
    f"+ {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (d * d * d))"
)


@query(
    "pred_interval",
    f"""WITH {XY_SQL}, s AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS xbar, count(*) AS n, var_pop(x) * count(*) AS sxx,
      sum((x - y) * (x - y)) / (count(*) - 2) AS mse, (count(*) - 2)::DOUBLE AS d FROM xy),
    g AS (SELECT i::INTEGER AS i, lo + (hi - lo) * i / 999.0::DOUBLE AS xn, s.* EXCLUDE (lo, hi) FROM s, range(0, 1000) t(i)),
    h AS (SELECT i, xn, {_T975} * sqrt(mse * (1 + 1.0::DOUBLE / n + (xn - xbar) * (xn - xbar) / sxx)) AS half_width FROM g)
    SELECT i, {q6('xn')}, {q6('xn + half_width', 'upper')}, {q6('xn - half_width', 'lower')}, {q6('half_width')} FROM h""",
)
def pred_interval(spark, sf) -> DataFrame:
    return rounded(T.prediction_interval(xy(spark, sf), "x", "y"), ["xn", "upper", "lower", "half_width"])


def _agree(p: str, o: str) -> str:
    return (
        f"{q6(f'var_pop({o}) * count({o}) / 1000', 'sst')}, {q6(f'sum(({o} - {p}) * ({o} - {p})) / 1000', 'sse')}, {q6(f'corr({p}, {o})', 'cor')}, "
        f"count({o}) AS n, {q6(f'1 - sum(({o} - {p}) * ({o} - {p})) / (var_pop({o}) * count({o}))', 'r2')}, "
        f"{q6(f'sqrt(avg(({o} - {p}) * ({o} - {p})))', 'rmse')}"
    )


def _agreement_out(df: DataFrame) -> DataFrame:
    df = df.withColumns({"sst": F.col("sst") / 1000, "sse": F.col("sse") / 1000})
    return rounded(df, ["sst", "sse", "cor", "r2", "rmse"])


@query("xy_summary", f"WITH {XY_SQL} SELECT l_suppkey, {_agree('x', 'y')} FROM xy GROUP BY 1")
def xy_summary(spark, sf) -> DataFrame:
    return _agreement_out(T.agreement(xy(spark, sf), "x", "y", ["l_suppkey"]))


@query(
    "xy_summary_subtotals",
    f"""WITH {XY_SQL}, t AS (SELECT l_returnflag, l_linestatus, log10(x) AS x, log10(y) AS y FROM xy)
    SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, {_agree('x', 'y')}
    FROM t GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""",
)
def xy_summary_subtotals(spark, sf) -> DataFrame:
    df = xy(spark, sf).select("l_returnflag", "l_linestatus", S.log10("x").alias("x"), S.log10("y").alias("y"))
    return _agreement_out(T.agreement_subtotals(df, "x", "y", ["l_returnflag"], "l_linestatus"))


@query(
    "evaluation_table",
    f"""WITH {XY_SQL}, p AS (SELECT 'plain' AS evaluation, y AS o, x AS p FROM xy
      UNION ALL SELECT 'controls', CASE WHEN l_returnflag = 'R' THEN y END, x FROM xy
      UNION ALL SELECT 'late', y, CASE WHEN l_linenumber > 3 THEN x END FROM xy)
    SELECT evaluation, {_agree('p', 'o')} FROM p WHERE o IS NOT NULL AND p IS NOT NULL GROUP BY 1""",
)
def evaluation_table(spark, sf) -> DataFrame:
    df = xy(spark, sf).withColumns(
        {"control_y": F.when(F.col("l_returnflag") == "R", F.col("y")), "late_x": F.when(F.col("l_linenumber") > 3, F.col("x"))}
    )
    pairs = {"plain": ("y", "x"), "controls": ("control_y", "x"), "late": ("y", "late_x")}
    return _agreement_out(T.agreement(E.evaluation_pairs(df, [], pairs), "predicted", "observed", ["evaluation"]))


@query(
    "stacked_sources",
    f"""WITH {XY_SQL}, p AS (SELECT 'first study' AS reference, CASE WHEN l_linestatus = 'F' THEN y END AS o, x FROM xy
      UNION ALL SELECT 'second study', CASE WHEN l_linenumber < 4 THEN y END, x FROM xy)
    SELECT reference, count(*) AS n, {q6('avg(o)', 'mean_observed')}, {q6('sqrt(avg((o - x) * (o - x)))', 'rmse')} FROM p WHERE o IS NOT NULL GROUP BY 1""",
)
def stacked_sources(spark, sf) -> DataFrame:
    df = xy(spark, sf).withColumns({"a": F.when(F.col("l_linestatus") == "F", F.col("y")), "b": F.when(F.col("l_linenumber") < 4, F.col("y"))})
    long = E.stack_observations(df, [], {"a": "first study", "b": "second study"}, "x")
    return long.groupBy("reference").agg(
        F.count("*").alias("n"), r6(F.avg("observed")).alias("mean_observed"), r6(T.rmse("observed", "x")).alias("rmse")
    )


_ROUTE_SQL = """e AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'Oral' ELSE 'IV' END AS route, value AS base,
    value * (1 + (event_id % 7) / 10.0::DOUBLE) AS obs, 0.5::DOUBLE + (user_id % 10) / 20.0::DOUBLE AS f FROM events WHERE value > 0),
  m AS (SELECT route, obs, 'none' AS method, base AS pred FROM e
    UNION ALL SELECT route, obs, 'default', CASE WHEN route = 'Oral' THEN base * f ELSE base END FROM e
    UNION ALL SELECT route, obs, 'fixed', CASE WHEN route = 'Oral' THEN base * 0.9::DOUBLE ELSE base END FROM e),
  l AS (SELECT route, method, log10(obs) AS o, log10(pred) AS p FROM m)"""


def _routes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("value > 0").select(
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("Oral")).otherwise(F.lit("IV")).alias("route"),
        F.col("value").alias("base"), (F.col("value") * (1 + (F.col("event_id") % 7) / 10.0)).alias("obs"),
        (F.lit(0.5) + (F.col("user_id") % 10) / 20.0).alias("f"),
    )
    long = E.route_adjusted(e, ["route", "obs"], "route", "Oral", "base", {"none": F.lit(1.0), "default": F.col("f"), "fixed": F.lit(0.9)})
    return long.select("route", "method", S.log10("obs").alias("o"), S.log10("predicted").alias("p"))


@query(
    "route_adjustment",
    f"""WITH {_ROUTE_SQL} SELECT method, CASE WHEN grouping(route) = 1 THEN 'All' ELSE route END AS route, {_agree('p', 'o')}
    FROM l GROUP BY GROUPING SETS ((method, route), (method))""",
)
def route_adjustment(spark, sf) -> DataFrame:
    return _agreement_out(T.agreement_subtotals(_routes(spark, sf), "p", "o", ["method"], "route"))


_METHODS = ("none", "default", "fixed")


@query(
    "route_method_table",
    f"""WITH {_ROUTE_SQL}, g AS (SELECT method, CASE WHEN grouping(route) = 1 THEN 'All' ELSE route END AS route, {_agree('p', 'o')}
      FROM l GROUP BY GROUPING SETS ((method, route), (method))),
    u AS (SELECT method, route, 'r2' AS variable, r2 AS v FROM g UNION ALL SELECT method, route, 'rmse', rmse FROM g
      UNION ALL SELECT method, route, 'cor', cor FROM g UNION ALL SELECT method, route, 'n', n::DOUBLE FROM g)
    SELECT route, variable, """
    + ", ".join(f"max(CASE WHEN method = '{m}' THEN v END) AS \"{m}\"" for m in _METHODS)
    + " FROM u GROUP BY ALL",
)
def route_method_table(spark, sf) -> DataFrame:
    return rounded(E.method_table(_routes(spark, sf), "p", "o", ["method"], "route", list(_METHODS)), _METHODS)


@query(
    "log_metrics",
    f"""WITH {XY_SQL}, t AS (SELECT l_returnflag, log10(y) AS o, log10(x) AS p, avg(log10(y)) OVER (PARTITION BY l_returnflag) AS m FROM xy),
    s AS (SELECT l_returnflag, {sql_signif('((o - p) * (o - p))', 4)} AS pv, {sql_signif('((o - m) * (o - m))', 4)} AS tv FROM t),
    g AS (SELECT l_returnflag, count(*) AS n, sqrt(avg(pv)) AS rm, 1 - sum(pv) / sum(tv) AS r FROM s GROUP BY 1)
    SELECT l_returnflag, n, {q6(sql_signif('rm', 4), 'rmse')}, {q6(sql_signif('r', 4), 'r2')} FROM g""",
)
def log_metrics(spark, sf) -> DataFrame:
    df = xy(spark, sf).select("l_returnflag", "y", S.log10("x").alias("p"))
    return rounded(E.log_metrics(df, "y", "p", ["l_returnflag"]), ["rmse", "r2"])


_DOC_SQL = """d AS (SELECT source, lang, CASE WHEN n_chars > 1500 THEN 'high' ELSE 'low' END AS predicted,
    CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS observed FROM documents JOIN labels USING (doc_id))"""


def _docs(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    side = F.when(F.col("n_chars") > 1500, F.lit("high")).otherwise(F.lit("low"))
    truth = F.when(F.col("quality") == 1, F.lit("high")).otherwise(F.lit("low"))
    return d.select("source", "lang", side.alias("predicted"), truth.alias("observed"))


_BIN_SQL = f"""{XY_SQL}, b AS (SELECT l_suppkey, CASE WHEN x <= 20 THEN 1 WHEN x <= 60 THEN 2 ELSE 3 END AS predicted,
    CASE WHEN y <= 20 THEN 1 WHEN y <= 60 THEN 2 ELSE 3 END AS observed FROM xy)"""


def _bins(spark, sf) -> DataFrame:
    return xy(spark, sf).select("l_suppkey", S.cut_index("x", [20, 60]).alias("predicted"), S.cut_index("y", [20, 60]).alias("observed"))


@query(
    "confusion_kappa",
    f"""WITH {_BIN_SQL}, c AS (SELECT l_suppkey, predicted, observed, count(*) AS n FROM b GROUP BY ALL),
    t AS (SELECT l_suppkey, sum(n)::BIGINT AS n, sum(CASE WHEN predicted = observed THEN n ELSE 0 END) / sum(n) AS acc FROM c GROUP BY 1),
    p AS (SELECT l_suppkey, predicted AS k, sum(n)::DOUBLE AS p FROM c GROUP BY ALL), o AS (SELECT l_suppkey, observed AS k, sum(n)::DOUBLE AS o FROM c GROUP BY ALL),
    e AS (SELECT l_suppkey, sum(p * o) AS po FROM p JOIN o USING (l_suppkey, k) GROUP BY 1)
    SELECT l_suppkey, n, {q6('acc', 'accuracy')}, {q6('(acc - po / (n::DOUBLE * n)) / (1 - po / (n::DOUBLE * n))', 'kappa')} FROM t JOIN e USING (l_suppkey)""",
)
def confusion_kappa(spark, sf) -> DataFrame:
    return rounded(T.class_agreement(_bins(spark, sf), "predicted", "observed", ["l_suppkey"]), ["accuracy", "kappa"])


@query("contingency_counts", f"WITH {_BIN_SQL} SELECT predicted, observed, count(*) AS n FROM b GROUP BY ALL")
def contingency_counts(spark, sf) -> DataFrame:
    return contingency(_bins(spark, sf), "predicted", "observed")


@query(
    "balanced_accuracy",
    f"""WITH {_DOC_SQL}, c AS (SELECT lang, count(*) AS n, avg((predicted = observed)::INT::DOUBLE) AS acc,
      sum((predicted = 'high' AND observed = 'high')::INT) / nullif(sum((observed = 'high')::INT), 0)::DOUBLE AS h,
      sum((predicted = 'low' AND observed = 'low')::INT) / nullif(sum((observed = 'low')::INT), 0)::DOUBLE AS l,
      (sum((observed = 'high')::INT)::DOUBLE * sum((predicted = 'high')::INT) + sum((observed = 'low')::INT)::DOUBLE * sum((predicted = 'low')::INT)) / (count(*) * count(*)) AS ch
      FROM d GROUP BY 1)
    SELECT lang, n, {q6('acc', 'accuracy')}, {q6('(acc - ch) / nullif(1 - ch, 0)', 'kappa')}, {q6('h', 'high_accuracy')}, {q6('l', 'low_accuracy')},
      {q6('(h + l) / 2', 'balanced_accuracy')} FROM c""",
)
def balanced_accuracy(spark, sf) -> DataFrame:
    out = T.binary_agreement(_docs(spark, sf), "predicted", "observed", ["lang"])
    return rounded(out, ["accuracy", "kappa", "high_accuracy", "low_accuracy", "balanced_accuracy"])


# --- bootstrap: customers, balance against a damped balance plus the mean order value ---------------

_REPS, _SEED, _CUT = 200, 1234, 5.0
_PAIR_SQL = """o AS (SELECT o_custkey AS c_custkey, avg(o_totalprice / 99999.91) AS t FROM orders GROUP BY 1),
  pr AS (SELECT c_custkey, c_mktsegment AS evaluation, c_acctbal / 999.9991 AS obs, c_acctbal / 1409 + coalesce(t, 0) AS pred
    FROM customer LEFT JOIN o USING (c_custkey)),
  sub AS (SELECT *, 'all' AS subset FROM pr UNION ALL SELECT *, CASE WHEN obs <= 5 THEN 'low' ELSE 'high' END FROM pr)"""


def _pairs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.col("o_totalprice") / 99999.91).alias("t"))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left")
    obs = F.col("c_acctbal") / 999.9991
    return T.with_subsets(
        c.select("c_custkey", F.col("c_mktsegment").alias("evaluation"), obs.alias("obs"),
                 (F.col("c_acctbal") / 1409 + F.coalesce("t", F.lit(0.0))).alias("pred")),
        "obs", _CUT,
    )


_STATS_OUT = ["r2_low", "r2_median", "r2_high", "rmse_median"]
_BOOT_TAIL = f"""SELECT evaluation, subset, max(n)::BIGINT AS n, count(*) AS replicates, {q6('quantile_cont(adj, 0.025)', 'r2_low')},
  {q6('quantile_cont(adj, 0.5)', 'r2_median')}, {q6('quantile_cont(adj, 0.975)', 'r2_high')}, {q6('quantile_cont(rmse, 0.5)', 'rmse_median')}
  FROM s GROUP BY ALL"""


@query(
    "bootstrap_r2",
    f"""WITH {_PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY evaluation, subset ORDER BY c_custkey) AS pos,
      count(*) OVER (PARTITION BY evaluation, subset) AS n FROM sub),
    d AS (SELECT evaluation, subset, rep, ('0x' || substr(md5('{_SEED}:' || evaluation || ':' || subset || ':' || ((rep - 1) // 4) || ':' || pos), (1 + 8 * ((rep - 1) % 4))::INT, 8))::BIGINT % n + 1 AS pos
      FROM r, range(1, {_REPS + 1}) t(rep)),
    s AS (SELECT d.evaluation, d.subset, rep, count(*) AS n, sqrt(avg((obs - pred) * (obs - pred))) AS rmse,
      1 - (1 - pow(corr(pred, obs), 2)) * (count(*) - 1) / nullif(count(*) - 2, 0) AS adj
      FROM d JOIN r ON d.evaluation = r.evaluation AND d.subset = r.subset AND d.pos = r.pos GROUP BY ALL) {_BOOT_TAIL}""",
)
def bootstrap_r2(spark, sf) -> DataFrame:
    """n draws with replacement per evaluation, subset and replicate."""
    tasks = spark.sparkContext.defaultParallelism
    out = T.bootstrap(_pairs(spark, sf), ["evaluation", "subset"], "c_custkey", "obs", "pred", _REPS, _SEED, tasks)
    return rounded(out, _STATS_OUT)


_CDF = " + ".join(f"(u >= {c}::DOUBLE)::INT" for c in T.POISSON_CDF)


@query(
    "bootstrap_poisson",
    f"""WITH {_PAIR_SQL}, c AS (SELECT evaluation, subset, avg(obs) AS mo, avg(pred) AS mp FROM sub GROUP BY ALL),
    u AS (SELECT sub.evaluation, sub.subset, obs - mo AS o, pred - mp AS p, (obs - pred) * (obs - pred) AS e, rep,
      ('0x' || substr(md5('{_SEED}:' || sub.evaluation || ':' || sub.subset || ':' || ((rep - 1) // 4) || ':' || c_custkey), (1 + 8 * ((rep - 1) % 4))::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM sub JOIN c ON sub.evaluation = c.evaluation AND sub.subset = c.subset, range(1, {_REPS + 1}) t(rep)),
    w AS (SELECT *, {_CDF} AS w FROM u),
    g AS (SELECT evaluation, subset, rep, sum(w) AS n, sum(w * o) AS so, sum(w * p) AS sp, sum(w * o * o) AS soo, sum(w * p * p) AS spp,
      sum(w * o * p) AS sop, sum(w * e) AS se FROM w GROUP BY ALL),
    s AS (SELECT evaluation, subset, n, sqrt(se / n) AS rmse, 1 - (1 - pow(sop - so * sp / n, 2) / ((soo - so * so / n) * (spp - sp * sp / n))) * (n - 1) / nullif(n - 2, 0) AS adj
      FROM g WHERE n > 0) {_BOOT_TAIL}""",
)
def bootstrap_poisson(spark, sf) -> DataFrame:
    """Same statistics with independent Poisson multiplicities: no join, one partial sum per task and replicate."""
    tasks = spark.sparkContext.defaultParallelism
    keys = ["evaluation", "subset"]
    out = T.bootstrap_poisson(_pairs(spark, sf), keys, "c_custkey", "obs", "pred", _REPS, _SEED, tasks)
    return rounded(out, _STATS_OUT)


@query("bootstrap_split")
def bootstrap_split(spark, sf) -> DataFrame:
    """10 000 replicates with exact counts; draws are split over ranges of rows, so only partial sums are shuffled."""
    return RS.bootstrap_split(_pairs(spark, sf), ["evaluation", "subset"], "c_custkey", "obs", "pred")


@query("bootstrap_report")
def bootstrap_report(spark, sf) -> DataFrame:
    """The evaluation table as published: two significant digits, the interval as text, errors of all, low and high values."""
    return RS.evaluation_report(bootstrap_split(spark, sf), "evaluation", "subset")


@query(
    "rmse_digits",
    f"WITH {XY_SQL} SELECT l_suppkey, {q6(sql_signif('sqrt(avg((x - y) * (x - y)))', 3), 'rmse3')} FROM xy GROUP BY 1",
)
def rmse_digits(spark, sf) -> DataFrame:
    return rounded(xy(spark, sf).groupBy("l_suppkey").agg(T.rmse("x", "y", 3).alias("rmse3")), ["rmse3"])
