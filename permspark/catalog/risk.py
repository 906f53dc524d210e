"""Dose, margin and rank queries.

Stand-in: line quantities of a part are its simulated concentrations, the line status the scenario, the
5th percentile of its prices the potency, and the retail price (scaled) the upper exposure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.absorption import CHEM_SQL, chain, chain_sql
from permspark.catalog.base import q6, query, rounded, table
from permspark.catalog.basics import sql_signif
from permspark.operators.grouping import histogram
from permspark.operators.ordered import quantiles
from permspark.plans import risk as R
from permspark.sources.writers import staged

_QS = R.DOSE_QUANTILES
_DOSE_SQL = f"""pot AS (SELECT l_partkey AS id, quantile_cont(l_extendedprice / 999.9991, 0.05) AS potency FROM lineitem GROUP BY 1),
  css AS (SELECT l_partkey AS id, l_linestatus AS scenario, count(*) AS n_total, {', '.join(f'quantile_cont(l_quantity / 53, {p}) AS c_{n}' for n, p in _QS.items())}
    FROM lineitem GROUP BY ALL),
  dose AS (SELECT css.id, scenario, n_total, potency, {', '.join(f'potency / nullif(c_{n}, 0) AS {n}' for n in _QS)} FROM css JOIN pot ON css.id = pot.id),
  expo AS (SELECT p_partkey AS id, p_retailprice / 97 AS u95, p_size < 25 AS measured FROM part WHERE p_size <> 3),
  ber AS (SELECT dose.*, u95, measured, q95 / u95 AS ber FROM dose LEFT JOIN expo ON dose.id = expo.id)"""


def doses(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("scenario"), (F.col("l_quantity") / 53).alias("c"),
        (F.col("l_extendedprice") / 999.9991).alias("v"),
    )
    css = R.sample_quantiles(li, ["id", "scenario"], "c")
    potency = quantiles(li, ["id"], "v", {"potency": 0.05}).select("id", "potency")
    return R.dose_equivalents(css, potency, "id", "potency")


def _margins(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").where("p_size <> 3").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 97).alias("u95"), (F.col("p_size") < 25).alias("measured")
    )
    out = R.margins(doses(spark, sf), part, "id", "u95")
    return out.join(part.select("id", "measured"), "id", "left")


@query("dose_quantiles", f"WITH {_DOSE_SQL} SELECT id, scenario, n_total, {q6('potency')}, {', '.join(q6(n) for n in _QS)} FROM dose")
def dose_quantiles(spark, sf) -> DataFrame:
    return rounded(doses(spark, sf), ["potency", *_QS])


_RANK_SQL = f"""{_DOSE_SQL}, b AS (SELECT *, round(ber, 9) AS b FROM ber),
  rk AS (SELECT id, scenario, q50, q95, ber, u95, measured,
    CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY scenario, b IS NULL ORDER BY b) + (count(*) OVER (PARTITION BY scenario, b) - 1) / 2.0)::DOUBLE END AS r FROM b),
  mr AS (SELECT id, scenario, (rank() OVER (PARTITION BY scenario ORDER BY b) + (count(*) OVER (PARTITION BY scenario, b) - 1) / 2.0)::DOUBLE AS rm
    FROM b WHERE measured AND b IS NOT NULL)"""


def _ranked(spark, sf) -> DataFrame:
    return R.scenario_ranks(staged(_margins(spark, sf)), "scenario", F.col("measured"))


@query(
    "ber_rank",
    f"""WITH {_RANK_SQL} SELECT rk.id, rk.scenario, {q6('q95')}, {q6('u95')}, {q6('ber')}, {q6('CASE WHEN ber < 1 THEN q95 END', 'cross_min')},
      {q6('CASE WHEN ber < 1 THEN u95 END', 'cross_max')}, r AS ber_rank, rm AS ber_rank_measured
    FROM rk LEFT JOIN mr ON rk.id = mr.id AND rk.scenario = mr.scenario""",
)
def ber_rank(spark, sf) -> DataFrame:
    out = _ranked(spark, sf).select("id", "scenario", "q95", "u95", "ber", "cross_min", "cross_max", "ber_rank", "ber_rank_measured")
    return rounded(out, ["q95", "u95", "ber", "cross_min", "cross_max"])


_SIDES = {"F": "full", "O": "model"}


@query(
    "rank_compare",
    f"""WITH {_RANK_SQL} SELECT rk.id, max(CASE WHEN rk.scenario = 'F' THEN r END) AS ber_rank_full,
      max(CASE WHEN rk.scenario = 'F' THEN rm END) AS ber_rank_measured_full, max(CASE WHEN rk.scenario = 'O' THEN r END) AS ber_rank_model,
      max(CASE WHEN rk.scenario = 'O' THEN rm END) AS ber_rank_measured_model
    FROM rk LEFT JOIN mr ON rk.id = mr.id AND rk.scenario = mr.scenario GROUP BY 1""",
)
def rank_compare(spark, sf) -> DataFrame:
    return R.compare_ranks(_ranked(spark, sf), "id", "scenario", _SIDES)


@query(
    "effective_factor",
    f"""WITH {_DOSE_SQL}, {CHEM_SQL}, {chain_sql('human')},
    w AS (SELECT id, max(CASE WHEN scenario = 'F' THEN q50 END) AS a, max(CASE WHEN scenario = 'O' THEN q50 END) AS b FROM dose GROUP BY 1)
    SELECT id, {q6('a', 'q50_full')}, {q6('b', 'q50_model')}, {q6('a / nullif(b, 0)', 'effective')}, {q6('f_abs * f_gut', 'analytic')}
    FROM w LEFT JOIN human ON id = p_partkey""",
)
def effective_factor(spark, sf) -> DataFrame:
    a = chain(spark, sf, ("human",)).select(F.col("p_partkey").alias("id"), (F.col("f_abs") * F.col("f_gut")).alias("analytic"))
    out = R.effective_factors(doses(spark, sf), "id", "scenario", _SIDES, a, "analytic")
    return rounded(out, ["q50_full", "q50_model", "effective", "analytic"])


_LOW_COLS = ["f_abs", "f_gut", "f_hep", "f_bio"]


@query(
    "low_absorption_report",
    f"""WITH {_DOSE_SQL}, {CHEM_SQL}, {chain_sql('human')},
    w AS (SELECT id, max(CASE WHEN scenario = 'F' THEN q95 END) AS q95_full, max(CASE WHEN scenario = 'F' THEN ber END) AS ber_full,
      max(CASE WHEN scenario = 'O' THEN q95 END) AS q95_model, max(CASE WHEN scenario = 'O' THEN ber END) AS ber_model FROM ber GROUP BY 1)
    SELECT id, {', '.join(q6(sql_signif(c, 3), c) for c in [*_LOW_COLS, 'q95_full', 'ber_full', 'q95_model', 'ber_model'])}
    FROM human JOIN w ON p_partkey = id WHERE f_abs < 0.5""",
)
def low_absorption_report(spark, sf) -> DataFrame:
    a = chain(spark, sf, ("human",)).withColumnRenamed("p_partkey", "id")
    out = R.low_absorption_report(_margins(spark, sf), "id", "scenario", _SIDES, a)
    return rounded(out, [c for c in out.columns if c != "id"])


@query(
    "eligibility",
    f"""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand,
      CASE p_size % 6 WHEN 0 THEN 'ND' WHEN 1 THEN '<' || p_size::VARCHAR WHEN 2 THEN 'fail' ELSE p_size::VARCHAR END AS clint,
      CASE WHEN p_size % 5 = 0 THEN 'NF' ELSE (p_size / 100.0::DOUBLE)::VARCHAR END AS fup FROM part)
    SELECT p_partkey, clint::DOUBLE AS clint_value, {q6('fup::DOUBLE', 'fup_value')} FROM t
    WHERE brand IS NOT NULL AND try_cast(clint AS DOUBLE) IS NOT NULL AND try_cast(fup AS DOUBLE) IS NOT NULL""",
)
def eligibility(spark, sf) -> DataFrame:
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    clint = F.when(size % 6 == 0, F.lit("ND")).when(size % 6 == 1, F.concat(F.lit("<"), text)).when(size % 6 == 2, F.lit("fail")).otherwise(text)
    fup = F.when(size % 5 == 0, F.lit("NF")).otherwise((size / 100.0).cast("string"))
    df = table(spark, sf, "part").select(
        "p_partkey", F.when(size % 7 != 0, F.col("p_brand")).alias("brand"), clint.alias("clint"), fup.alias("fup")
    )
    out = R.eligible(df, ["brand"], ["clint", "fup"]).select("p_partkey", "clint_value", "fup_value")
    return rounded(out, ["fup_value"])


@query(
    "risk_summary",
    f"""WITH {_DOSE_SQL}, {CHEM_SQL}, {chain_sql('human')},
    m AS (SELECT count(*) AS n, sum((f_abs < 0.5)::INT)::BIGINT AS n_low, median(f_abs) AS a, median(f_gut) AS g FROM human),
    k AS (SELECT median(ber) AS b FROM ber WHERE scenario = 'F'),
    s AS (SELECT n, n_low, b, {sql_signif('a', 3)} AS sa, {sql_signif('g', 3)} AS sg FROM m, k)
    SELECT n AS n_entities, n_low AS n_poorly_absorbed, {q6('sa', 'median_f_abs')}, {q6('sg', 'median_f_gut')}, {q6(sql_signif('b', 2), 'median_ber')},
      {q6(sql_signif('(1 - sa * sg)', 2), 'reduction')}, {q6(sql_signif('log10(b)', 1), 'orders_of_magnitude')} FROM s""",
)
def risk_summary(spark, sf) -> DataFrame:
    a = staged(chain(spark, sf, ("human",)))
    m = staged(_margins(spark, sf).where("scenario = 'F'").select("id", "ber"))
    out = R.narrative(a, m, "id")
    return rounded(out, ["median_f_abs", "median_f_gut", "median_ber", "reduction", "orders_of_magnitude"])


@query(
    "risk_histogram",
    f"""WITH {_DOSE_SQL}, {CHEM_SQL}, {chain_sql('human')},
    t AS (SELECT 'Fabs' AS label, f_abs AS value FROM human UNION ALL SELECT 'Fgut', f_gut FROM human UNION ALL SELECT 'BER', ber FROM ber WHERE scenario = 'F'),
    x AS (SELECT label, log10(value) AS x FROM t WHERE value > 0)
    SELECT label, least(30, floor((x + 3) / (10.0::DOUBLE / 30.0::DOUBLE))::INTEGER + 1) AS bin, count(*) AS n FROM x WHERE x >= -3 AND x <= 7 GROUP BY ALL""",
)
def risk_histogram(spark, sf) -> DataFrame:
    """Three measures stacked and counted on one log10 axis."""
    a = chain(spark, sf, ("human",)).select(F.col("p_partkey").alias("id"), "f_abs", "f_gut")
    m = _margins(spark, sf).where("scenario = 'F'").select("id", "ber")
    long = R.histogram_table(a, "id", {"f_abs": "Fabs", "f_gut": "Fgut"}).unionByName(R.histogram_table(m, "id", {"ber": "BER"}))
    return histogram(long, "value", ["label"], log=True, limits=(-3.0, 7.0))
