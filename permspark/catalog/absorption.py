"""Ionisation and absorption queries: parts stand for chemicals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, rounded, table
from permspark.functions import chemistry as ch
from permspark.plans import absorption as A

_ACID = "CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '4.2' WHEN p_size % 4 = 2 THEN (p_size / 5.0::DOUBLE)::VARCHAR ELSE '3.1,9.5' END"


def _sql_unionised(sites: list[tuple[str, str]], sign: int) -> str:
    """CASE over the list variants; each gives the product of un-ionised shares."""
    whens = []
    for cond, pkas in sites:
        terms = " * ".join(f"(1 - 1 / (1 + pow(10.0::DOUBLE, ({p} - ph) * {sign})))" for p in pkas.split("|")) or "1"
        whens.append(f"WHEN {cond} THEN {terms}")
    return f"CASE {' '.join(whens)} ELSE 1.0::DOUBLE END"


_ION_SQL = f"""WITH t AS (SELECT p_partkey, p_size, 6.0::DOUBLE + p_size / 23.0::DOUBLE AS ph, p_retailprice / 499 AS log_p FROM part),
  f AS (SELECT *, {_sql_unionised([('p_size % 4 = 1', '4.2'), ('p_size % 4 = 2', '(p_size / 5.0::DOUBLE)'), ('p_size % 4 = 3', '3.1|9.5')], 1)} AS a,
    {_sql_unionised([('p_size % 3 = 1', '8.8'), ('p_size % 3 = 2', '2.5|7.0')], -1)} AS b FROM t)
  SELECT p_partkey, {q6('a * b', 'fraction_neutral')}, {q6('1 - a * b', 'fraction_charged')}, {q6('(1 - a) * b', 'fraction_negative')},
    {q6('a * (1 - b)', 'fraction_positive')}, {q6('(1 - a) * (1 - b)', 'fraction_zwitter')},
    {q6('log_p + log10(a * b + 0.001::DOUBLE * (1 - a * b))', 'log_d')} FROM f"""


@query("ionisation", _ION_SQL)
def ionisation(spark, sf) -> DataFrame:
    """pKa lists of none, one or two sites at a row's own pH."""
    m4, m3 = F.col("p_size") % 4, F.col("p_size") % 3
    acid = F.when(m4 == 1, F.lit("4.2")).when(m4 == 2, (F.col("p_size") / 5.0).cast("string")).when(m4 == 3, F.lit("3.1,9.5"))
    base = F.when(m3 == 1, F.lit("8.8")).when(m3 == 2, F.lit("2.5,7.0"))
    df = table(spark, sf, "part").select(
        "p_partkey", acid.alias("acid"), base.alias("base"), (F.col("p_size") / 23.0 + 6.0).alias("ph"),
        (F.col("p_retailprice") / 499).alias("log_p"),
    )
    out = A.ionisation(df, "acid", "base", "log_p", F.col("ph")).drop("acid", "base", "ph", "log_p")
    return rounded(out, [c for c in out.columns if c != "p_partkey"])


# Inputs of the chain: geometric mean price as measured permeability, none for every fifth part.
CHEM_SQL = """g AS (SELECT l_partkey, pow(10, avg(log10(l_extendedprice / 99999.91))) AS pab FROM lineitem GROUP BY 1),
  chem AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN pab END AS pab, (p_size + 1) / 17.0::DOUBLE AS pred,
    (p_size + 1) / 61.0::DOUBLE AS fu, p_retailprice / 2991 AS cl, 0.8::DOUBLE + p_size % 5 / 10.0::DOUBLE AS rb
    FROM part LEFT JOIN g ON p_partkey = l_partkey)"""

_CONST = {
    sp.name: dict(
        area=sp.area_m2 * 1000 / 1e4 / 100 * 3600, qv=sp.villous_flow, k=ch.absorption_factor(sp), kg=sp.body_kg / 100.0,
        ql={"human": 1.3, "rat": 3.3}[sp.name], x={"human": 1, "rat": 4}[sp.name],
    )
    for sp in (ch.HUMAN, ch.RAT)
}


def chain_sql(species: str) -> str:
    """CTE <species> with the chain's results, from `chem`."""
    c = {k: repr(float(v)) + "::DOUBLE" for k, v in _CONST[species].items()}
    human = "pow(10.0::DOUBLE, 0.4926::DOUBLE * log10(coalesce(pab, pred)) - 0.1454::DOUBLE)"
    peff = human if species == "human" else f"({human} + 0.1815::DOUBLE) / 1.039::DOUBLE / 10"
    return f"""{species}_1 AS (SELECT *, {peff} AS peff FROM chem),
    {species}_2 AS (SELECT *, {c['qv']} * (peff * {c['area']}) / ({c['qv']} + peff * {c['area']}) AS gut_flow FROM {species}_1),
    {species}_3 AS (SELECT *, 1 - pow(1 + {c['k']} * peff, -7) AS f_abs,
      gut_flow / (gut_flow + fu * cl * {c['x']} * {c['kg']}) * gut_flow / (gut_flow + 0.5::DOUBLE) AS f_gut,
      {c['ql']} / ({c['ql']} + cl * {c['x']} * fu / rb) AS f_hep FROM {species}_2),
    {species} AS (SELECT p_partkey, CASE WHEN pab IS NULL THEN 'model' ELSE 'measured' END AS pab_source, '{species}' AS species,
      peff, gut_flow, f_abs, f_gut, f_hep, f_abs * f_gut * f_hep AS f_bio FROM {species}_3)"""


CHAIN_COLS = ["peff", "gut_flow", "f_abs", "f_gut", "f_hep", "f_bio"]


def chemicals(spark, sf) -> DataFrame:
    g = A.geometric_permeability(table(spark, sf, "lineitem"), "l_partkey", F.col("l_extendedprice") / 99999.91)
    part = table(spark, sf, "part").join(g.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left")
    return part.select(
        "p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("pab")).alias("pab"), ((F.col("p_size") + 1) / 17.0).alias("pred"),
        ((F.col("p_size") + 1) / 61.0).alias("fu"), (F.col("p_retailprice") / 2991).alias("cl"),
        (F.col("p_size") % 5 / 10.0 + 0.8).alias("rb"),
    )


def chain(spark, sf, species=("human", "rat")) -> DataFrame:
    inputs = {
        s: {
            "free_fraction": F.col("fu"), "clearance": F.col("cl") * _CONST[s]["x"], "liver_flow": F.lit(_CONST[s]["ql"]),
            "blood_to_plasma": F.col("rb"),
        }
        for s in species
    }
    return A.absorption_chain(chemicals(spark, sf), ["p_partkey"], "pab", "pred", inputs)


_OUT = ", ".join(["p_partkey", "pab_source", "species", *[q6(c) for c in CHAIN_COLS]])


@query(
    "absorption_chain",
    f"WITH {CHEM_SQL}, {chain_sql('human')}, {chain_sql('rat')} SELECT {_OUT} FROM human UNION ALL SELECT {_OUT} FROM rat",
)
def absorption_chain(spark, sf) -> DataFrame:
    return rounded(chain(spark, sf), CHAIN_COLS)


@query(
    "threshold_share",
    f"""WITH {CHEM_SQL}, k AS (SELECT coalesce(pab, pred) AS v FROM chem) SELECT count(*) AS n, sum((v < 0.55)::INT)::BIGINT AS n_human,
      {q6('avg((v < 0.55)::INT::DOUBLE)', 'share_human')}, sum((v < 2.4)::INT)::BIGINT AS n_rat, {q6('avg((v < 2.4)::INT::DOUBLE)', 'share_rat')} FROM k""",
)
def threshold_share(spark, sf) -> DataFrame:
    """Entities whose permeability implies less than half absorbed."""
    df = chemicals(spark, sf).select(F.coalesce("pab", "pred").alias("v"))
    return rounded(A.threshold_shares(df, "v", {"human": 0.55, "rat": 2.4}), ["share_human", "share_rat"])


@query(
    "hepatic_availability",
    f"""WITH {CHEM_SQL} SELECT p_partkey, {q6('1.3 / (1.3 + cl * fu / rb)', 'restrictive')},
      {q6('1.3 / (1.3 + cl / rb)', 'non_restrictive')} FROM chem""",
)
def hepatic_availability(spark, sf) -> DataFrame:
    q = F.lit(1.3)
    return chemicals(spark, sf).select(
        "p_partkey", r6(ch.fraction_hepatic(q, "cl", "fu", "rb")).alias("restrictive"),
        r6(ch.fraction_hepatic(q, "cl", "fu", "rb", restrictive=False)).alias("non_restrictive"),
    )
