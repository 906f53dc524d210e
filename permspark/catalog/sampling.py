"""Binning, class labels, stratified samples and grouped splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, table
from permspark.functions import scalar as S
from permspark.operators import cleaning as C
from permspark.operators import features as FE
from permspark.operators import sampling as P
from permspark.plans.modelling import training_sets as build_sets
from permspark.sources.writers import staged


def _prices(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") / 999.9991).alias("v"))


_K = (2, 3, 4, 5)


def _freq_sql() -> str:
    parts = []
    for k in _K:
        idx = " + ".join(f"(v > (SELECT quantile_cont(v, {i}.0::DOUBLE / {k}) FROM t))::INT" for i in range(1, k))
        parts.append(f"SELECT {k} AS bins, 1 + {idx} AS bin, v FROM t")
    return f"""WITH t AS (SELECT l_extendedprice / 999.9991 AS v FROM lineitem), b AS ({' UNION ALL '.join(parts)})
    SELECT bins, bin, count(*) AS n, {q6('min(v)', 'lo')}, {q6('max(v)', 'hi')} FROM b GROUP BY ALL"""


def _bin_report(df: DataFrame, prefix: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("bins"), F.col(f"{prefix}{k}").alias("bin")) for k in _K])
    long = df.select("v", F.inline(cells))
    return long.groupBy("bins", "bin").agg(F.count("*").alias("n"), r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"))


@query("equal_freq_bins", _freq_sql())
def equal_freq_bins(spark, sf) -> DataFrame:
    return _bin_report(FE.equal_frequency_bins(_prices(spark, sf), "v", _K), "bin")


@query("kmeans_bins")
def kmeans_bins(spark, sf) -> DataFrame:
    """Bins cut halfway between 1-D cluster centres of log10 value (fixed seed)."""
    df = _prices(spark, sf).withColumn("lv", S.log10("v"))
    cuts = FE.cluster_cuts(df, "lv", _K)
    return _bin_report(df.withColumns({f"bin{k}": S.cut_index("lv", c) for k, c in cuts.items()}), "bin")


@query(
    "class_labels",
    """WITH t AS (SELECT log10(l_extendedprice / 999.9991) AS v FROM lineitem)
    SELECT CASE WHEN v < 1 AND v >= 0 THEN 'low' WHEN v >= 1 AND v <= 1.9 THEN 'high' END AS two,
      CASE WHEN v < 1 AND v >= 0 THEN 'low' WHEN v >= 1 AND v < 1.6 THEN 'med' WHEN v >= 1.6 AND v <= 1.9 THEN 'high' END AS three, count(*) AS n
    FROM t GROUP BY ALL""",
)
def class_labels(spark, sf) -> DataFrame:
    v = S.log10(F.col("l_extendedprice") / 999.9991)
    two, three = C.threshold_class(v, [1.0], 0.0, 1.9), C.threshold_class(v, [1.0, 1.6], 0.0, 1.9)
    return table(spark, sf, "lineitem").groupBy(two.alias("two"), three.alias("three")).agg(F.count("*").alias("n"))


def _flat_sql() -> str:
    rules = []
    for name, lo, hi in (("low", 0.0, 1.5), ("high", 1.5, 2.5)):
        step = (hi - lo) / 4
        for i in range(4):
            b = hi if i == 3 else lo + (i + 1) * step
            rules.append(f"WHEN c = '{name}' AND v > {lo + i * step!r}::DOUBLE AND v <= {b!r}::DOUBLE THEN '{name}_{i + 1}'")
    return f"""WITH t AS (SELECT log10(l_extendedprice / 999.9991) AS v FROM lineitem),
    c AS (SELECT v, CASE WHEN v < 1.5 AND v >= 0 THEN 'low' WHEN v >= 1.5 AND v <= 2.5 THEN 'high' END AS c FROM t),
    s AS (SELECT CASE {' '.join(rules)} END AS label FROM c)
    SELECT label, split_part(label, '_', 1) AS category, count(*) AS n FROM s GROUP BY ALL"""


@query("class_flatten", _flat_sql())
def class_flatten(spark, sf) -> DataFrame:
    """Equal-width sub-bins inside each class, labelled class_k."""
    v = S.log10(F.col("l_extendedprice") / 999.9991)
    df = table(spark, sf, "lineitem").select(v.alias("v")).withColumn("c", C.threshold_class("v", [1.5], 0.0, 2.5))
    label = P.equal_subbins("v", "c", (1.5,), (0.0, 2.5), 4)
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).withColumn("category", S.first_token("label", "_"))


# --- entities: parts with a mean log value, a source and an efflux measure -------------------------

_ENT_SQL = """e AS (SELECT l_partkey AS id, avg(log10(l_extendedprice / 999.9991)) AS v, avg(l_tax) * 10 AS efflux,
    CASE WHEN l_partkey % 3 = 0 THEN 'own' ELSE 'lit' END AS src FROM lineitem GROUP BY 1),
  res AS (SELECT p_partkey AS id FROM part WHERE p_size = 7)"""


def _entities(spark, sf) -> DataFrame:
    e = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.avg(S.log10(F.col("l_extendedprice") / 999.9991)).alias("v"), (F.avg("l_tax") * 10).alias("efflux")
    )
    return e.withColumn("src", F.when(F.col("id") % 3 == 0, F.lit("own")).otherwise(F.lit("lit")))


def _reserve(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"))


@query(
    "balanced_sample",
    f"""WITH {_ENT_SQL}, c AS (SELECT e.*, CASE WHEN v < 1.55 AND v >= -2 THEN 'low' WHEN v >= 1.55 AND v <= 2.5 THEN 'high' END AS cat,
      CASE WHEN id IN (SELECT id FROM res) THEN 'reserve' END AS role0 FROM e),
    n AS (SELECT round_even(min(n) - 5.0::DOUBLE, -1) AS size FROM (SELECT count(*) AS n FROM c WHERE cat IS NOT NULL AND role0 IS NULL GROUP BY cat, src)),
    r AS (SELECT id, row_number() OVER (PARTITION BY cat, src ORDER BY md5('10192018:' || id), id) AS rn FROM c WHERE cat IS NOT NULL AND role0 IS NULL)
    SELECT c.id, cat AS category, src, CASE WHEN rn <= (SELECT size FROM n) THEN 'train' ELSE coalesce(role0, 'test') END AS role
    FROM c LEFT JOIN r ON c.id = r.id""",
)
def balanced_sample(spark, sf) -> DataFrame:
    """Same number of training entities from every class and source, reserved ids apart."""
    o = P.SplitOptions(breaks=(1.55,))
    out = P.balanced_roles(_entities(spark, sf), "id", "v", "src", None, _reserve(spark, sf), o)
    return out.select("id", "category", "src", "role")


@query(
    "efflux_sample",
    f"""WITH {_ENT_SQL}, c AS (SELECT e.*, CASE WHEN v < 1.5 AND v >= -2 THEN 'low' WHEN v >= 1.5 AND v < 1.6 THEN 'med' WHEN v >= 1.6 AND v <= 2.5 THEN 'high' END AS cat,
      CASE WHEN efflux <= 0.40003 THEN 'low' ELSE 'high' END AS ec, CASE WHEN id IN (SELECT id FROM res) THEN 'reserve' END AS role0 FROM e),
    x AS (SELECT id, row_number() OVER (PARTITION BY ec ORDER BY md5('5212019:' || id), id) AS rn FROM c),
    d AS (SELECT c.*, CASE WHEN ec = 'high' THEN 'high_efflux' WHEN x.rn <= 10 THEN 'train_efflux' ELSE role0 END AS role1 FROM c JOIN x ON c.id = x.id),
    o AS (SELECT * FROM d WHERE role1 IS NULL AND cat IN ('low', 'high')),
    n AS (SELECT round_even(min(n)::DOUBLE, 1) AS size FROM (SELECT count(*) AS n FROM o GROUP BY cat)),
    r AS (SELECT id, row_number() OVER (PARTITION BY cat ORDER BY md5('10192018:' || id), id) AS rn FROM o)
    SELECT d.id, CASE WHEN v < 1.55 AND v >= -2 THEN 'low' WHEN v >= 1.55 AND v <= 2.5 THEN 'high' END AS category, ec AS efflux_category,
      CASE WHEN rn <= (SELECT size FROM n) THEN 'train' ELSE coalesce(role1, 'test') END AS role FROM d LEFT JOIN r ON d.id = r.id""",
)
def efflux_sample(spark, sf) -> DataFrame:
    """Three classes with the middle left out, efflux sample, high efflux dropped, sources pooled."""
    o = P.SplitOptions(
        breaks=(1.5, 1.6), efflux_break=0.40003, gap=True, rounding="one", drop_high_efflux=True, by_source=False
    )
    out = P.balanced_roles(_entities(spark, sf), "id", "v", "src", "efflux", _reserve(spark, sf), o)
    return out.select("id", "category", "efflux_category", "role")


@query(
    "flattened_sample",
    f"""WITH {_ENT_SQL}, c AS (SELECT e.*, CASE WHEN v < 1.55 AND v >= 1.2 THEN 'low' WHEN v >= 1.55 AND v <= 1.9 THEN 'high' END AS cat FROM e),
    s AS (SELECT *, CASE WHEN cat = 'low' AND v > 1.2 AND v <= 1.375 THEN 'low_1' WHEN cat = 'low' AND v > 1.375 AND v <= 1.55 THEN 'low_2'
      WHEN cat = 'high' AND v > 1.55 AND v <= 1.725 THEN 'high_1' WHEN cat = 'high' AND v > 1.725 AND v <= 1.9 THEN 'high_2' END AS sub FROM c),
    r AS (SELECT id, row_number() OVER (PARTITION BY sub, src ORDER BY md5('10192018:' || id), id) AS rn FROM s WHERE sub IS NOT NULL)
    SELECT s.id, CASE WHEN sub IS NOT NULL THEN cat END AS category, CASE WHEN rn <= 25 THEN 'train' ELSE 'test' END AS role FROM s LEFT JOIN r ON s.id = r.id""",
)
def flattened_sample(spark, sf) -> DataFrame:
    """A fixed training size from every equal-width sub-bin."""
    o = P.SplitOptions(breaks=(1.55,), limits=(1.2, 1.9), flatten=2, train_size=25)
    return P.balanced_roles(_entities(spark, sf), "id", "v", "src", options=o).select("id", "category", "role")


@query(
    "grouped_split",
    """WITH t AS (SELECT l_partkey AS id, l_orderkey, 1 + (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS bin FROM lineitem),
    m AS (SELECT id, round_even(avg(bin), 0)::INTEGER AS consensus FROM t GROUP BY 1),
    r AS (SELECT id, row_number() OVER (PARTITION BY consensus ORDER BY md5('12052012:' || id), id) AS rn,
      round_even(count(*) OVER (PARTITION BY consensus) * 0.1::DOUBLE, 0) AS size FROM m)
    SELECT t.id, consensus, CASE WHEN rn <= size AND t.id NOT IN (1, 2, 3) THEN 1 ELSE 0 END AS test, count(*) AS n
    FROM t JOIN m ON t.id = m.id JOIN r ON t.id = r.id GROUP BY ALL""",
)
def grouped_split(spark, sf) -> DataFrame:
    """A tenth of the entities of every consensus bin to the test set, all rows of an entity together."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), S.cut_index("l_quantity", [10, 20, 30, 40]).alias("bin"))
    out = P.grouped_split(li, "id", "bin", 0.1, 12052012, [1, 2, 3])
    return out.groupBy("id", "consensus", "test").agg(F.count("*").alias("n"))


@query(
    "strata_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY
      md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
      count(*) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem))
    WHERE rn <= floor(n * 0.02::DOUBLE)""",
)
def strata_sample(spark, sf) -> DataFrame:
    """Exactly two percent of each of three huge strata, without ordering a stratum."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = staged(table(spark, sf, "lineitem").select(*key, "l_returnflag").distinct())
    return P.sample_strata(df, ["l_returnflag"], key, F.floor(F.col("n_stratum") * 0.02), 7)


@query(
    "reserve_sample",
    """SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    ORDER BY md5('20417:' || c_custkey), c_custkey LIMIT 50""",
)
def reserve_sample(spark, sf) -> DataFrame:
    """Fifty ids that satisfy the exclusions, in hash order."""
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    used = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return P.reserve_sample(c.join(used, "c_custkey", "left_anti"), "c_custkey", 50, 20417)


# --- all three training tables in one go ----------------------------------------------------------------


def _roles_sql(name: str, source: str, strata: str, efflux: bool) -> str:
    """CTEs ending in <name>: roles of `source` (structure, m, src, eff) for one break at 1.55."""
    eff = f"""{name}_x AS (SELECT structure, row_number() OVER (PARTITION BY (eff <= 0.40003) ORDER BY md5('5212019:' || structure), structure) AS rn FROM {source}),
    {name}_d AS (SELECT c.*, CASE WHEN x.rn <= 10 THEN 'train_efflux' WHEN c.structure IN (SELECT structure FROM reserve) THEN 'reserve' END AS role0
      FROM {source} c LEFT JOIN {name}_x x ON c.structure = x.structure AND c.eff IS NOT NULL),"""
    plain = f"{name}_d AS (SELECT *, CASE WHEN structure IN (SELECT structure FROM reserve) THEN 'reserve' END AS role0 FROM {source}),"
    return f"""{eff if efflux else plain}
    {name}_c AS (SELECT *, CASE WHEN m < 1.55 AND m >= -2 THEN 'low' WHEN m >= 1.55 AND m <= 2.5 THEN 'high' END AS cat FROM {name}_d),
    {name}_n AS (SELECT round_even(min(n) - 5.0::DOUBLE, -1) AS size FROM (SELECT count(*) AS n FROM {name}_c WHERE cat IS NOT NULL AND role0 IS NULL GROUP BY cat{strata})),
    {name}_r AS (SELECT structure, row_number() OVER (PARTITION BY cat{strata} ORDER BY md5('10192018:' || structure), structure) AS rn FROM {name}_c
      WHERE cat IS NOT NULL AND role0 IS NULL),
    {name} AS (SELECT c.structure, '{name}' AS dataset, cat AS category, CASE WHEN rn <= (SELECT size FROM {name}_n) THEN 'train' ELSE coalesce(role0, 'test') END AS role, m
      FROM {name}_c c LEFT JOIN {name}_r r ON c.structure = r.structure)"""


_SETS_SQL = f"""WITH lit0 AS (SELECT l_partkey AS structure, l_extendedprice / 999.9991 AS v, abs(7.0::DOUBLE + l_linenumber / 10.0::DOUBLE - 7.4::DOUBLE) AS gap
    FROM lineitem WHERE l_linestatus = 'O'),
  lit1 AS (SELECT structure, avg(log10(v)) AS m FROM lit0 JOIN (SELECT structure, min(gap) AS best FROM lit0 GROUP BY 1) USING (structure) WHERE gap = best GROUP BY 1),
  own0 AS (SELECT l_partkey AS structure, l_extendedprice / 999.9991 AS v, l_tax * 10 AS e FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 4 <> 0),
  own1 AS (SELECT structure, avg(log10(v)) AS m, avg(e) AS eff, 'own' AS src FROM own0 GROUP BY 1),
  base AS (SELECT p_partkey AS structure FROM part WHERE p_size = 7),
  val AS (SELECT structure FROM lit1 WHERE structure NOT IN (SELECT structure FROM own0) AND structure NOT IN (SELECT structure FROM base)
    ORDER BY md5('20417:' || structure), structure LIMIT 50),
  reserve AS (SELECT * FROM base UNION ALL SELECT * FROM val),
  lit2 AS (SELECT structure, m, NULL::DOUBLE AS eff, 'literature' AS src FROM lit1),
  comb AS (SELECT structure, m, eff, src FROM own1 UNION ALL SELECT structure, m, 0.00001::DOUBLE, src FROM lit2 WHERE structure NOT IN (SELECT structure FROM own1)),
  {_roles_sql('literature', 'lit2', '', False)}, {_roles_sql('own', 'own1', '', True)}, {_roles_sql('combined', 'comb', ', src', True)},
  u AS (SELECT * FROM literature UNION ALL SELECT * FROM own UNION ALL SELECT * FROM combined)
  SELECT dataset, structure, category, role, {q6('m', 'mean_log')} FROM u"""


@query("training_sets", _SETS_SQL)
def training_sets(spark, sf) -> DataFrame:
    """Literature, own and combined training tables with reserve, validation, efflux and balanced roles."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("structure"), (F.col("l_extendedprice") / 999.9991).alias("value"), (F.col("l_tax") * 10).alias("efflux"),
        (F.col("l_linenumber") / 10.0 + 7.0).alias("ph"), "l_linestatus",
    )
    own = li.where("l_linestatus = 'F' and structure % 4 <> 0").select("structure", "value", "efflux")
    lit = li.where("l_linestatus = 'O'").select("structure", "value", "ph")
    reserved = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("structure"))
    out = build_sets(own, lit, reserved, P.SplitOptions(breaks=(1.55,), efflux_break=0.40003))
    return out.select("dataset", "structure", "category", "role", r6("mean_log").alias("mean_log"))
