"""Harmonisation, joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, rounded, table
from permspark.functions import scalar as S
from permspark.operators import cleaning as C
from permspark.operators import joins as J
from permspark.operators import sets
from permspark.operators.ordered import quantiles, sequence_index
from permspark.plans import harmonise as H
from permspark.sources.writers import staged

# Fixed stand-in: the unit spelling a line number carries; the last one is unknown on purpose.
LINE_UNITS = ["10^-6 cm/s", "10'-4 cm/s", "10'-5 cm/s", "nm/s", "10'-8cm/s", "10'-4 cm/min", "furlong"]
LINE_FACTORS = [1.0, 100.0, 10.0, 0.1, 0.01, 100.0 / 60, None]
FREE_UNITS = ["cm/s", "10'-6cm/s", "10^-7 cm/s", "nm/s", "10^-5 cm/min", "10 e-6 cm s-1", "%"]


def _by_line(values):
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("l_linenumber") - 1)


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _li(spark, sf, *cols) -> DataFrame:
    return table(spark, sf, "lineitem").select(*cols)


@query(
    "unit_harmonise",
    f"""WITH t AS (SELECT l_suppkey, l_extendedprice / 999.9991 * ({_sql_list(LINE_FACTORS)}::DOUBLE[])[l_linenumber] AS v FROM lineitem)
    SELECT l_suppkey, count(*) AS n, {q6('avg(log10(v))', 'mean_log')}, {q6('min(v)', 'lo')}, {q6('max(v)', 'hi')} FROM t
    WHERE v IS NOT NULL GROUP BY 1""",
)
def unit_harmonise(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_suppkey", _by_line(LINE_UNITS).alias("unit"), (F.col("l_extendedprice") / 999.9991).alias("v"))
    return H.harmonise_units(df, "unit", "v").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), r6(F.avg(S.log10("v"))).alias("mean_log"), r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi")
    )


@query(
    "endpoint_harmonise",
    f"""WITH t AS (SELECT l_suppkey, CASE l_returnflag WHEN 'R' THEN pow(10, l_quantity / 53.0::DOUBLE) WHEN 'N' THEN l_quantity / 53.0::DOUBLE END AS v FROM lineitem)
    SELECT l_suppkey, 'Papp' AS endpoint_type, count(*) AS n, {q6('avg(v)', 'mean_value')} FROM t WHERE v IS NOT NULL GROUP BY 1""",
)
def endpoint_harmonise(spark, sf) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "R", F.lit("logPapp")).when(F.col("l_returnflag") == "N", F.lit("Pc")).otherwise(F.lit("Solubility"))
    df = _li(spark, sf, "l_suppkey", name.alias("endpoint"), (F.col("l_quantity") / 53.0).alias("v"))
    return H.harmonise_endpoints(df, "endpoint", "v").groupBy("l_suppkey", "endpoint_type").agg(
        F.count("*").alias("n"), r6(F.avg("v")).alias("mean_value")
    )


_FREE_FACTORS = [1e6, 1.0, 0.1, 0.1, 10.0 / 60, 1.0, None]


@query(
    "literature_filter",
    f"""WITH big AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3),
    t AS (SELECT l_orderkey, l_quantity / 53 * ({_sql_list(_FREE_FACTORS)}::DOUBLE[])[l_linenumber] AS v FROM lineitem
      WHERE l_returnflag <> 'A' AND l_linestatus = 'F' AND l_linenumber <> 7 AND l_orderkey IN (SELECT * FROM big)),
    bad AS (SELECT DISTINCT l_orderkey FROM t WHERE log10(v) > 5.9)
    SELECT l_orderkey, count(*) AS n, {q6('avg(log10(v))', 'mean_log')} FROM t WHERE l_orderkey NOT IN (SELECT * FROM bad) GROUP BY 1""",
)
def literature_filter(spark, sf) -> DataFrame:
    """Free-form units parsed, sources filtered by size and implausible values."""
    df = _li(
        spark, sf, "l_orderkey", _by_line(FREE_UNITS).alias("unit"), (F.col("l_quantity") / 53).alias("value"),
        F.when(F.col("l_returnflag") == "A", F.lit("Solubility")).otherwise(F.lit("Apparent perm.")).alias("endpoint"),
        F.when(F.col("l_linestatus") == "F", F.lit("=")).otherwise(F.lit("<")).alias("relation"),
    )
    kept = H.literature_filter(df, "endpoint", "unit", "value", "relation", "l_orderkey", more_than=3, max_log10=5.9)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), r6(F.avg("log10_value")).alias("mean_log"))


_SOURCES_SQL = """s AS (
  SELECT 'supplier' AS source, s_nationkey AS nation, s_acctbal AS amount, NULL::VARCHAR AS segment FROM supplier
  UNION SELECT 'customer', c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION SELECT 'part', NULL, p_retailprice, p_type FROM part)"""


@query(
    "source_collection",
    f"""WITH {_SOURCES_SQL} SELECT source, nation, segment, count(*) AS n, {q6('sum(amount / 999.9991)', 'total')} FROM s GROUP BY ALL""",
)
def source_collection(spark, sf) -> DataFrame:
    """Sources of different shape brought to one schema, tagged and de-duplicated."""
    t = {
        "supplier": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("amount")),
        "customer": table(spark, sf, "customer").select(
            F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")
        ),
        "part": table(spark, sf, "part").select(F.col("p_retailprice").alias("amount"), F.col("p_type").alias("segment")),
    }
    df = H.collect_sources(t, ["nation", "amount", "segment"])
    return df.groupBy("source", "nation", "segment").agg(F.count("*").alias("n"), r6(F.sum(F.col("amount") / 999.9991)).alias("total"))


_RESOLVE_SQL = """by_id AS (SELECT p_partkey, min(p_partkey) AS target FROM part WHERE p_size <= 20 GROUP BY 1),
  by_name AS (SELECT p_name, min(p_partkey) AS target FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1)"""


@query(
    "id_resolution",
    f"""WITH {_RESOLVE_SQL}, r AS (
      SELECT l_partkey, p.p_name, coalesce('P' || i.target::VARCHAR, 'P' || n.target::VARCHAR, 'NO_ID_' || p.p_name) AS target,
        CASE WHEN i.target IS NOT NULL THEN 'use_id' WHEN n.target IS NOT NULL THEN 'use_name' ELSE 'unresolved' END AS route
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN by_id i ON i.p_partkey = l.l_partkey
      LEFT JOIN by_name n ON n.p_name = p.p_name)
    SELECT target, route, count(*) AS n FROM r GROUP BY ALL""",
)
def id_resolution(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    base = _li(spark, sf, F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "p_name"), "p_partkey")
    by_id = part.where("p_size <= 20").select("p_partkey", F.col("p_partkey").alias("target"))
    by_name = part.where(~F.col("p_name").startswith("red")).groupBy("p_name").agg(F.min("p_partkey").alias("target"))
    text = F.concat(F.lit("P"), F.col("target").cast("string"))
    out = J.resolve_ids(
        base, by_id.withColumn("target", text), by_name.withColumn("target", text), "p_partkey", "p_name", "target", "NO_ID_"
    )
    return out.groupBy("target", "route").agg(F.count("*").alias("n"))


@query(
    "id_cascade",
    """SELECT coalesce(CASE WHEN p_size > 40 THEN 'S' || p_size::VARCHAR END, CASE WHEN p_brand <> 'Brand#3' THEN p_brand END, p_type) AS id,
      count(*) AS n FROM part GROUP BY 1""",
)
def id_cascade(spark, sf) -> DataFrame:
    by_size = F.when(F.col("p_size") > 40, F.concat(F.lit("S"), F.col("p_size").cast("string")))
    by_brand = F.when(F.col("p_brand") != "Brand#3", F.col("p_brand"))
    return table(spark, sf, "part").groupBy(C.first_id(by_size, by_brand, "p_type").alias("id")).agg(F.count("*").alias("n"))


@query(
    "provenance_pick",
    f"""WITH m AS (SELECT l_partkey, avg(l_extendedprice / 999.9991) AS measured FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    t AS (SELECT p_partkey, CASE WHEN p_size <> 10 THEN p_retailprice / 999.9991 END AS predicted, (p_size % 3 <> 0)::INT AS ad, measured
      FROM part LEFT JOIN m ON p_partkey = l_partkey)
    SELECT p_partkey, {q6('CASE WHEN (predicted IS NULL OR ad = 0) AND measured IS NOT NULL THEN measured ELSE predicted END', 'value_use')},
      CASE WHEN (predicted IS NULL OR ad = 0) AND measured IS NOT NULL THEN 'measured' WHEN predicted IS NULL THEN 'none' ELSE 'model' END AS value_source,
      {q6('coalesce(measured, predicted)', 'fallback_value')}, CASE WHEN measured IS NULL THEN 'model' ELSE 'measured' END AS fallback_source FROM t""",
)
def provenance_pick(spark, sf) -> DataFrame:
    m = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") != 10, F.col("p_retailprice") / 999.9991).alias("predicted"),
        (F.col("p_size") % 3 != 0).cast("int").alias("ad"),
    )
    df = J.lookup(part, m.agg(F.avg(F.col("l_extendedprice") / 999.9991).alias("measured")), ["p_partkey"])
    a, b = C.pick_with_source("predicted", "ad", "measured"), C.measured_else_model("measured", "predicted")
    out = df.select("p_partkey", a.alias("a"), b.alias("b"))
    return out.select(
        "p_partkey", r6("a.value").alias("value_use"), F.col("a.source").alias("value_source"),
        r6("b.value").alias("fallback_value"), F.col("b.source").alias("fallback_source"),
    )


@query(
    "star_assemble",
    f"""WITH f1 AS (SELECT l_suppkey AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    f2 AS (SELECT l_suppkey AS k, max(l_extendedprice / 999.9991) AS m FROM lineitem WHERE l_linenumber = 1 AND l_suppkey > 20 GROUP BY 1),
    f3 AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey < 80 GROUP BY 1)
    SELECT s_suppkey AS k, s_name, {q6('q')}, {q6('m')}, n FROM supplier LEFT JOIN f1 ON s_suppkey = f1.k LEFT JOIN f2 ON s_suppkey = f2.k
    LEFT JOIN f3 ON s_suppkey = f3.k""",
)
def star_assemble(spark, sf) -> DataFrame:
    li = _li(spark, sf, F.col("l_suppkey").alias("k"), "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber")
    f1 = li.where("l_returnflag = 'R'").groupBy("k").agg(r6(F.avg("l_quantity")).alias("q"))
    f2 = li.where("l_linenumber = 1 and k > 20").groupBy("k").agg(r6(F.max(F.col("l_extendedprice") / 999.9991)).alias("m"))
    f3 = li.where("k < 80").groupBy("k").agg(F.count("*").alias("n"))
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return J.star(base, [f1, f2, f3], ["k"])


_TRIPLE = ["l_partkey", "l_suppkey", "l_returnflag"]
_FIVE = {
    "n_first": ("l_linenumber = 1", "count(*)"), "n_late": ("l_linenumber > 4", "count(*)"), "top": ("l_quantity > 25", "max(l_extendedprice)"),
    "low": ("l_discount < 0.05", "min(l_extendedprice)"), "tax": ("l_linestatus = 'F'", "max(l_tax)"),
}


@query(
    "star_five",
    f"""WITH base AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem),
    {', '.join(f"f_{n} AS (SELECT l_partkey, l_suppkey, l_returnflag, {a} AS {n} FROM lineitem WHERE {c} GROUP BY 1, 2, 3)" for n, (c, a) in _FIVE.items())}
    SELECT * FROM base {' '.join(f"LEFT JOIN f_{n} USING (l_partkey, l_suppkey, l_returnflag)" for n in _FIVE)}""",
)
def star_five(spark, sf) -> DataFrame:
    """Five facts on three keys."""
    li = table(spark, sf, "lineitem")
    facts = [staged(li.where(c).groupBy(*_TRIPLE).agg(F.expr(a).alias(n))) for n, (c, a) in _FIVE.items()]
    return J.star(li.select(*_TRIPLE).distinct(), facts, _TRIPLE)


@query(
    "outer_chain",
    f"""WITH {', '.join(f"t{i} AS (SELECT l_suppkey AS k, l_returnflag AS flag, count(*) AS n{i}, min(l_shipno) AS name{i} FROM (SELECT *, l_orderkey % 1000 AS l_shipno FROM lineitem) WHERE (l_suppkey + {i}) % 4 > 0 AND l_linenumber = {i + 1} GROUP BY 1, 2)" for i in range(5))}
    SELECT k, flag, n0, n1, n2, n3, n4, coalesce(name0, name1, name2, name3, name4) AS name FROM t0 {' '.join(f"FULL JOIN t{i} USING (k, flag)" for i in range(1, 5))}""",
)
def outer_chain(spark, sf) -> DataFrame:
    """Five tables in a chain of full outer joins; a column they share is resolved to the first that has it."""
    li = table(spark, sf, "lineitem").withColumn("ship", F.col("l_orderkey") % 1000)
    parts = [
        li.where(((F.col("l_suppkey") + i) % 4 > 0) & (F.col("l_linenumber") == i + 1))
        .groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("flag"))
        .agg(F.count("*").alias(f"n{i}"), F.min("ship").alias(f"name{i}"))
        for i in range(5)
    ]
    out = J.full_outer_chain(parts, ["k", "flag"])
    for i in range(1, 5):
        out = J.prefer(out, {"name0": f"name{i}"})
    return out.withColumnRenamed("name0", "name")


@query(
    "published_fallback",
    f"""WITH t AS (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'cm/s' END AS u, l_quantity AS v, l_tax AS pv, l_linestatus AS pu FROM lineitem)
    SELECT l_suppkey, CASE WHEN u = '' THEN pu ELSE u END AS unit, count(*) AS n, {q6("sum(CASE WHEN u = '' THEN pv ELSE v END)", 'total')} FROM t GROUP BY 1, 2""",
)
def published_fallback(spark, sf) -> DataFrame:
    """Blank standard units take the published value and unit."""
    line = F.col("l_linenumber")
    unit = F.when(line == 1, "").when(line > 2, "cm/s").alias("unit")
    li = table(spark, sf, "lineitem").select("l_suppkey", unit, F.col("l_quantity").alias("v"), F.col("l_tax").alias("pv"), F.col("l_linestatus").alias("pu"))
    out = H.published_fallback(li, "unit", "v", "pu", "pv")
    return out.groupBy("l_suppkey", "unit").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query(
    "full_outer_coalesce",
    f"""WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal / 999.9991) AS x, min(c_name) AS name FROM customer WHERE c_nationkey < 15 GROUP BY 1),
    b AS (SELECT s_nationkey AS k, avg(s_acctbal / 999.9991) AS y, min(s_name) AS name FROM supplier WHERE s_nationkey >= 10 GROUP BY 1),
    c AS (SELECT n_nationkey AS k, n_regionkey AS z FROM nation WHERE n_nationkey % 2 = 0)
    SELECT k, {q6('x')}, {q6('y')}, z, coalesce(a.name, b.name) AS name FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""",
)
def full_outer_coalesce(spark, sf) -> DataFrame:
    a = table(spark, sf, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(
        r6(F.avg(F.col("c_acctbal") / 999.9991)).alias("x"), F.min("c_name").alias("name")
    )
    b = table(spark, sf, "supplier").where("s_nationkey >= 10").groupBy(F.col("s_nationkey").alias("k")).agg(
        r6(F.avg(F.col("s_acctbal") / 999.9991)).alias("y"), F.min("s_name").alias("other_name")
    )
    c = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("z"))
    return J.prefer(J.full_outer_chain([a, b, c], ["k"]), {"name": "other_name"})


@query(
    "semi_class_label",
    """SELECT CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15) THEN 'Small' ELSE 'Other' END AS class,
      l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""",
)
def semi_class_label(spark, sf) -> DataFrame:
    good = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    li = J.restricted(_li(spark, sf, "l_partkey", "l_suppkey", "l_returnflag"), good, "l_suppkey")
    small = table(spark, sf, "part").where("p_size < 15").select("p_partkey")
    return C.label_members(li, "l_partkey", small, "Small", "Other").groupBy("class", "l_returnflag").agg(F.count("*").alias("n"))


@query(
    "anti_new_ids",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def anti_new_ids(spark, sf) -> DataFrame:
    known = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unmatched(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_orderkey")


@query(
    "inner_lookup",
    """SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_acctbal > 0 GROUP BY ALL""",
)
def inner_lookup(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return c.join(n, "c_nationkey").join(r, "n_regionkey").groupBy("n_name", "r_name").agg(F.sum("n").alias("n"))


_HALVES = """a AS (SELECT l_partkey, avg(l_extendedprice / 999.9991) AS v FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1 GROUP BY 1),
  b AS (SELECT l_partkey, avg(l_extendedprice / 999.9991) AS v, max(l_tax) AS tax FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)"""


@query(
    "priority_union",
    f"""WITH {_HALVES} SELECT l_partkey, {q6('v')}, NULL::DOUBLE AS tax, 'measured' AS source FROM a
    UNION ALL SELECT l_partkey, {q6('v')}, tax, 'literature' FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a)""",
)
def priority_union(spark, sf) -> DataFrame:
    li = _li(spark, sf, "l_partkey", "l_extendedprice", "l_tax", "l_linestatus", "l_linenumber")
    v = r6(F.avg(F.col("l_extendedprice") / 999.9991)).alias("v")
    a = li.where("l_linestatus = 'F' and l_linenumber = 1").groupBy("l_partkey").agg(v)
    b = li.where("l_linestatus = 'O'").groupBy("l_partkey").agg(v, F.max("l_tax").alias("tax"))
    return sets.priority_union(a, b, "l_partkey", "source", ("measured", "literature"))


@query(
    "union_fill",
    """SELECT s_nationkey AS nation, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment, 'supplier' AS kind FROM supplier
    UNION ALL SELECT c_nationkey, c_name, NULL, c_mktsegment, 'customer' FROM customer""",
)
def union_fill(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.stack([sets.tagged(s, "kind", "supplier"), sets.tagged(c, "kind", "customer")], fill=True)


@query(
    "upsert_means",
    f"""WITH src AS (SELECT c_nationkey + 5 AS k, c_mktsegment, c_acctbal / 999.9991 AS v FROM customer),
    m AS (SELECT k, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN v END) AS building, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN v END) AS machinery,
      string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM src GROUP BY 1),
    base AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_regionkey = 1 THEN 1.5::DOUBLE END AS known FROM nation)
    SELECT k, n_name, known, {q6('CASE WHEN known IS NULL THEN building END', 'building')}, {q6('machinery')}, segments
    FROM base FULL JOIN m USING (k)""",
)
def upsert_means(spark, sf) -> DataFrame:
    v = F.col("c_acctbal") / 999.9991
    src = table(spark, sf, "customer").select(
        (F.col("c_nationkey") + 5).alias("k"), "c_mktsegment",
        F.when(F.col("c_mktsegment") == "BUILDING", v).alias("b"), F.when(F.col("c_mktsegment") == "MACHINERY", v).alias("m"),
    )
    base = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("k"), "n_name", F.when(F.col("n_regionkey") == 1, F.lit(1.5)).alias("known")
    )
    out = J.upsert_means(base, src, "k", {"b": "building", "m": "machinery"}, {"c_mktsegment": "segments"}, {"building": ["known"]})
    return rounded(out, ["building", "machinery"])


@query(
    "null_safe_join",
    """WITH a AS (SELECT nullif(l_linenumber, 7) AS line, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    b AS (SELECT nullif(l_linenumber, 7) AS line, max(l_quantity) AS top FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
    SELECT a.line, l_returnflag, n, b.top AS top_match, c.top AS top_plain FROM a LEFT JOIN b ON a.line IS NOT DISTINCT FROM b.line LEFT JOIN b c ON a.line = c.line""",
)
def null_safe_join(spark, sf) -> DataFrame:
    """Missing keys match each other on request, and do not by default."""
    li = _li(spark, sf, F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"), "l_linenumber", "l_returnflag", "l_quantity")
    a = li.groupBy("line", "l_returnflag").agg(F.count("*").alias("n"))
    b = li.where("l_linenumber > 3").groupBy("line").agg(F.max("l_quantity").alias("top"))
    one = J.lookup(a, b.withColumnRenamed("top", "top_match"), ["line"], match_missing=True)
    return J.lookup(one, b.withColumnRenamed("top", "top_plain"), ["line"])


@query(
    "interval_lookup",
    """SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 2
      WHEN l_quantity > 25 AND l_quantity <= 45 THEN 3 END AS bin, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1""",
)
def interval_lookup(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_quantity", S.bin_index("l_quantity", [0, 10, 25, 45]).alias("bin"))
    return df.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


_BINS_SQL = """bins AS (SELECT p_partkey AS bin, p_retailprice AS lo, lead(p_retailprice) OVER (ORDER BY p_retailprice) AS hi
  FROM (SELECT min(p_partkey) AS p_partkey, p_retailprice FROM part GROUP BY p_retailprice))"""


@query(
    "interval_table",
    f"""WITH {_BINS_SQL} SELECT bin, count(*) AS n FROM (SELECT l_extendedprice / 97 AS v FROM lineitem) t
    LEFT JOIN bins ON v > lo AND v <= hi GROUP BY 1""",
)
def interval_table(spark, sf) -> DataFrame:
    """Bins from a table, found by counting edges instead of comparing every pair."""
    edges = table(spark, sf, "part").groupBy("p_retailprice").agg(F.min("p_partkey").alias("bin"))
    placed = staged(sequence_index(edges, ["p_retailprice"], out="i"))
    nxt = placed.select((F.col("i") - 1).alias("i"), F.col("p_retailprice").alias("hi"))
    bins = placed.join(nxt, "i").select("bin", F.col("p_retailprice").alias("lo"), "hi")
    df = _li(spark, sf, (F.col("l_extendedprice") / 97).alias("v"))
    return J.interval_join(df, "v", bins, "lo", "hi").groupBy("bin").agg(F.count("*").alias("n"))


@query(
    "interval_join",
    """WITH bins AS (SELECT o_orderkey AS bin, o_orderkey - 0.75 AS lo, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey + 0.0 END AS hi
      FROM (SELECT DISTINCT o_orderkey FROM orders)),
    few AS (SELECT r_regionkey AS region, 3000.0 * r_regionkey AS lo, 3000.0 * r_regionkey + 2000 AS hi FROM region)
    SELECT region, count(*) AS n, count(bin) AS n_met, sum(bin)::BIGINT AS bin_sum FROM lineitem
    LEFT JOIN bins ON l_orderkey - l_linenumber / 8.0 > bins.lo AND l_orderkey - l_linenumber / 8.0 <= bins.hi
    LEFT JOIN few ON l_suppkey * 10 > few.lo AND l_suppkey * 10 <= few.hi GROUP BY 1""",
)
def interval_join(spark, sf) -> DataFrame:
    """As many bins as orders, some without an upper edge, then five bins with gaps."""
    key = F.col("o_orderkey")
    many = table(spark, sf, "orders").select("o_orderkey").distinct().select(
        key.alias("bin"), (key - F.lit(0.75)).alias("lo"), F.when(key % 7 > 0, key.cast("double")).alias("hi")
    )
    edge = 3000.0 * F.col("r_regionkey")
    few = table(spark, sf, "region").select(F.col("r_regionkey").alias("region"), edge.alias("lo"), (edge + 2000).alias("hi"))
    df = _li(spark, sf, (F.col("l_orderkey") - F.col("l_linenumber") / 8.0).alias("v"), (F.col("l_suppkey") * 10.0).alias("w"))
    met = J.interval_join(df, "v", many, "lo", "hi").drop("lo", "hi")
    met = J.interval_join(met, "w", few, "lo", "hi")
    return met.groupBy("region").agg(F.count("*").alias("n"), F.count("bin").alias("n_met"), F.sum("bin").alias("bin_sum"))


@query(
    "overlap_join",
    f"""WITH bins AS (SELECT p_partkey AS bin, p_retailprice - 0.02 * p_size AS lo, p_retailprice + 0.01 * p_size AS hi FROM part),
    v AS (SELECT l_suppkey, l_extendedprice / l_quantity AS v FROM lineitem)
    SELECT l_suppkey, count(bin) AS n, count_if(bin IS NULL)::BIGINT AS n_none, sum(bin)::BIGINT AS bins, {q6('max(v - lo)', 'deepest')} FROM v LEFT JOIN bins ON v > lo AND v <= hi GROUP BY 1""",
)
def overlap_join(spark, sf) -> DataFrame:
    """Unit prices against price bands of all parts, which overlap and nest."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    bins = table(spark, sf, "part").select(F.col("p_partkey").alias("bin"), (price - size * 0.02).alias("lo"), (price + size * 0.01).alias("hi"))
    df = _li(spark, sf, "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    met = J.overlap_join(df, "v", bins, "lo", "hi")
    return met.groupBy("l_suppkey").agg(
        F.count("bin").alias("n"), F.count_if(F.col("bin").isNull()).alias("n_none"), F.sum("bin").alias("bins"), r6(F.max(F.col("v") - F.col("lo"))).alias("deepest")
    )


@query(
    "set_lookup",
    """WITH s AS (SELECT n_regionkey AS idx, n_nationkey FROM nation WHERE n_regionkey < 4)
    SELECT idx, count(*) AS n FROM customer LEFT JOIN s ON c_nationkey = n_nationkey GROUP BY 1""",
)
def set_lookup(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").where("n_regionkey < 4")
    groups = n.groupBy(F.col("n_regionkey").alias("idx")).agg(F.collect_set("n_nationkey").alias("members"))
    df = table(spark, sf, "customer").select("c_nationkey")
    return J.set_lookup(df, "c_nationkey", groups, "members", "idx").groupBy("idx").agg(F.count("*").alias("n"))


@query(
    "scenario_align",
    f"""SELECT l_partkey, {q6("avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 999.9991 END)", 'm_f')},
      {q6("avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 999.9991 END)", 'm_o')} FROM lineitem GROUP BY 1""",
)
def scenario_align(spark, sf) -> DataFrame:
    m = _li(spark, sf, "l_partkey", "l_linestatus", "l_extendedprice").groupBy("l_partkey", "l_linestatus").agg(
        r6(F.avg(F.col("l_extendedprice") / 999.9991)).alias("m")
    )
    return J.align_scenarios(m, ["l_partkey"], "l_linestatus", {"F": "f", "O": "o"}, ["m"])


@query(
    "self_attach",
    f"""WITH k AS (SELECT l_partkey, l_suppkey, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    f AS (SELECT * FROM k WHERE q > 30)
    SELECT f.l_partkey, f.l_suppkey, f.l_linestatus, f.q, k.q AS q_all FROM f JOIN k USING (l_partkey, l_suppkey, l_linestatus)""",
)
def self_attach(spark, sf) -> DataFrame:
    keys = ["l_partkey", "l_suppkey", "l_linestatus"]
    k = _li(spark, sf, *keys, "l_quantity").groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    return J.self_attach(k.where("q > 30"), k, keys, ["q"], "_all")


@query(
    "scalar_lookup",
    """WITH d AS (SELECT p_name, arg_min(p_partkey, p_partkey) AS k, arg_min(p_size, p_partkey) AS size FROM part GROUP BY 1)
    SELECT p.p_partkey, d.k AS first_key, d.size AS first_size FROM part p LEFT JOIN d USING (p_name)""",
)
def scalar_lookup(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    dim = part.select("p_name", F.col("p_partkey").alias("first_key"), F.col("p_size").alias("first_size"))
    return J.lookup_one(part.select("p_partkey", "p_name"), dim, ["p_name"], ["first_key"]).drop("p_name")


@query(
    "lookup_by_row_number",
    """WITH t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_name FROM part)
    SELECT l_suppkey, p_name, count(*) AS n FROM lineitem LEFT JOIN t ON l_linenumber * 10 = id GROUP BY ALL""",
)
def lookup_by_row_number(spark, sf) -> DataFrame:
    numbered = sequence_index(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], out="id").select("id", "p_name")
    df = _li(spark, sf, "l_suppkey", (F.col("l_linenumber") * 10).cast("bigint").alias("id"))
    return J.row_by_number(df, numbered, "id").groupBy("l_suppkey", "p_name").agg(F.count("*").alias("n"))


@query(
    "update_from_lookup",
    """WITH u AS (SELECT l_partkey AS p_partkey, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1 GROUP BY 1)
    SELECT p_partkey, coalesce(q, p_size::DOUBLE) AS size FROM part LEFT JOIN u USING (p_partkey)""",
)
def update_from_lookup(spark, sf) -> DataFrame:
    base = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    new = table(spark, sf, "lineitem").where("l_returnflag = 'N' and l_linenumber = 1").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("size")
    )
    return J.update_from(base, new, "p_partkey", "size", ["size"])


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, sf) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return sets.id_difference(a, b, "k")


@query(
    "id_union",
    """SELECT p_brand AS id FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer UNION SELECT l_partkey::VARCHAR FROM lineitem
    UNION SELECT n_name FROM nation UNION SELECT r_name FROM region""",
)
def id_union(spark, sf) -> DataFrame:
    lists = [
        table(spark, sf, t).select(c)
        for t, c in (("part", "p_brand"), ("supplier", "s_name"), ("customer", "c_name"), ("lineitem", "l_partkey"), ("nation", "n_name"), ("region", "r_name"))
    ]
    return sets.id_union(lists, "id")


_FLAGS = ("A", "N", "R")


@query(
    "pivot_mean_sd",
    "SELECT l_suppkey, "
    + ", ".join(
        q6(f"{fn}(CASE WHEN l_returnflag = '{f}' THEN l_extendedprice / 999.9991 END)", f"{f}_{sfx}")
        for f in _FLAGS
        for fn, sfx in (("avg", "meas"), ("stddev_samp", "meas_sd"))
    )
    + " FROM lineitem GROUP BY 1",
)
def pivot_mean_sd(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 999.9991).alias("v"))
    out = sets.pivot_mean_sd(df, "l_suppkey", "l_returnflag", "v", list(_FLAGS))
    return rounded(out, [c for c in out.columns if c != "l_suppkey"])


@query(
    "unpivot_stack",
    " UNION ALL ".join(
        f"SELECT p_partkey, '{c}' AS label, {c}::DOUBLE AS value FROM part" for c in ("p_size", "p_retailprice")
    ),
)
def unpivot_stack(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return sets.melt(part, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "long_to_methods",
    """SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN n END) AS "BUILDING", max(CASE WHEN c_mktsegment = 'MACHINERY' THEN n END) AS "MACHINERY"
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1""",
)
def long_to_methods(spark, sf) -> DataFrame:
    n = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return sets.long_to_methods(n, ["c_nationkey"], "c_mktsegment", "n", ["BUILDING", "MACHINERY"])


@query(
    "quantile_array_spread",
    f"""SELECT l_suppkey, {q6('max(p_retailprice) / nullif(quantile_cont(l_extendedprice, 0.05), 0)', 'q05')},
      {q6('max(p_retailprice) / nullif(quantile_cont(l_extendedprice, 0.5), 0)', 'q50')},
      {q6('max(p_retailprice) / nullif(quantile_cont(l_extendedprice, 0.95), 0)', 'q95')}
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def quantile_array_spread(spark, sf) -> DataFrame:
    """An array column of quantiles spread to named columns, each as potency / quantile."""
    li = _li(spark, sf, "l_suppkey", "l_partkey", "l_extendedprice")
    q = quantiles(li, ["l_suppkey"], "l_extendedprice", {"a": 0.05, "b": 0.5, "c": 0.95})
    top = li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    top = top.groupBy("l_suppkey").agg(F.max("p_retailprice").alias("potency"))
    df = q.select("l_suppkey", F.array("a", "b", "c").alias("css")).join(top, "l_suppkey")
    return sets.spread_array(df, "css", ["q05", "q50", "q95"], lambda x: r6(S.ratio("potency", x))).drop("potency")


@query(
    "packed_string_split",
    f"""WITH t AS (SELECT l_suppkey, min(l_quantity) AS lo, median(l_quantity) AS med, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
    SELECT l_suppkey, med, lo, hi, (hi - lo)::DOUBLE AS width FROM t""",
)
def packed_string_split(spark, sf) -> DataFrame:
    """'m (lo - hi)' written and taken apart again."""
    df = _li(spark, sf, "l_suppkey", "l_quantity")
    t = df.groupBy("l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    m = quantiles(df, ["l_suppkey"], "l_quantity", {"med": 0.5}).select("l_suppkey", "med")
    text = S.packed_interval("med", "lo", "hi", 3)
    s = t.join(m, "l_suppkey").select("l_suppkey", S.unpack_interval(text).alias("s"))
    return s.select("l_suppkey", "s.med", F.col("s.low").alias("lo"), F.col("s.high").alias("hi"), (F.col("s.high") - F.col("s.low")).alias("width"))


@query(
    "ordered_category",
    """SELECT o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::INTEGER AS level, count(*) AS n
    FROM orders GROUP BY ALL""",
)
def ordered_category(spark, sf) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("level", C.ordered_category("o_orderpriority", levels)).orderBy("level")


@query(
    "large_sources",
    "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1 HAVING count(*) > 40",
)
def large_sources(spark, sf) -> DataFrame:
    docs = H.large_sources(table(spark, sf, "documents").select("source", "n_chars"), "source", 40)
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "training_values",
    f"""WITH t AS (SELECT DISTINCT l_partkey, CASE l_linestatus WHEN 'F' THEN 'own' ELSE 'lit' END AS origin,
      {q6("CASE WHEN v = 0 THEN 0.0 ELSE round(v * pow(10.0::DOUBLE, 3 - floor(log10(abs(v))))) / pow(10.0::DOUBLE, 3 - floor(log10(abs(v)))) END", 'v')}
      FROM (SELECT l_partkey, l_linestatus, CASE WHEN l_linenumber > 1 THEN l_quantity / 52.9991 - 0.1::DOUBLE END AS v FROM lineitem) WHERE v > 0)
    SELECT l_partkey, origin, count(*) AS n, {q6('sum(v)', 'total')} FROM t GROUP BY ALL""",
)
def training_values(spark, sf) -> DataFrame:
    """Values as text, rounded to reporting precision, positive and de-duplicated."""
    text = F.when(F.col("l_linenumber") > 1, (F.col("l_quantity") / 52.9991 - 0.1).cast("string")).otherwise(F.lit("ND"))
    df = _li(spark, sf, "l_partkey", F.when(F.col("l_linestatus") == "F", F.lit("own")).otherwise(F.lit("lit")).alias("origin"), text.alias("v"))
    return H.training_values(df, "v").groupBy("l_partkey", "origin").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))
