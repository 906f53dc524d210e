"""Registry, table access and the assay view of lineitem.

Stand-in (the test tables hold no assay): entity = l_partkey, batch = l_suppkey, controls are rows with
l_returnflag 'R', and every lineitem row is one wide triplicate reading. The tables hold no missing
values, so these are induced from l_linenumber and the status columns. Prices and quantities are scaled by odd factors, so
that no rounded result falls on an exact tie that engines could break differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    """Both engines round to the same six decimals, because they add in different orders."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def q6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of r6 (adding zero turns -0.0 into 0.0)."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0) AS {name or expr}"


def row_key_text(sep: str = ":"):
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in ROW_KEY[:4]])


def assay_wide(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    price, qty = F.col("l_extendedprice") / 999.9991, F.col("l_quantity") / 24.99971
    tax, disc, line = F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    nd = F.when(line == 2, F.lit("ND")).otherwise(F.lit("num"))
    num = F.lit("num")
    return li.select(
        F.col("l_partkey").alias("entity"),
        F.col("l_suppkey").alias("batch"),
        F.when(F.col("l_returnflag") == "R", F.lit("control")).otherwise(F.lit("test")).alias("t_type"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("order_key"),
        line.alias("line"),
        price.alias("value_ab1"),
        (price * (tax + 1.0)).alias("value_ab2"),
        (price * (F.lit(1.0) - disc) - 5.0).alias("value_ab3"),
        (price * (disc * 2.0 + 1.0)).alias("value_ba1"),
        (price * (tax + disc + 1.0)).alias("value_ba2"),
        (price * 1.5 - 4.0).alias("value_ba3"),
        qty.alias("rec_ab1"),
        (qty * (tax + 1.0)).alias("rec_ab2"),
        F.when(line != 7, qty * (F.lit(1.0) - disc)).alias("rec_ab3"),
        (qty * (F.lit(1.0) - tax)).alias("rec_ba1"),
        F.when(line != 6, qty).alias("rec_ba2"),
        (qty * (disc + 1.0)).alias("rec_ba3"),
        F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.lit("LOD")).alias("comment_ab1"),
        F.when(line == 3, F.lit("ND")).when(F.col("l_linestatus") == "F", F.lit("")).alias("comment_ab2"),
        F.lit("").alias("comment_ab3"),
        none.alias("comment_ba1"),
        F.when(F.col("l_returnflag") == "A", F.lit("low_rec")).otherwise(F.lit("")).alias("comment_ba2"),
        F.when(line == 1, F.lit("check")).otherwise(F.lit("")).alias("comment_ba3"),
        nd.alias("orig_ab1"), num.alias("orig_ab2"), num.alias("orig_ab3"),
        num.alias("orig_ba1"), num.alias("orig_ba2"), nd.alias("orig_ba3"),
    )


ASSAY_SQL = """
assay AS (
  SELECT l_partkey AS entity, l_suppkey AS batch,
    CASE WHEN l_returnflag = 'R' THEN 'control' ELSE 'test' END AS t_type,
    l_linestatus AS status, l_orderkey AS order_key, l_linenumber AS line,
    l_extendedprice / 999.9991::DOUBLE AS value_ab1,
    l_extendedprice / 999.9991::DOUBLE * (l_tax + 1) AS value_ab2,
    l_extendedprice / 999.9991::DOUBLE * (1 - l_discount) - 5 AS value_ab3,
    l_extendedprice / 999.9991::DOUBLE * (l_discount * 2 + 1) AS value_ba1,
    l_extendedprice / 999.9991::DOUBLE * (l_tax + l_discount + 1) AS value_ba2,
    l_extendedprice / 999.9991::DOUBLE * 1.5::DOUBLE - 4 AS value_ba3,
    l_quantity / 24.99971::DOUBLE AS rec_ab1,
    l_quantity / 24.99971::DOUBLE * (l_tax + 1) AS rec_ab2,
    CASE WHEN l_linenumber <> 7 THEN l_quantity / 24.99971::DOUBLE * (1 - l_discount) END AS rec_ab3,
    l_quantity / 24.99971::DOUBLE * (1 - l_tax) AS rec_ba1,
    CASE WHEN l_linenumber <> 6 THEN l_quantity / 24.99971::DOUBLE END AS rec_ba2,
    l_quantity / 24.99971::DOUBLE * (l_discount + 1) AS rec_ba3,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE 'LOD' END AS comment_ab1,
    CASE WHEN l_linenumber = 3 THEN 'ND' WHEN l_linestatus = 'F' THEN '' END AS comment_ab2,
    '' AS comment_ab3,
    NULL::VARCHAR AS comment_ba1,
    CASE WHEN l_returnflag = 'A' THEN 'low_rec' ELSE '' END AS comment_ba2,
    CASE WHEN l_linenumber = 1 THEN 'check' ELSE '' END AS comment_ba3,
    CASE WHEN l_linenumber = 2 THEN 'ND' ELSE 'num' END AS orig_ab1,
    'num' AS orig_ab2, 'num' AS orig_ab3, 'num' AS orig_ba1, 'num' AS orig_ba2,
    CASE WHEN l_linenumber = 2 THEN 'ND' ELSE 'num' END AS orig_ba3
  FROM lineitem)
"""


def qc_sql(source: str, low: float | None, high: float | None, threshold: float | None, name: str, carry: str = "") -> str:
    """SQL of the whole QC cascade as CTEs <name>_1 .. <name>; `carry` adds columns to pass through."""
    chans = [f"{d}{i}" for d in ("ab", "ba") for i in (1, 2, 3)]
    c1, v1, v2, c2 = [], [], [], []
    lo = "FALSE" if low is None else "rec_{c} < %r" % low
    hi = "FALSE" if high is None else "rec_{c} > %r" % high
    for c in chans:
        c1.append(
            f"CASE WHEN value_{c} <= 0 THEN 'ND' WHEN NULLIF(comment_{c}, '') IS NULL AND orig_{c} = 'ND' THEN 'ND' "
            f"ELSE NULLIF(comment_{c}, '') END AS k_{c}"
        )
        v1.append(f"CASE WHEN value_{c} <= 0 THEN NULL ELSE value_{c} END AS w_{c}")
        bad = f"(rec_{c} IS NULL OR {lo.format(c=c)} OR {hi.format(c=c)})"
        v2.append(f"CASE WHEN NOT (k_{c} IS NULL OR k_{c} IN ('LOD', 'low_rec')) OR {bad} THEN NULL ELSE w_{c} END AS v_{c}")
        v2.append(f"CASE WHEN {bad} THEN NULL ELSE rec_{c} END AS r_{c}")
        c2.append(
            f"CASE WHEN k_{c} IS NULL AND {lo.format(c=c)} THEN 'low_rec' "
            f"WHEN k_{c} IS NULL AND {hi.format(c=c)} THEN 'high_rec' ELSE k_{c} END AS c_{c}"
        )
    syn = []
    for d in ("ab", "ba"):
        vs = "[" + ", ".join(f"v_{d}{i}" for i in (1, 2, 3)) + "]"
        rs = "[" + ", ".join(f"r_{d}{i}" for i in (1, 2, 3)) + "]"
        syn += [
            f"list_aggregate({rs}, 'avg') AS rec_{d}", f"list_aggregate({rs}, 'stddev_samp') AS sd_rec_{d}",
            f"list_aggregate({vs}, 'avg') AS {d}0", f"list_aggregate({vs}, 'stddev_samp') AS sd_{d}",
        ]
    adj = []
    for d in ("ab", "ba"):
        adj.append(f"{d}0 AS {d}" if threshold is None else f"CASE WHEN {d}0 > {threshold} THEN {d}0 / NULLIF(rec_{d}, 0) ELSE {d}0 END AS {d}")
    ids = "entity, batch, t_type, status, order_key, line" + carry
    cc = ", ".join(f"c_{c}" for c in chans)
    return f"""
{name}_1 AS (SELECT *, {', '.join(c1 + v1)} FROM {source}),
{name}_2 AS (SELECT *, {', '.join(v2 + c2)} FROM {name}_1),
{name}_3 AS (SELECT {ids}, {cc}, {', '.join(syn)} FROM {name}_2),
{name}_4 AS (SELECT *, {', '.join(adj)}, ba0 / NULLIF(ab0, 0) AS efflux0 FROM {name}_3),
{name} AS (SELECT *, ba / NULLIF(ab, 0) AS efflux FROM {name}_4)
"""
