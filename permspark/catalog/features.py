"""Descriptor screening, imputation, rank correlation and the applicability domain on `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, rounded, table
from permspark.operators import features as FE
from permspark.operators import ordered as O
from permspark.sources import names

DIM = 64
COLS = [f"d{i}" for i in range(DIM)]
DIMS_SQL = ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(DIM))
LONG_SQL = f"long AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {DIM + 1}) t(i))"


def descriptors(spark, sf) -> DataFrame:
    return FE.wide_descriptors(table(spark, sf, "embeddings"), "embedding", DIM, "d", ["vec_id", "label"])


def _info_sql() -> str:
    def one(c, e):
        return f"SELECT '{c}' AS \"column\", count(x) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS sd FROM (SELECT {e} AS x FROM embeddings)"

    parts = [one(f"d{i}", f"embedding[{i + 1}]::DOUBLE") for i in range(DIM)]
    parts += [one("constant", "7.5::DOUBLE"), one("empty", "NULL::DOUBLE"), one("steady", "100 + embedding[1]::DOUBLE")]
    return f"""WITH s AS ({' UNION ALL '.join(parts)}) SELECT "column", n, {q6('lo')}, {q6('hi')}, {q6('mean')}, {q6('sd')},
      (n = 0 OR lo = hi OR sd IS NULL OR coalesce(abs(sd / nullif(mean, 0)) < 0.05, FALSE)) AS low_information FROM s"""


@query("low_variance", _info_sql())
def low_variance(spark, sf) -> DataFrame:
    df = descriptors(spark, sf).withColumns(
        {"constant": F.lit(7.5), "empty": F.lit(None).cast("double"), "steady": F.col("d0") + 100}
    )
    return rounded(FE.information_table(df, [*COLS, "constant", "empty", "steady"]), ["lo", "hi", "mean", "sd"])


_NZV = {"line": "l_linenumber::DOUBLE", "tax": "l_tax", "flag": "(l_quantity > 49)::INT::DOUBLE", "one": "1.0::DOUBLE", "qty": "l_quantity"}


@query(
    "near_zero_variance",
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS x, count(*) AS n FROM lineitem GROUP BY x" for c, e in _NZV.items())
    + f"""), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, x) AS rn FROM v),
    s AS (SELECT "column", max(CASE WHEN rn = 1 THEN n END) / max(CASE WHEN rn = 2 THEN n END)::DOUBLE AS f, count(*) * 100.0::DOUBLE / sum(n) AS u, count(*) AS k FROM r GROUP BY 1)
    SELECT "column", {q6('coalesce(f, 0)', 'freq_ratio')}, {q6('u', 'percent_unique')}, (k = 1 OR (coalesce(f, 0) > 19 AND u <= 10)) AS near_zero FROM s""",
)
def near_zero_variance(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("line"), F.col("l_tax").alias("tax"),
        (F.col("l_quantity") > 49).cast("double").alias("flag"), F.lit(1.0).alias("one"), F.col("l_quantity").alias("qty"),
    )
    return rounded(FE.near_zero_variance(df, list(_NZV)), ["freq_ratio", "percent_unique"])


_HOLE = "CASE WHEN (vec_id + {i}) % 7 = 0 THEN NULL ELSE embedding[{j}]::DOUBLE END"


@query(
    "mean_impute",
    "WITH t AS (SELECT vec_id, label, "
    + ", ".join(_HOLE.format(i=i, j=i + 1) + f" AS d{i}" for i in range(64))
    + ") SELECT vec_id, ".replace(")", " FROM embeddings), m AS (SELECT " + ", ".join(f"avg(d{i}) AS m{i}" for i in range(64)) + " FROM t WHERE label < 8)", 1)
    + ", ".join(q6(f"coalesce(d{i}, m{i})", f"d{i}") for i in range(64))
    + " FROM t, m",
)
def mean_impute(spark, sf) -> DataFrame:
    """Holes filled with the training rows' means, on training and new rows alike."""
    cols = COLS[:64]
    df = descriptors(spark, sf).select(
        "vec_id", "label", *[F.when((F.col("vec_id") + i) % 7 != 0, F.col(c)).alias(c) for i, c in enumerate(cols)]
    )
    profile = FE.Profile.fit(df.where("label < 8"), cols)
    return rounded(FE.impute(df, profile).select("vec_id", *cols), cols)


@query(
    "spearman_pairs",
    f"""WITH {LONG_SQL}, r AS (SELECT vec_id, i, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2.0::DOUBLE AS r FROM long)
    SELECT 'd' || a.i AS a, 'd' || b.i AS b, {q6('corr(a.r, b.r)', 'rho')} FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""",
)
def spearman_pairs(spark, sf) -> DataFrame:
    return rounded(FE.correlation_pairs(descriptors(spark, sf), COLS), ["rho"])


@query(
    "spearman_two_columns",
    f"""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT {q6('corr(a, b)', 'rho')}, count(*) AS n FROM r""",
)
def spearman_two_columns(spark, sf) -> DataFrame:
    """Rank correlation of two columns from exact average ranks."""
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    df = O.average_rank(O.average_rank(df, [], "l_quantity", "a"), [], "l_extendedprice", "b")
    return df.agg(r6(F.corr("a", "b")).alias("rho"), F.count("*").alias("n"))


@query("corr_filter")
def corr_filter(spark, sf) -> DataFrame:
    """Columns dropped because they repeat others (rank correlation above 0.9)."""
    df = descriptors(spark, sf).withColumns(
        {"copy0": F.col("d0") * 2 + 1, "copy1": F.exp("d1"), "mix2": F.col("d2") * 20 + F.col("d3")}
    )
    cols = [*COLS, "copy0", "copy1", "mix2"]
    dropped = FE.redundant_columns(FE.correlation_matrix(df, cols), cols)
    return spark.createDataFrame([(c, c in dropped) for c in cols], "column string, dropped boolean")


@query("univariate_filter")
def univariate_filter(spark, sf) -> DataFrame:
    """Columns related to the class at p < 0.1."""
    df = descriptors(spark, sf).withColumn("label", F.col("label").cast("double"))
    kept = FE.significant_columns(df, COLS, "label", 0.1, categorical=True)
    return spark.createDataFrame([(c, c in kept) for c in COLS], "column string, kept boolean")


def _newton_sql(steps: int) -> str:
    """Newton's method for all columns at once, step by step."""
    parts = [
        f"long AS (SELECT (label % 2)::DOUBLE AS y, i - 1 AS i, embedding[i]::DOUBLE + CASE WHEN i <= 8 THEN (label % 2) * 0.02 * i ELSE 0 END AS x FROM embeddings, range(1, {DIM + 1}) t(i))",
        "sc AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM long GROUP BY 1)", "std AS (SELECT long.i, y, (x - m) / s AS x FROM long JOIN sc USING (i))",
        "b0 AS (SELECT i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS v FROM sc)",
    ]
    for k in range(steps):
        parts.append(f"p{k} AS (SELECT std.i, y, x, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM std JOIN b{k} USING (i))")
        parts.append(
            f"h{k} AS (SELECT i, any_value(a) AS a, any_value(b) AS b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11 FROM p{k} GROUP BY 1)"
        )
        parts.append(f"b{k + 1} AS (SELECT i, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b, h00 / (h00 * h11 - h01 * h01) AS v FROM h{k})")
    return ", ".join(parts)


@query(
    "logistic_screen",
    f"""WITH {_newton_sql(8)} SELECT 'd' || i AS "column", n, {q6('a - b * m / s', 'intercept')}, {q6('b / s', 'slope')}, {q6('sqrt(v) / s', 'se')}, {q6('b / sqrt(v)', 'z')},
      abs(b / sqrt(v)) > 1.6448536269514722 AS kept, FALSE AS separated FROM b8 JOIN sc USING (i)""",
)
def logistic_screen(spark, sf) -> DataFrame:
    """A logistic model of the class on each column alone; kept at p < 0.1."""
    df = descriptors(spark, sf).withColumn("y", (F.col("label") % 2).cast("double"))
    df = df.withColumns({f"d{i}": F.col(f"d{i}") + F.col("y") * (0.02 * (i + 1)) for i in range(8)})
    out = FE.univariate_logistic(df, COLS, "y").withColumn("kept", F.col("p_value") < 0.1).drop("p_value")
    return rounded(out, ["intercept", "slope", "se", "z"])


@query(
    "applicability_domain",
    f"""WITH {LONG_SQL}, m AS (SELECT i, avg(x) AS mu, stddev_samp(x) / 2.2::DOUBLE AS sd FROM long WHERE label < 5 GROUP BY 1),
    s AS (SELECT vec_id, max(abs(x - mu) / sd) AS hi, min(abs(x - mu) / sd) AS lo, avg(abs(x - mu) / sd) + 1.28::DOUBLE * stddev_samp(abs(x - mu) / sd) AS mix
      FROM long JOIN m USING (i) GROUP BY 1)
    SELECT vec_id, {q6('mix', 'domain_score')}, CASE WHEN hi <= 3 THEN 1 WHEN lo > 3 THEN 0 WHEN mix <= 3 THEN 1 ELSE 0 END AS in_domain FROM s""",
)
def applicability_domain(spark, sf) -> DataFrame:
    """Training domain of the first five classes; the sd is shrunk so that every rule fires."""
    df = descriptors(spark, sf)
    p = FE.Profile.fit(df.where("label < 5"), COLS)
    tight = FE.Profile(p.mean, {c: s / 2.2 for c, s in p.sd.items()})
    return FE.applicability(df, COLS, tight).select("vec_id", r6("domain_score").alias("domain_score"), "in_domain")


@query(
    "descriptor_assembly",
    f"""WITH s AS (SELECT label, arg_min(vec_id, vec_id) AS first_id, arg_min(embedding[3]::DOUBLE, vec_id) AS x2 FROM embeddings GROUP BY 1)
    SELECT e.label, vec_id, {q6('embedding[1]', 'd0')}, first_id AS first_id_alt, {q6('x2', 'd2_alt')} FROM embeddings e JOIN s ON e.label = s.label WHERE vec_id % 5 <> 0""",
)
def descriptor_assembly(spark, sf) -> DataFrame:
    """Two descriptor sets joined per structure, the second reduced to one row each and suffixed."""
    e = descriptors(spark, sf)
    first = e.select("label", "vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("d0")).alias("d0"))
    second = e.select("label", F.col("vec_id").alias("first_id"), "d0", "d2")
    out = FE.combine_descriptors(first, second, "label", "d0", ["first_id"], "_alt")
    return rounded(names.drop_matching(out, "AD_", "Conf_index"), ["d0", "d2_alt"])
