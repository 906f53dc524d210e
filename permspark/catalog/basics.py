"""Scalar, name, cleaning and input/output queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import q6, query, r6, table
from permspark.functions import scalar as S
from permspark.operators import cleaning as C
from permspark.operators.grouping import any_present, complete_rows
from permspark.sources import names, readers, records, writers

URL = "https://example.org/chemical/details/"
JUNK = "|c:10\t"


def sql_signif(x: str, n: int) -> str:
    k = f"({n - 1} - floor(log10(abs({x}))))"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 WHEN {k} >= 0 THEN round({x} * pow(10.0::DOUBLE, abs{k})) / pow(10.0::DOUBLE, abs{k}) "
        f"ELSE round({x} / pow(10.0::DOUBLE, abs{k})) * pow(10.0::DOUBLE, abs{k}) END"
    )


@query(
    "signif_half_even",
    f"""SELECT c_custkey, {q6(sql_signif('(c_acctbal / 999.9991)', 2), 's2')}, {q6(sql_signif('(c_acctbal / 999.9991)', 4), 's4')},
      {q6('round_even(c_acctbal, -1)', 'tens')}, {q6('round_even(c_acctbal, 1)', 'tenth')} FROM customer""",
)
def signif_half_even(spark, sf) -> DataFrame:
    x = F.col("c_acctbal") / 999.9991
    return table(spark, sf, "customer").select(
        "c_custkey", r6(S.signif(x, 2)).alias("s2"), r6(S.signif(x, 4)).alias("s4"),
        r6(S.half_even("c_acctbal", -1)).alias("tens"), r6(S.half_even("c_acctbal", 1)).alias("tenth"),
    )


@query(
    "clean_ids",
    """WITH raw AS (
      SELECT 'https://example.org/chemical/details/DTX' || p_partkey::VARCHAR AS id FROM part
      UNION ALL SELECT 'DTX' || l_partkey::VARCHAR || '|c:10' || chr(9) FROM lineitem
      UNION ALL SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE 'CAS' || l_suppkey::VARCHAR END FROM lineitem)
    SELECT DISTINCT replace(replace(id, 'https://example.org/chemical/details/', ''), '|c:10' || chr(9), '') AS id
    FROM raw WHERE id LIKE '%DTX%'""",
)
def clean_ids(spark, sf) -> DataFrame:
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    raw = (
        part.select(F.concat(F.lit(URL + "DTX"), F.col("p_partkey").cast("string")).alias("id"))
        .union(li.select(F.concat(F.lit("DTX"), F.col("l_partkey").cast("string"), F.lit(JUNK))))
        .union(li.select(F.when(F.col("l_linenumber") != 1, F.concat(F.lit("CAS"), F.col("l_suppkey").cast("string")))))
    )
    return C.clean_ids(raw, "id", URL, JUNK, "DTX")


@query(
    "lossy_cast",
    f"""WITH t AS (SELECT l_returnflag, try_cast(CASE WHEN l_linenumber = 1 THEN 'ND' WHEN l_linenumber = 2 THEN '<' || l_quantity::VARCHAR
      ELSE l_quantity::VARCHAR END AS DOUBLE) AS v FROM lineitem)
    SELECT l_returnflag, count(*) AS n_rows, count(v) AS n_numbers, {q6('avg(v)', 'mean_value')} FROM t GROUP BY 1""",
)
def lossy_cast(spark, sf) -> DataFrame:
    text = F.col("l_quantity").cast("string")
    raw = (
        F.when(F.col("l_linenumber") == 1, F.lit("ND"))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("<"), text))
        .otherwise(text)
    )
    df = C.cast_numbers(table(spark, sf, "lineitem").select("l_returnflag", raw.alias("v")), ["v"])
    return df.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.count("v").alias("n_numbers"), r6(F.avg("v")).alias("mean_value")
    )


@query(
    "logit_sigmoid",
    f"""WITH t AS (SELECT p_partkey, p_size / 51.0::DOUBLE AS x FROM part)
    SELECT p_partkey, {q6('ln((x + 1e-6) / (1 - x + 1e-6))', 'logit_x')}, {q6('1 / (1 + exp(-x))', 'sigmoid_x')},
      {q6('ln(x)', 'ln_x')}, {q6('sqrt(x)', 'sqrt_x')}, CASE WHEN x > 0.5 THEN 'over' ELSE 'under' END AS side FROM t""",
)
def logit_sigmoid(spark, sf) -> DataFrame:
    x = F.col("p_size") / 51.0
    return table(spark, sf, "part").select(
        "p_partkey", r6(S.logit(x, 1e-6)).alias("logit_x"), r6(S.sigmoid(x)).alias("sigmoid_x"), r6(F.ln(x)).alias("ln_x"),
        r6(F.sqrt(x)).alias("sqrt_x"), F.when(x > 0.5, F.lit("over")).otherwise(F.lit("under")).alias("side"),
    )


@query(
    "complete_pairs",
    f"""WITH t AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS x,
      CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS y FROM lineitem)
    SELECT l_suppkey, count(*) AS n, {q6('avg(x / 999.9991)', 'mean_x')}, {q6('avg(y)', 'mean_y')} FROM t
    WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
)
def complete_pairs(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("x"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("y"),
    )
    return complete_rows(df, ["x", "y"]).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), r6(F.avg(F.col("x") / 999.9991)).alias("mean_x"), r6(F.avg("y")).alias("mean_y")
    )


_OVERLAY_SQL = """WITH base AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal / 999.9991 END AS v FROM customer),
    over AS (SELECT o_custkey AS c_custkey, avg(o_totalprice / 999.9991) AS u FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c_custkey, %s, %s FROM base LEFT JOIN over USING (c_custkey)"""


@query("overlay_fill", _OVERLAY_SQL.replace("over AS", "ov AS").replace("JOIN over", "JOIN ov") % (q6("coalesce(v, u)", "filled"), q6("coalesce(u, v)", "overwritten")))
def overlay_fill(spark, sf) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 999.9991).alias("v"))
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    over = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.col("o_totalprice") / 999.9991).alias("v"))
    both = base.withColumns({"filled": F.col("v"), "overwritten": F.col("v")}).drop("v")
    one = readers.overlay(both, over.withColumnRenamed("v", "filled"), "c_custkey", ["filled"])
    two = readers.overlay(one, over.withColumnRenamed("v", "overwritten"), "c_custkey", ["overwritten"], overwrite=True)
    return two.select("c_custkey", r6("filled").alias("filled"), r6("overwritten").alias("overwritten"))


@query(
    "io_roundtrip",
    f"""WITH t AS (SELECT p_partkey::VARCHAR AS id, nullif(p_brand, 'Brand#1') AS brand, p_type AS type, p_retailprice AS price FROM part)
    SELECT 'csv' AS source, type, count(*) AS n, count(brand) AS n_brand, {q6('sum(price)', 'total')} FROM t GROUP BY type
    UNION ALL SELECT 'tsv', type, count(*), count(brand), {q6('sum(price)', 'total')} FROM t GROUP BY type
    UNION ALL SELECT 'ids', type, count(*), count(brand), {q6('sum(price)', 'total')} FROM t GROUP BY type
    UNION ALL SELECT 'sections', type, count(*), count(brand), {q6('sum(price)', 'total')} FROM t GROUP BY type""",
)
def io_roundtrip(spark, sf) -> DataFrame:
    """Write one table through every sink, read it back through the matching source."""
    root = writers.scratch_dir(spark)
    part = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"),
    )
    writers.write_csv(part, f"{root}/csv")
    writers.write_tsv(part, f"{root}/tsv")
    writers.write_ids(part, f"{root}/ids", "id")
    writers.write_sections(part, f"{root}/sections", "type")
    schema = "id string, brand string, type string, price double"
    back = {
        "csv": readers.read_delimited(spark, f"{root}/csv", schema),
        "tsv": readers.read_delimited(spark, f"{root}/tsv", schema, sep="\t", header=False),
        "ids": readers.read_ids(spark, f"{root}/ids").join(part, "id"),
        "sections": writers.load_stage(spark, root, "sections"),
    }
    out = None
    for name, df in back.items():
        one = df.groupBy("type").agg(
            F.count("*").alias("n"), F.count("brand").alias("n_brand"), r6(F.sum("price")).alias("total")
        ).select(F.lit(name).alias("source"), "type", "n", "n_brand", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "parameter_defaults",
    f"""SELECT l_suppkey, {q6('sum(coalesce(CASE WHEN l_linenumber < 3 THEN l_tax END, 0.05))', 'tax')}, count_if(coalesce(CASE WHEN l_linestatus = 'F' THEN l_shipmode END, 'none') = 'none')::BIGINT AS n_none
      FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'rail' END AS l_shipmode FROM lineitem) GROUP BY 1""",
)
def parameter_defaults(spark, sf) -> DataFrame:
    """Missing parameters take their defaults."""
    li = table(spark, sf, "lineitem")
    tax = S.default_to(F.when(F.col("l_linenumber") < 3, F.col("l_tax")), 0.05)
    mode = S.default_to(F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), F.lit("rail")), "none")
    return li.groupBy("l_suppkey").agg(r6(F.sum(tax)).alias("tax"), F.count_if(mode == "none").alias("n_none"))


@query(
    "csv_multiline",
    """SELECT doc_id, source, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS digest, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS n FROM documents""",
)
def csv_multiline(spark, sf) -> DataFrame:
    """Texts with line ends, quotes and commas, written as quoted CSV and read back in splits."""
    path = f"{writers.scratch_dir(spark)}/csv"
    writers.write_quoted(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    back = records.read_quoted(spark, path, "doc_id long, text string, source string")
    text = F.coalesce("text", F.lit(""))
    return back.select("doc_id", "source", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


@query(
    "csv_captioned",
    f"""SELECT n_name, count(*) AS n, {q6('sum(s_acctbal)', 'balance')} FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def csv_captioned(spark, sf) -> DataFrame:
    """A caption of two lines, a header, and data, in one of several files."""
    path, names = f"{writers.scratch_dir(spark)}/csv", ["Supplier", "Nation (name)", "Balance, in units"]
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat_ws("\n", F.lit("no."), F.col("s_suppkey").cast("string")).alias(names[0]), F.col("n_name").alias(names[1]), F.col("s_acctbal").cast("string").alias(names[2]))
    caption = "Suppliers, with\ntheir balances"
    head = spark.createDataFrame([(caption, None, None), tuple(names)], rows.schema)
    writers.write_quoted(head.unionAll(rows), path)
    back = readers.read_captioned(spark, path, names, caption=caption)
    return back.groupBy(F.col(names[1]).alias("n_name")).agg(F.count("*").alias("n"), r6(F.sum(S.number_or_null(f"`{names[2]}`"))).alias("balance"))


@query(
    "csv_inferred",
    f"""SELECT s.n_name, 'bigint,string,double,boolean,date,string,double' AS types, count(*) AS n, {q6('sum(c_acctbal)', 'balance')}, count_if(c_custkey % 2 = 0)::BIGINT AS n_even,
      sum(c_custkey)::BIGINT AS keys, max(DATE '2020-01-01' + (c_custkey % 300)::INTEGER)::VARCHAR AS last FROM customer JOIN nation s ON c_nationkey = n_nationkey GROUP BY 1""",
)
def csv_inferred(spark, sf) -> DataFrame:
    """Types of a file without a schema, from all rows: one text among numbers, one fraction among whole numbers."""
    path = f"{writers.scratch_dir(spark)}/csv"
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("id"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"), F.when(key % 2 == 0, "TRUE").otherwise("FALSE").alias("even"),
        F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int")).alias("day"), F.when(key == 77, "seven").otherwise(key.cast("string")).alias("mixed"),
        F.when(key == 78, F.lit("0.5")).when(key % 3 == 0, F.lit("NA")).otherwise(key.cast("string")).alias("late"),
    )
    writers.write_csv(rows, path)
    back = records.read_inferred(spark, path)
    kinds = ",".join(t for _, t in back.dtypes)
    return back.groupBy(F.col("nation").alias("n_name"), F.lit(kinds).alias("types")).agg(
        F.count("*").alias("n"), r6(F.sum("balance")).alias("balance"), F.count_if("even").alias("n_even"), F.sum("id").alias("keys"), F.max("day").cast("string").alias("last")
    )


@query(
    "readers_roundtrip",
    f"""WITH t AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price, p_partkey % 3 AS k FROM part)
    SELECT 'whitespace' AS source, count(*) AS n, {q6('sum(size)', 'total')} FROM t UNION ALL SELECT 'pairs', count(*), {q6('sum(id::DOUBLE)', 'total')} FROM t
    UNION ALL SELECT 'sheet' || k, count(*), {q6('sum(price)', 'total')} FROM t GROUP BY k UNION ALL SELECT 'numbered', count(*), {q6('sum(price - size)', 'total')} FROM t""",
)
def readers_roundtrip(spark, sf) -> DataFrame:
    """Blank-separated, headerless, appended and position-named files, each written from a table and read back."""
    root = writers.scratch_dir(spark)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    head = spark.createDataFrame([("KEY   size",)], "value string")
    head.unionAll(part.select(F.concat_ws("  ", F.lit(" P"), F.col("id").cast("string"), F.col("size").cast("string")).alias("value"))).write.text(f"{root}/blank")
    writers.write_tsv(part.select(F.concat(F.lit("C(=O)"), F.col("size").cast("string")), "id"), f"{root}/pairs")
    for k in range(3):
        writers.write_csv(part.where(F.col("id") % 3 == k), f"{root}/sheet{k}")
    writers.write_quoted(part.select("id", F.col("price").alias("F%"), F.concat(F.col("size").cast("string"), F.lit("\n")).alias("note")), f"{root}/numbered", header=True)
    blank = readers.read_whitespace(spark, f"{root}/blank", ["KEY", "id", "size"])
    sheets = readers.read_sheets(spark, {f"sheet{k}": f"{root}/sheet{k}" for k in range(3)}, "id long, size int, price double")
    numbered = readers.read_numbered(spark, f"{root}/numbered", ["id", "F%", "F%"])
    size = S.number_or_null(F.trim(F.regexp_replace(F.col("`F%...3`"), "\n", "")))

    def total(df, x, *source):
        return df.groupBy(*source).agg(F.count("*").alias("n"), r6(F.sum(x)).alias("total"))

    return (
        total(blank.where("KEY = 'P'"), S.number_or_null("size"), F.lit("whitespace").alias("source"))
        .unionAll(total(readers.read_pairs(spark, f"{root}/pairs"), S.number_or_null("id"), F.lit("pairs").alias("source")))
        .unionAll(total(sheets, F.col("price"), F.col("sheet").alias("source")))
        .unionAll(total(numbered, S.number_or_null("`F%...2`") - size, F.lit("numbered").alias("source")))
    )


@query(
    "conditional_update",
    """WITH t AS (SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN '' ELSE l_linestatus END AS note, l_quantity AS q FROM lineitem),
    a AS (SELECT l_suppkey, CASE WHEN note = '' THEN NULL ELSE note END AS note, q FROM t),
    b AS (SELECT l_suppkey, CASE WHEN note IS NULL AND q < 10 THEN 'low' ELSE note END AS note, q FROM a),
    c AS (SELECT l_suppkey, CASE WHEN note IS NULL AND q > 40 THEN 'high' ELSE note END AS note,
            CASE WHEN q = 50 THEN NULL ELSE q END AS q FROM b)
    SELECT CASE l_suppkey WHEN 1 THEN 1001 WHEN 2 THEN 1002 ELSE l_suppkey END AS supplier, note, count(*) AS n, count(q) AS n_q
    FROM c GROUP BY 1, 2""",
)
def conditional_update(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("supplier"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.col("l_linestatus")).alias("note"),
        F.col("l_quantity").alias("q"),
    )
    note, q = F.col("note"), F.col("q")
    df = C.update_where(
        df,
        [
            ("note", note == "", F.lit(None).cast("string")),
            ("note", note.isNull() & (q < 10), "low"),
            ("note", note.isNull() & (q > 40), "high"),
            ("q", q == 50, F.lit(None).cast("double")),
        ],
    )
    df = C.point_corrections(df, "supplier", {"supplier": {1: 1001, 2: 1002}})
    return df.groupBy("supplier", "note").agg(F.count("*").alias("n"), F.count("q").alias("n_q"))


@query(
    "name_rules",
    """SELECT s_suppkey AS ad_key, s_acctbal AS acct_balxpercent, s_nationkey AS nationperid, s_name AS nameq FROM supplier""",
)
def name_rules(spark, sf) -> DataFrame:
    messy = table(spark, sf, "supplier").toDF("﻿AD key", "Name?", "Nation/(ID)", "Acct. bal*%")
    fixed = names.normalise_names(messy, lower=True)
    return fixed.select("ad_key", "nameq", "nationperid", "acct_balxpercent")


@query(
    "affixed_columns",
    """SELECT n_nationkey AS id, n_name AS meas_n_name_x, n_regionkey AS meas_n_regionkey_x FROM nation""",
)
def affixed_columns(spark, sf) -> DataFrame:
    df = table(spark, sf, "nation").withColumn("AD_x", F.lit(1)).withColumn("Conf_index_y", F.lit(2))
    df = names.drop_matching(df, "AD_", "_predRange", "Conf_index").withColumnRenamed("n_nationkey", "id")
    return names.with_affix(df, ["n_name", "n_regionkey"], "meas_", "_x")


@query(
    "missing_guards",
    """WITH t AS (SELECT l_returnflag, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_quantity END AS a,
      CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS b, CASE WHEN l_linenumber IN (1, 6) THEN NULL ELSE l_discount END AS c FROM lineitem)
    SELECT l_returnflag, sum((a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL)::INT)::BIGINT AS some_value,
      sum(((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT))::BIGINT AS n_missing,
      sum((coalesce(a IN (1, 2, 3), FALSE))::INT)::BIGINT AS in_set, sum((NOT coalesce(a IN (1, 2, 3), FALSE))::INT)::BIGINT AS not_in_set
    FROM t GROUP BY 1""",
)
def missing_guards(spark, sf) -> DataFrame:
    line = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(line <= 5, F.col("l_quantity")).alias("a"), F.when(line != 6, F.col("l_tax")).alias("b"),
        F.when(~line.isin(1, 6), F.col("l_discount")).alias("c"),
    )
    cols = ["a", "b", "c"]

    def n(cond):
        return F.sum(cond.cast("bigint"))

    return df.groupBy("l_returnflag").agg(
        n(any_present(cols)).alias("some_value"), n(S.row_missing(cols)).alias("n_missing"),
        n(S.in_set("a", [1, 2, 3])).alias("in_set"), n(S.not_in_set("a", [1, 2, 3])).alias("not_in_set"),
    )


@query(
    "value_grid",
    f"""WITH r AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
    SELECT c_mktsegment, i::INTEGER AS point, {q6('lo + (hi - lo) * i / 7.0::DOUBLE', 'x')} FROM r, range(0, 8) t(i)""",
)
def value_grid(spark, sf) -> DataFrame:
    r = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    grid = r.select("c_mktsegment", F.posexplode(S.linear_grid("lo", "hi", 8)).alias("point", "x"))
    return grid.withColumn("x", r6("x"))


@query(
    "text_rules",
    """SELECT p_partkey, ' ' || lower(p_brand) AS protected_id, split_part(p_name, ' ', 1) AS first_word,
      regexp_replace(p_name, '(red|blue) ', '', 'g') AS no_colour, printf('%.0f%%', p_size * 2.0::DOUBLE) AS share,
      '10^' || floor(log10(p_retailprice))::BIGINT::VARCHAR AS decade, (p_name LIKE '%red%') AS has_red FROM part""",
)
def text_rules(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.lower("p_brand")).alias("protected_id"), S.first_token("p_name", " ").alias("first_word"),
        F.regexp_replace("p_name", "(red|blue) ", "").alias("no_colour"), S.percent_text(F.col("p_size") / 50.0).alias("share"),
        S.power_of_ten_text("p_retailprice").alias("decade"), F.col("p_name").contains("red").alias("has_red"),
    )
