"""Grouped summaries, results on rows, filters, histograms and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import ROW_KEY, q6, query, r6, rounded, table
from permspark.functions import scalar as S
from permspark.operators import grouping as G
from permspark.operators import ordered as O
from permspark.operators import sets
from permspark.operators.features import wide_descriptors


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _li(spark, sf, *cols) -> DataFrame:
    return table(spark, sf, "lineitem").select(*cols)


@query(
    "sketched_counts",
    """WITH m AS (SELECT l_returnflag, l_partkey, max((l_quantity > 30)::INT) AS a, max((l_discount < 0.03)::INT) AS b FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, sum(a)::BIGINT AS large, sum(b)::BIGINT AS full_price, sum(a * b)::BIGINT AS large_and_full_price, sum(greatest(a, b))::BIGINT AS large_or_full_price,
      0.0::DOUBLE AS large_error, 0.0::DOUBLE AS full_price_error, 0.0::DOUBLE AS large_and_full_price_error, 0.0::DOUBLE AS large_or_full_price_error FROM m GROUP BY 1""",
)
def sketched_counts(spark, sf) -> DataFrame:
    """Distinct parts per condition, for both and for either, from sketches large enough to be exact here."""
    tests = {"large": F.col("l_quantity") > 30, "full_price": F.col("l_discount") < 0.03}
    return G.sketched_counts(table(spark, sf, "lineitem"), "l_partkey", tests, ["l_returnflag"], [("large", "full_price")])


@query(
    "geo_mean",
    f"""WITH t AS (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END AS lv, s_acctbal AS v FROM supplier
      UNION ALL SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, c_acctbal FROM customer)
    SELECT s_nationkey AS nation, {q6('pow(10, avg(lv)) / 1000', 'gm')}, {q6('stddev_samp(lv)', 'lsd')}, count(*) AS n_rows, count(lv) AS n_log,
      {q6('stddev_samp(lv) / nullif(pow(10, avg(lv)), 0) * 1000', 'cv')} FROM t GROUP BY 1""",
)
def geo_mean(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    gm, lsd = G.geometric_mean("v"), G.log_sd("v")
    return s.unionByName(c).groupBy("nation").agg(
        r6(gm / 1000).alias("gm"), r6(lsd).alias("lsd"), F.count("*").alias("n_rows"), F.count(S.log10("v")).alias("n_log"),
        r6(S.ratio(lsd, gm) * 1000).alias("cv"),
    )


_PROBS = {"p025": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p975": 0.975}


def _q(x: str) -> str:
    return ", ".join(q6(f"quantile_cont({x}, {p})", n) for n, p in _PROBS.items())


@query(
    "quantile_by_group",
    f"SELECT l_suppkey, {_q('l_extendedprice / 999.9991')}, count(*) AS n_total FROM lineitem GROUP BY 1",
)
def quantile_by_group(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_suppkey", (F.col("l_extendedprice") / 999.9991).alias("v"))
    return rounded(O.quantiles(df, ["l_suppkey"], "v", _PROBS), list(_PROBS))


@query(
    "quantile_split",
    f"SELECT l_returnflag, {_q('l_extendedprice / 999.9991')}, count(*) AS n_total FROM lineitem GROUP BY 1",
)
def quantile_split(spark, sf) -> DataFrame:
    """Three groups hold all rows: each is many ranges."""
    df = _li(spark, sf, "l_returnflag", (F.col("l_extendedprice") / 999.9991).alias("v"))
    return rounded(O.quantiles(df, ["l_returnflag"], "v", _PROBS), list(_PROBS))


@query(
    "rank_overall",
    """SELECT l_suppkey, count(*) AS n, sum(r) AS rank_sum, min(r) AS rank_min, max(r) AS rank_max FROM (
      SELECT l_suppkey, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0)::DOUBLE AS r
      FROM lineitem) GROUP BY 1""",
)
def rank_overall(spark, sf) -> DataFrame:
    """Average-tie rank over the whole table, cut into ranges."""
    df = O.average_rank(_li(spark, sf, "l_suppkey", "l_extendedprice"), [], "l_extendedprice", "r")
    return df.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum("r").alias("rank_sum"), F.min("r").alias("rank_min"), F.max("r").alias("rank_max")
    )


@query(
    "surrogate_ids",
    """SELECT l_suppkey, sum(id)::BIGINT AS id_sum, min(id) AS first_id, max(id) AS last_id FROM (
      SELECT l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id
      FROM lineitem) GROUP BY 1""",
)
def surrogate_ids(spark, sf) -> DataFrame:
    df = O.sequence_index(_li(spark, sf, *ROW_KEY), ROW_KEY, out="id")
    return df.groupBy("l_suppkey").agg(
        F.sum("id").alias("id_sum"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query(
    "sequence_by_text",
    """SELECT l_suppkey, sum(id)::BIGINT AS id_sum, min(id) AS first_id, max(id) AS last_id, max(n_total) AS n_total FROM (
      SELECT l_suppkey, count(*) OVER (PARTITION BY l_linestatus) AS n_total, row_number() OVER (PARTITION BY l_linestatus
        ORDER BY l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id
      FROM lineitem) GROUP BY 1""",
)
def sequence_by_text(spark, sf) -> DataFrame:
    """Row numbers in two large groups, by a text with few values, then a date."""
    order = ["l_returnflag", "l_shipdate", *ROW_KEY]
    df = O.sequence_index(_li(spark, sf, "l_linestatus", *order), order, ["l_linestatus"], out="id")
    return df.groupBy("l_suppkey").agg(
        F.sum("id").alias("id_sum"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("n_total").alias("n_total")
    )


def _hist(x: str, keys: str, where: str = "TRUE", lo: str = "min(x)", hi: str = "max(x)") -> str:
    return f"""WITH t AS (SELECT {keys}, {x} AS x FROM lineitem WHERE {where}),
      b AS (SELECT {lo} AS lo, {hi} AS hi FROM t)
      SELECT {keys}, least(30, floor((x - lo) / ((hi - lo) / 30.0::DOUBLE))::INTEGER + 1) AS bin, count(*) AS n
      FROM t, b WHERE x >= lo AND x <= hi GROUP BY ALL"""


@query("histogram_log", _hist("log10(l_extendedprice)", "l_returnflag", "l_extendedprice > 0"))
def histogram_log(spark, sf) -> DataFrame:
    return G.histogram(_li(spark, sf, "l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"], log=True)


@query("histogram_limits", _hist("l_extendedprice / 999.9991", "l_linestatus", lo="any_value(20.0::DOUBLE)", hi="any_value(80.0::DOUBLE)"))
def histogram_limits(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_linestatus", (F.col("l_extendedprice") / 999.9991).alias("v"))
    return G.histogram(df, "v", ["l_linestatus"], limits=(20.0, 80.0))


@query(
    "annotation_stats",
    f"""SELECT l_linestatus, {q6('avg(l_extendedprice / 999.9991)', 'x_mean')}, {q6('stddev_samp(l_extendedprice / 999.9991)', 'x_sd')},
      count(l_extendedprice) AS x_n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def annotation_stats(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_linestatus", "l_returnflag", (F.col("l_extendedprice") / 999.9991).alias("v"))
    out = df.where(F.col("l_returnflag") == "R").groupBy("l_linestatus").agg(*G.mean_sd_n("v", "x"))
    return rounded(out, ["x_mean", "x_sd"])


@query(
    "subtotals",
    f"""SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS status, count(*) AS n,
      {q6('avg(l_quantity)', 'mean_quantity')} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""",
)
def subtotals(spark, sf) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    out = _li(spark, sf, "l_returnflag", "l_linestatus", "l_quantity").groupingSets([[a, b], [a]], a, b).agg(
        F.grouping("l_linestatus").alias("g"), F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean_quantity")
    )
    status = F.when(F.col("g") == 1, F.lit("All")).otherwise(F.col("l_linestatus"))
    return out.select("l_returnflag", status.alias("status"), "n", "mean_quantity")


@query(
    "nearest_target",
    """WITH t AS (SELECT l_partkey, l_orderkey, l_quantity, abs(l_quantity - 23) AS gap FROM lineitem),
    m AS (SELECT l_partkey, min(gap) AS best FROM t GROUP BY 1)
    SELECT t.l_partkey, l_orderkey, l_quantity FROM t JOIN m ON t.l_partkey = m.l_partkey AND gap = best""",
)
def nearest_target(spark, sf) -> DataFrame:
    return G.keep_nearest(_li(spark, sf, "l_partkey", "l_orderkey", "l_quantity"), ["l_partkey"], "l_quantity", 23.0)


@query(
    "keep_first",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def keep_first(spark, sf) -> DataFrame:
    return G.keep_first(_li(spark, sf, *ROW_KEY), ["l_partkey"], ROW_KEY)


@query(
    "poisoned_groups",
    """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN
      (SELECT l_orderkey FROM lineitem WHERE log10(l_extendedprice) > 4.9) GROUP BY 1""",
)
def poisoned_groups(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_orderkey", "l_extendedprice")
    kept = G.drop_poisoned_groups(df, ["l_orderkey"], S.log10("l_extendedprice") > 4.9)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "group_size_filter",
    """WITH big AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 30),
    wide AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 28)
    SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT * FROM big) AND l_partkey IN (SELECT * FROM wide) GROUP BY 1""",
)
def group_size_filter(spark, sf) -> DataFrame:
    df = G.keep_large_groups(_li(spark, sf, "l_partkey", "l_suppkey"), ["l_partkey"], 30)
    return G.keep_diverse_groups(df, ["l_partkey"], "l_suppkey", 28).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query(
    "results_on_rows",
    f"""WITH m AS (SELECT l_suppkey, count(*) AS n_rows, avg(l_quantity) AS mean_q, min(l_quantity) AS min_q, median(l_quantity) AS med_q,
      count(DISTINCT l_partkey) AS n_parts, max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_quantity END) AS ref_q
      FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l.l_suppkey, l_quantity, n_rows, {q6('mean_q')}, min_q, {q6('med_q')}, n_parts, ref_q
    FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey""",
)
def results_on_rows(spark, sf) -> DataFrame:
    """Count, mean, minimum, median, distinct count and a reference row's value on every row."""
    df = _li(spark, sf, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    reference = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    out = G.attach(
        df, ["l_suppkey"], F.count("*").alias("n_rows"), r6(F.avg("l_quantity")).alias("mean_q"), F.min("l_quantity").alias("min_q"),
        F.max(F.when(reference, F.col("l_quantity"))).alias("ref_q"),
    )
    out = G.attach_distinct(out, ["l_suppkey"], "l_partkey", "n_parts")
    med = O.medians(df, ["l_suppkey"], "l_quantity", "med_q").withColumn("med_q", r6("med_q"))
    return G.join_back(out, med, ["l_suppkey"], "left").drop("l_returnflag")


def _sparse_cols(spark, sf) -> DataFrame:
    e = wide_descriptors(table(spark, sf, "embeddings"), "embedding", 64, "e", ["vec_id", "label"])
    return e.withColumns(
        {
            "e3": F.when(F.col("label") != 9, F.col("e3")), "e4": F.when(F.col("label") != 9, F.col("e4")),
            "e5": F.when(F.col("label") != 8, F.col("e5")),
        }
    )


@query(
    "drop_sparse_rows_cols",
    f"""SELECT vec_id, {', '.join(q6(f'embedding[{i + 1}]', f'e{i}') for i in range(64) if i != 5)} FROM embeddings WHERE label <> 9""",
)
def drop_sparse_rows_cols(spark, sf) -> DataFrame:
    cols = [f"e{i}" for i in range(64)]
    df = G.drop_sparsest_rows(_sparse_cols(spark, sf), cols)
    kept = G.complete_columns(df, cols)
    return rounded(df.select("vec_id", *kept), kept)


@query(
    "class_profile_wide",
    "WITH p AS (SELECT event_type, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS med, "
    "avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT "
    + ", ".join(
        q6(f"max(CASE WHEN event_type = '{c}' THEN {m} END)", f"cat{c}_{m}")
        for c in EVENT_TYPES
        for m in ("p05", "p95", "med", "mean", "sd")
    )
    + " FROM p",
)
def class_profile_wide(spark, sf) -> DataFrame:
    """Quantiles, median, mean and sd per class, spread to one row."""
    df = table(spark, sf, "events").select("event_type", "value")
    q = O.quantiles(df, ["event_type"], "value", {"p05": 0.05, "p95": 0.95, "med": 0.5}).drop("n_total")
    both = q.join(df.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "event_type")
    long = sets.melt(both, ["event_type"], ["p05", "p95", "med", "mean", "sd"], "measure", "v")
    picks = [
        r6(F.max(F.when((F.col("event_type") == c) & (F.col("measure") == m), F.col("v")))).alias(f"cat{c}_{m}")
        for c in EVENT_TYPES
        for m in ("p05", "p95", "med", "mean", "sd")
    ]
    return long.agg(*picks)


@query(
    "string_agg",
    """SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments,
      string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS distinct_segments FROM customer GROUP BY 1""",
)
def string_agg(spark, sf) -> DataFrame:
    df = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    return G.concat_values(df, ["c_nationkey"], "c_mktsegment", "segments").join(
        G.concat_values(df, ["c_nationkey"], "c_mktsegment", "distinct_segments", distinct=True), "c_nationkey"
    )


@query(
    "top_k_mean",
    f"""SELECT l_suppkey, {q6('m', 'mean_price')} FROM (SELECT l_suppkey, avg(l_extendedprice / 999.9991) AS m FROM lineitem GROUP BY 1)
    ORDER BY m DESC, l_suppkey LIMIT 25""",
)
def top_k_mean(spark, sf) -> DataFrame:
    mean = _li(spark, sf, "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(F.avg(F.col("l_extendedprice") / 999.9991).alias("m"))
    return G.top_k(mean, "m", 25, "l_suppkey").select("l_suppkey", r6("m").alias("mean_price"))


@query(
    "argmin_tie",
    """WITH t AS (SELECT l_suppkey, l_linenumber AS setting, min(l_quantity) AS error FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, setting, error FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY error, setting DESC) AS rn FROM t)
    WHERE rn = 1""",
)
def argmin_tie(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_suppkey", F.col("l_linenumber").alias("setting"), "l_quantity")
    errors = df.groupBy("l_suppkey", "setting").agg(F.min("l_quantity").alias("error"))
    return G.best_setting(errors, "error", "setting", ["l_suppkey"])


@query(
    "count_by_condition",
    """SELECT l_quantity > 25 AS large, l_linestatus = 'F' AS filled, count(*) AS n, sum((l_discount > 0.05)::INT)::BIGINT AS n_discount
    FROM lineitem GROUP BY ALL""",
)
def count_by_condition(spark, sf) -> DataFrame:
    large, filled = (F.col("l_quantity") > 25).alias("large"), (F.col("l_linestatus") == "F").alias("filled")
    df = _li(spark, sf, "l_quantity", "l_linestatus", "l_discount")
    return df.groupBy(large, filled).agg(F.count("*").alias("n"), G.count_if(F.col("l_discount") > 0.05).alias("n_discount"))


@query(
    "source_split_counts",
    """SELECT CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'train' ELSE 'test' END AS split, source, count(*) AS n,
      count(DISTINCT lang) AS n_langs FROM documents d GROUP BY ALL""",
)
def source_split_counts(spark, sf) -> DataFrame:
    from permspark.operators.cleaning import label_members

    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    split = label_members(docs, "doc_id", table(spark, sf, "labels").select("doc_id"), "train", "test", "split")
    pairs = split.groupBy("split", "source", "lang").agg(F.count("*").alias("k"))
    return pairs.groupBy("split", "source").agg(F.sum("k").alias("n"), F.count("lang").alias("n_langs"))


@query(
    "table_summary",
    f"""SELECT {q6('avg(l_extendedprice / 999.9991)', 'mean')}, {q6('median(l_extendedprice / 999.9991)', 'med')}, {q6('min(l_extendedprice / 999.9991)', 'lo')},
      {q6('max(l_extendedprice / 999.9991)', 'hi')}, {q6('min(least(l_extendedprice / 999.9991, l_quantity))', 'min_all')},
      {q6('max(greatest(l_extendedprice / 999.9991, l_quantity))', 'max_all')} FROM lineitem""",
)
def table_summary(spark, sf) -> DataFrame:
    df = _li(spark, sf, (F.col("l_extendedprice") / 999.9991).alias("v"), "l_quantity")
    one = df.agg(F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), *G.range_over(["v", "l_quantity"]))
    med = O.medians(df, [], "v", "med")
    return rounded(one.withColumn("med", med.select("med").scalar()), ["mean", "med", "lo", "hi", "min_all", "max_all"])


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q6(f'avg({c})', 'mean')}, {q6(f'stddev_samp({c})', 'sd')}, count({c}) AS n FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def column_profile(spark, sf) -> DataFrame:
    return rounded(G.column_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), ["mean", "sd"])


@query(
    "distinct_rows",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_partkey, l_suppkey, l_quantity FROM lineitem)
    GROUP BY ALL""",
)
def distinct_rows(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity").distinct()
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "representative_value",
    f"""SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS first_supplier,
      {q6('avg(l_quantity)', 'mean_quantity')} FROM lineitem GROUP BY 1""",
)
def representative_value(spark, sf) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return _li(spark, sf, *ROW_KEY).groupBy("l_partkey").agg(
        G.representative("l_suppkey", order).alias("first_supplier"), r6(F.avg("l_quantity")).alias("mean_quantity")
    )


@query(
    "share_over_threshold",
    f"""SELECT l_returnflag, {q6('avg((l_extendedprice / 999.9991 > 50)::INT::DOUBLE)', 'share')},
      printf('%.0f%%', floor(avg((l_extendedprice / 999.9991 > 50)::INT::DOUBLE) * 100)) AS share_text FROM lineitem GROUP BY 1""",
)
def share_over_threshold(spark, sf) -> DataFrame:
    df = _li(spark, sf, "l_returnflag", (F.col("l_extendedprice") / 999.9991).alias("v"))
    out = df.groupBy("l_returnflag").agg(G.share_if(F.col("v") > 50).alias("share"))
    return out.select("l_returnflag", r6("share").alias("share"), S.percent_text(F.floor(F.col("share") * 100) / 100).alias("share_text"))
