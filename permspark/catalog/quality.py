"""QC queries over the assay view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from permspark.catalog.base import ASSAY_SQL, assay_wide, q6, qc_sql, query, r6, rounded, table
from permspark.operators.cleaning import apply_overrides
from permspark.operators.grouping import distinct_counts
from permspark.plans import qc
from permspark.sources.writers import staged

LOW, HIGH, THRESHOLD = 0.4, 1.6, 10.0

_STAT_COLS = (
    [f"{p}_{c}" for c in ("ab", "ba", "ab0", "ba0") for p in ("gm", "lsd")]
    + [f"{p}_{c}" for c in ("efflux", "efflux0", "rec_ab", "rec_ba") for p in ("mean", "sd")]
    + ["cv_ab", "cv_ab0"]
)
_COUNT_COLS = ["n_rows", "n_rec_ab", "n_rec_ba", "n_ab", "n_ba", "n_efflux"]


def _log(c: str) -> str:
    return f"log10(CASE WHEN {c} > 0 THEN {c} END)"


def _entity_sql(key: str) -> str:
    aggs = []
    for c in ("ab", "ba", "ab0", "ba0"):
        aggs += [f"pow(10, avg({_log(c)})) AS gm_{c}", f"stddev_samp({_log(c)}) AS lsd_{c}"]
    for c in ("efflux", "efflux0", "rec_ab", "rec_ba"):
        aggs += [f"avg({c}) AS mean_{c}", f"stddev_samp({c}) AS sd_{c}"]
    aggs += [
        "count(*) AS n_rows", "count(rec_ab) AS n_rec_ab", "count(rec_ba) AS n_rec_ba", "count(ab) AS n_ab",
        "count(ba) AS n_ba", f"count({_log('efflux')}) AS n_efflux",
    ]
    outs = [q6(c) for c in _STAT_COLS if not c.startswith("cv")]
    outs += [q6("lsd_ab / NULLIF(gm_ab, 0)", "cv_ab"), q6("lsd_ab0 / NULLIF(gm_ab0, 0)", "cv_ab0")]
    return f"""WITH {ASSAY_SQL}, {qc_sql('assay', LOW, HIGH, THRESHOLD, 'qc')},
    stats AS (SELECT {key}, {', '.join(aggs)} FROM qc GROUP BY {key})
    SELECT {key}, {', '.join(outs)}, {', '.join(_COUNT_COLS)} FROM stats"""


@query("entity_stats", _entity_sql("entity"))
def entity_stats(spark, sf) -> DataFrame:
    """Flagship: QC cascade, recovery adjustment and replicate statistics per entity."""
    checked = qc.process(assay_wide(spark, sf), LOW, HIGH, THRESHOLD)
    return rounded(qc.entity_statistics(checked, ["entity"]), _STAT_COLS)


_TRI = ["rec_ab", "sd_rec_ab", "rec_ba", "sd_rec_ba", "ab", "sd_ab", "ba", "sd_ba"]


@query(
    "triplicate_mask",
    f"""WITH {ASSAY_SQL}, {qc_sql('assay', LOW, HIGH, None, 'qc')}
    SELECT entity, batch, order_key, line, {', '.join(q6(c, c, 8) for c in _TRI)} FROM qc""",
)
def triplicate_mask(spark, sf) -> DataFrame:
    df = qc.process(assay_wide(spark, sf), LOW, HIGH, None)
    return rounded(df.select("entity", "batch", "order_key", "line", *_TRI), _TRI, 8)


_LABELS = " UNION ALL ".join(
    f"SELECT '{c}' AS channel, c_{c} AS comment, count(*) AS n_rows, count(v_{c}) AS n_values FROM qc_2 GROUP BY c_{c}"
    for c in qc.CHANNELS
)


@query("qc_labels", f"WITH {ASSAY_SQL}, {qc_sql('assay', LOW, HIGH, None, 'qc')} {_LABELS}")
def qc_labels(spark, sf) -> DataFrame:
    """Rows and surviving values per channel and final comment."""
    df = qc.check_channels(assay_wide(spark, sf), LOW, HIGH)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.col(f"c_{c}").alias("comment"), F.col(f"v_{c}").alias("v"))
            for c in qc.CHANNELS
        ]
    )
    long = df.select(F.inline(cells))
    return long.groupBy("channel", "comment").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_values"))


_PUB = ["ab", "ba", "efflux", "rec_ab", "rec_ba", "ab_unadj", "ba_unadj", "efflux_unadj", "ab_unfilt", "ba_unfilt",
        "efflux_unfilt", "rec_ab_unfilt", "rec_ba_unfilt"]
_PUB_SQL = {
    "ab_unadj": "ab0", "ba_unadj": "ba0", "efflux_unadj": "efflux0", "ab_unfilt": "u_ab0", "ba_unfilt": "u_ba0",
    "efflux_unfilt": "u_efflux0", "rec_ab_unfilt": "u_rec_ab", "rec_ba_unfilt": "u_rec_ba",
}


@query(
    "publish_filtered",
    f"""WITH {ASSAY_SQL}, keyed AS (SELECT *, row_number() OVER () AS rid FROM assay),
    {qc_sql('keyed', LOW, HIGH, THRESHOLD, 'f', ', rid')}, {qc_sql('keyed', None, None, None, 'u', ', rid')},
    pair AS (SELECT f.*, u.ab0 AS u_ab0, u.ba0 AS u_ba0, u.efflux0 AS u_efflux0, u.rec_ab AS u_rec_ab, u.rec_ba AS u_rec_ba
             FROM f JOIN u ON f.rid = u.rid)
    SELECT entity, batch, t_type, order_key, line, {', '.join(q6(_PUB_SQL.get(c, c), c, 8) for c in _PUB)},
      CASE WHEN u_ab0 IS NOT NULL AND ab0 IS NULL THEN 'Y' ELSE '' END AS filtered FROM pair""",
)
def publish_filtered(spark, sf) -> DataFrame:
    df = qc.publish(assay_wide(spark, sf), ["entity", "batch", "t_type", "order_key", "line"], LOW, HIGH, THRESHOLD)
    return rounded(df, _PUB, 8)


@query(
    "override_overlay",
    f"""WITH {ASSAY_SQL}, ov AS (SELECT o_orderkey AS order_key, min(o_totalprice) / 10000 AS u FROM orders
      WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
    fixed AS (SELECT assay.* REPLACE (coalesce(u, value_ab1) AS value_ab1, coalesce(u / 50, rec_ab1) AS rec_ab1)
      FROM assay LEFT JOIN ov USING (order_key)), {qc_sql('fixed', LOW, HIGH, THRESHOLD, 'qc')}
    SELECT batch, t_type, count(*) AS n_rows, count(ab) AS n_ab, {q6('avg(ab)', 'mean_ab')}, {q6('avg(rec_ab)', 'mean_rec_ab')}
    FROM qc GROUP BY batch, t_type""",
)
def override_overlay(spark, sf) -> DataFrame:
    """Keyed corrections applied before QC."""
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    over = o.groupBy(F.col("o_orderkey").alias("order_key")).agg((F.min("o_totalprice") / 10000).alias("update_value_ab1"))
    over = over.withColumn("update_rec_ab1", F.col("update_value_ab1") / 50)
    df = apply_overrides(assay_wide(spark, sf).join(over, "order_key", "left"), ["value_ab1", "rec_ab1"])
    done = qc.process(df, LOW, HIGH, THRESHOLD)
    return done.groupBy("batch", "t_type").agg(
        F.count("*").alias("n_rows"), F.count("ab").alias("n_ab"), r6(F.avg("ab")).alias("mean_ab"),
        r6(F.avg("rec_ab")).alias("mean_rec_ab"),
    )


@query(
    "distinct_counts",
    f"""WITH {ASSAY_SQL}, {qc_sql('assay', LOW, HIGH, THRESHOLD, 'qc')}
    SELECT t_type, count(DISTINCT CASE WHEN ab IS NOT NULL THEN entity END) AS n_ab,
      count(DISTINCT CASE WHEN ba IS NOT NULL THEN entity END) AS n_ba,
      count(DISTINCT CASE WHEN ab IS NOT NULL OR ba IS NOT NULL THEN entity END) AS n_either,
      count(DISTINCT CASE WHEN ab > 60 AND ba > 60 THEN entity END) AS n_both_large,
      count(DISTINCT entity) AS n_all FROM qc GROUP BY t_type""",
)
def entity_counts(spark, sf) -> DataFrame:
    df = qc.process(assay_wide(spark, sf), LOW, HIGH, THRESHOLD)
    has_ab, has_ba = F.col("ab").isNotNull(), F.col("ba").isNotNull()
    tests = {
        "n_ab": has_ab, "n_ba": has_ba, "n_either": has_ab | has_ba,
        "n_both_large": F.coalesce((F.col("ab") > 60) & (F.col("ba") > 60), F.lit(False)), "n_all": F.lit(True),
    }
    return distinct_counts(df, "entity", tests, ["t_type"])


@query(
    "batch_controls",
    f"""WITH {ASSAY_SQL}, {qc_sql('assay', LOW, HIGH, THRESHOLD, 'qc')}
    SELECT batch, {q6("max(CASE WHEN t_type = 'control' AND status = 'O' THEN ab END)", 'high_control')},
      {q6("max(CASE WHEN t_type = 'control' AND status = 'F' THEN ab END)", 'low_control')},
      {q6("quantile_cont(CASE WHEN t_type <> 'control' THEN ab END, 0.05)", 'p05')},
      {q6("quantile_cont(CASE WHEN t_type <> 'control' THEN ab END, 0.95)", 'p95')}
    FROM qc GROUP BY batch""",
)
def batch_controls(spark, sf) -> DataFrame:
    df = qc.process(assay_wide(spark, sf), LOW, HIGH, THRESHOLD).select("batch", "t_type", "status", "ab")
    df = staged(df)
    control = F.col("t_type") == "control"
    out = qc.batch_controls(df, "batch", "ab", control & (F.col("status") == "O"), control & (F.col("status") == "F"), control)
    return rounded(out, ["high_control", "low_control", "p05", "p95"])


@query(
    "dup_rank",
    f"""WITH {ASSAY_SQL}, {qc_sql('assay', None, None, None, 'qc')},
    rep AS (SELECT entity, avg(ab) AS m, count(*) AS n FROM qc WHERE ab IS NOT NULL GROUP BY entity HAVING count(*) >= 2),
    ranked AS (SELECT entity, m, n, rank() OVER (ORDER BY round(m, 9)) + (count(*) OVER (PARTITION BY round(m, 9)) - 1) / 2.0 AS r FROM rep)
    SELECT qc.entity, qc.order_key, qc.line, {q6('ab', 'ab', 8)}, {q6('m', 'entity_mean', 8)}, n AS n_repeats, r::DOUBLE AS entity_rank
    FROM qc JOIN ranked ON qc.entity = ranked.entity WHERE ab IS NOT NULL""",
)
def dup_rank(spark, sf) -> DataFrame:
    df = qc.process(assay_wide(spark, sf), None, None, None).select("entity", "order_key", "line", "ab")
    df = staged(df)
    out = qc.repeated_entities(df, "entity", "ab")
    return rounded(out.select("entity", "order_key", "line", "ab", "entity_mean", "n_repeats", "entity_rank"), ["ab", "entity_mean"], 8)
