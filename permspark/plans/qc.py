"""Quality control of triplicate two-direction assay rows, recovery adjustment and entity statistics.

A wide assay row holds six channels (directions ab and ba, replicates 1 to 3), each with a value
`value_ab1`, a recovery `rec_ab1`, a comment `comment_ab1` and the original text `orig_ab1`. All rules
are row expressions: any number of cut-off scenarios is computed in one projection over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions.scalar import blank_to_null, in_set, log10, ratio, row_count, row_mean, row_sd
from permspark.operators.cleaning import filtered_flag
from permspark.operators.grouping import geometric_mean, log_sd
from permspark.operators.ordered import average_rank, join_keys, keep_groups, quantiles
from permspark.sources.writers import staged

DIRECTIONS = ("ab", "ba")
REPLICATES = (1, 2, 3)
CHANNELS = tuple(f"{d}{i}" for d in DIRECTIONS for i in REPLICATES)

# Comments that do not invalidate a value.
ACCEPTED_COMMENTS = ("LOD", "low_rec")


def in_bounds(rec: Column, low: float | None, high: float | None) -> Column:
    ok = rec.isNotNull()
    if low is not None:
        ok = ok & (rec >= low)
    if high is not None:
        ok = ok & (rec <= high)
    return ok


def check_channels(df: DataFrame, low: float | None, high: float | None, tag: str = "") -> DataFrame:
    """Apply the ordered rules to every channel; results go to v_<channel> and c_<channel> plus tag.

    Order: blank comments become missing; a missing comment with original text ND becomes ND; values
    at or below zero become missing with comment ND; values with any other comment become missing;
    values without a recovery inside the cut-offs become missing; comments still missing are labelled
    low_rec or high_rec.
    """
    first, second = {}, {}
    for ch in CHANNELS:
        value, rec = F.col(f"value_{ch}"), F.col(f"rec_{ch}")
        comment = blank_to_null(f"comment_{ch}")
        noted = F.when(comment.isNull() & (F.col(f"orig_{ch}") == "ND"), F.lit("ND")).otherwise(comment)
        first[f"__c_{ch}"] = F.when(value <= 0, F.lit("ND")).otherwise(noted)
        first[f"__v_{ch}"] = F.when(value <= 0, F.lit(None).cast("double")).otherwise(value)
        c, v = F.col(f"__c_{ch}"), F.col(f"__v_{ch}")
        usable = c.isNull() | in_set(c, ACCEPTED_COMMENTS)
        second[f"v_{ch}{tag}"] = F.when(usable & in_bounds(rec, low, high), v)
        label = c
        if low is not None:
            label = F.when(c.isNull() & (rec < low), F.lit("low_rec")).otherwise(label)
        if high is not None:
            label = F.when(c.isNull() & (rec > high), F.lit("high_rec")).otherwise(label)
        second[f"c_{ch}{tag}"] = label
    return df.withColumns(first).withColumns(second).drop(*first)


def synthesise(df: DataFrame, low: float | None, high: float | None, tag: str = "") -> DataFrame:
    """Mean and sd over replicates whose recovery is inside the cut-offs: value and recovery per direction.

    Follows check_channels with the same cut-offs, so the values are masked already. Masks, means and
    deviations are separate projections: each stays a small generated method that the JVM compiles.
    """
    masks, means, out = {}, {}, {}
    for d in DIRECTIONS:
        for i in REPLICATES:
            rec = F.col(f"rec_{d}{i}")
            masks[f"__r_{d}{i}"] = F.when(in_bounds(rec, low, high), rec)
        recs, values = [f"__r_{d}{i}" for i in REPLICATES], [f"v_{d}{i}{tag}" for i in REPLICATES]
        means[f"__mr_{d}"], means[f"__nr_{d}"] = row_mean(recs), row_count(recs)
        means[f"{d}{tag}"], means[f"__nv_{d}"] = row_mean(values), row_count(values)
        out[f"rec_{d}{tag}"] = F.when(F.col(f"__mr_{d}") >= 0, F.col(f"__mr_{d}"))
        out[f"sd_rec_{d}{tag}"] = row_sd(recs, f"__mr_{d}", f"__nr_{d}")
        out[f"sd_{d}{tag}"] = row_sd(values, f"{d}{tag}", f"__nv_{d}")
    helpers = [*masks, *[c for c in means if c.startswith("__")]]
    return df.withColumns(masks).withColumns(means).withColumns(out).drop(*helpers)


def adjust_recovery(df: DataFrame, threshold: float | None, tag: str = "") -> DataFrame:
    """Keep raw copies (ab0, ba0), divide values above the threshold by recovery, add efflux ratios.

    A threshold of None adjusts nothing.
    """
    adjusted = {}
    for d in DIRECTIONS:
        raw = F.col(f"{d}{tag}")
        adjusted[f"{d}0{tag}"] = raw
        if threshold is not None:
            adjusted[f"{d}{tag}"] = F.when(raw > threshold, ratio(raw, f"rec_{d}{tag}")).otherwise(raw)
    out = df.withColumns(adjusted)
    return out.withColumns(
        {
            f"efflux0{tag}": ratio(f"ba0{tag}", f"ab0{tag}"),
            f"efflux{tag}": ratio(f"ba{tag}", f"ab{tag}"),
        }
    )


def process(df: DataFrame, low: float | None, high: float | None, threshold: float | None, tag: str = "") -> DataFrame:
    return adjust_recovery(synthesise(check_channels(df, low, high, tag), low, high, tag), threshold, tag)


def entity_statistics(df: DataFrame, keys) -> DataFrame:
    """Replicate statistics per entity: one shuffle on the entity, partial sums before it.

    The spread of values is in log10 units; cv divides it by the linear-scale geometric mean, as the
    published definition does.
    """
    aggs: list[Column] = []
    for c in ("ab", "ba", "ab0", "ba0"):
        aggs += [geometric_mean(c).alias(f"gm_{c}"), log_sd(c).alias(f"lsd_{c}")]
    for c in ("efflux", "efflux0", "rec_ab", "rec_ba"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    aggs += [
        F.count("*").alias("n_rows"),
        F.count("rec_ab").alias("n_rec_ab"),
        F.count("rec_ba").alias("n_rec_ba"),
        F.count("ab").alias("n_ab"),
        F.count("ba").alias("n_ba"),
        F.count(log10("efflux")).alias("n_efflux"),
    ]
    stats = df.groupBy(*keys).agg(*aggs)
    return stats.withColumns({"cv_ab": ratio("lsd_ab", "gm_ab"), "cv_ab0": ratio("lsd_ab0", "gm_ab0")})


def publish(df: DataFrame, ids: list[str], low: float, high: float, threshold: float) -> DataFrame:
    """Adjusted, unadjusted and unfiltered versions of every row with the Filtered flag.

    Both scenarios come from the same row, so no join or positional alignment is involved.
    """
    both = process(process(df, low, high, threshold), None, None, None, "_unfilt")
    return both.select(
        *ids,
        "ab", "ba", "efflux", "rec_ab", "rec_ba",
        F.col("ab0").alias("ab_unadj"), F.col("ba0").alias("ba_unadj"), F.col("efflux0").alias("efflux_unadj"),
        "ab_unfilt", "ba_unfilt", F.col("efflux0_unfilt").alias("efflux_unfilt"),
        "rec_ab_unfilt", "rec_ba_unfilt",
        filtered_flag("ab_unfilt", "ab0").alias("filtered"),
    )


def repeated_entities(df: DataFrame, entity: str, value: str, at_least: int = 2, digits: int = 9) -> DataFrame:
    """Rows of entities with several values, their mean and the rank of that mean among entities.

    Means are compared after rounding to `digits`, so that equal means tie whatever the adding order.
    """
    known = df.where(F.col(value).isNotNull())
    means = known.groupBy(entity).agg(F.avg(value).alias("entity_mean"), F.count("*").alias("n_repeats"))
    means = staged(means.where(F.col("n_repeats") >= at_least).withColumn("__m", F.round("entity_mean", digits)))
    ranks = average_rank(means, [], "__m", "entity_rank").drop("__m")
    return known.join(staged(ranks), entity)


def batch_controls(df: DataFrame, batch: str, value: str, high_control: Column, low_control: Column, control: Column) -> DataFrame:
    """One row per batch: its control values beside the 5th and 95th percentile of its other rows."""
    controls = df.groupBy(batch).agg(
        F.max(F.when(high_control, F.col(value))).alias("high_control"),
        F.max(F.when(low_control, F.col(value))).alias("low_control"),
    )
    rest = df.where(~control).select(batch, value)
    return join_keys(controls, quantiles(rest, [batch], value, {"p05": 0.05, "p95": 0.95}).drop("n_total"), [batch], "left")
