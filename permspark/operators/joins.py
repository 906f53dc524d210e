"""Keyed joins. The driving table keeps all its rows; lookups are reduced to one row per key first.

No side is broadcast by hand unless it is a literal table; adaptive execution broadcasts a side whose measured size is below its
threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from permspark.operators.grouping import concat_values, keep_first
from permspark.operators.ordered import join_keys, ranked_values, sequence_index
from permspark.sources.writers import staged


def lookup(base: DataFrame, dim: DataFrame, on: list[str], match_missing: bool = False) -> DataFrame:
    """Every row of base with the matching columns of dim; a missing key matches only on request."""
    if match_missing:
        return join_keys(base, dim, on, "left")
    return base.join(dim, on, "left")


def lookup_one(base: DataFrame, dim: DataFrame, on: list[str], order_cols) -> DataFrame:
    """Lookup against the first row per key, so that base never fans out."""
    return base.join(staged(keep_first(dim, on, order_cols)), on, "left")


def star(base: DataFrame, facts: list[DataFrame], on: list[str]) -> DataFrame:
    """Facts joined to base on the same keys. Store aggregated facts (`staged`) if base has hot keys, so that these are split."""
    return reduce(lambda acc, fact: acc.join(fact, on, "left"), facts, base)


def full_outer_chain(tables: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables)


def prefer(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Resolve clashing columns after a join: fill {column: fallback column}, drop the fallback."""
    return df.withColumns({c: F.coalesce(c, alt) for c, alt in pairs.items()}).drop(*pairs.values())


def update_from(base: DataFrame, table: DataFrame, key: str, col: str, order_cols) -> DataFrame:
    """Overwrite `col` on matched rows only."""
    new = keep_first(table.select(key, col, *[c for c in order_cols if c not in (key, col)]), [key], order_cols)
    new = staged(new.select(key, F.col(col).alias("__new")))
    return base.join(new, key, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")


def self_attach(df: DataFrame, other: DataFrame, on: list[str], cols: list[str], suffix: str) -> DataFrame:
    """Alternative versions of columns from another version of the same table."""
    return join_keys(df, other.select(*on, *[F.col(c).alias(f"{c}{suffix}") for c in cols]), on, "left")


def align_scenarios(df: DataFrame, key: list[str], scenario: str, values: dict[str, str], cols: list[str]) -> DataFrame:
    """One row per entity with each scenario's columns side by side.

    `values` maps a scenario value to the suffix of its columns. One grouped pass, no self join.
    """
    picks = [
        F.max(F.when(F.col(scenario) == v, F.col(c))).alias(f"{c}_{suffix}") for v, suffix in values.items() for c in cols
    ]
    return df.groupBy(*key).agg(*picks)


def upsert_means(
    base: DataFrame,
    source: DataFrame,
    key: str,
    measures: dict[str, str],
    references: dict[str, str],
    only_if_missing: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Per-key means and joined references merged into base; unknown keys are appended.

    `measures` and `references` map a source column to the new column. A measure listed in
    `only_if_missing` is kept only where all the named base columns are missing.
    """
    means = source.groupBy(key).agg(*[F.avg(c).alias(out) for c, out in measures.items()])
    for c, out in references.items():
        means = means.join(concat_values(source, [key], c, out), key, "left")
    merged = base.join(means, key, "full_outer")
    for out, guards in (only_if_missing or {}).items():
        free = reduce(lambda a, b: a & b, [F.col(g).isNull() for g in guards])
        merged = merged.withColumn(out, F.when(free, F.col(out)))
    return merged


def resolve_ids(
    base: DataFrame, by_id: DataFrame, by_name: DataFrame, id_col: str, name_col: str, target: str, missing_prefix: str
) -> DataFrame:
    """Resolve by identifier, else by name, else a synthetic id; `route` says which.

    by_id has (id_col, target), by_name has (name_col, target); both are reduced to the smallest
    target per key first.
    """
    ids = staged(by_id.groupBy(id_col).agg(F.min(target).alias("__by_id")))
    names = staged(by_name.groupBy(name_col).agg(F.min(target).alias("__by_name")))
    joined = base.join(ids, id_col, "left").join(names, name_col, "left")
    return joined.withColumns(
        {
            target: F.coalesce("__by_id", "__by_name", F.concat(F.lit(missing_prefix), F.col(name_col))),
            "route": F.when(F.col("__by_id").isNotNull(), F.lit("use_id"))
            .when(F.col("__by_name").isNotNull(), F.lit("use_name"))
            .otherwise(F.lit("unresolved")),
        }
    ).drop("__by_id", "__by_name")


def interval_join(df: DataFrame, value: str, bins: DataFrame, lo: str, hi: str, ranges: int | None = None) -> DataFrame:
    """Attach the bin with lo < value <= hi from a table of disjoint bins; NULL outside. A bin with a missing edge holds nothing.

    The bin of a value is the one whose number equals the count of lower edges below the value. Counting edges below every distinct
    value is an exact rank, and the rest are equi-joins: no value is ever compared with more than one bin, however the bins are spread.
    """
    bins = staged(bins)
    whole = bins.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    edges = whole.select(F.col(lo).cast("double").alias("__v"), F.lit(1).alias("__w"))
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")).distinct()
    both = edges.unionByName(values.withColumn("__w", F.lit(0)))
    place = ranked_values(both, [], "__v", F.col("__w"), ranges).select("__v", F.col("n_before").alias("__i"))
    numbered = sequence_index(whole, [lo], out="__i", ranges=ranges).drop("n_total")
    found = place.join(numbered, "__i").where(F.col("__v") <= F.col(hi)).drop("__i")
    return df.withColumn("__v", F.col(value).cast("double")).join(staged(found), "__v", "left").drop("__v")


def _dyadic(first: Column, last: Column, levels: int) -> Column:
    """Cells (level, cell) of a binary tree over whole numbers that make up first..last: two for each level at most.

    Cell c of level l holds the numbers from c * 2**l on, 2**l of them.
    """
    start = F.struct(first.cast("bigint").alias("a"), (last + 1).cast("bigint").alias("b"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))

    def step(s, level):
        open_, a, b = s["a"] < s["b"], s["a"], s["b"]
        left, right = open_ & (a % 2 == 1), open_ & (b % 2 == 1)
        right = right & (F.when(left, a + 1).otherwise(a) < b)
        cells = F.concat(
            s["cells"], F.when(left, F.array(F.struct(level.alias("level"), a.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>")),
            F.when(right, F.array(F.struct(level.alias("level"), (b - 1).alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>")),
        )
        up = F.floor((F.when(left, a + 1).otherwise(a)) / 2).cast("bigint"), F.floor(F.when(right, b - 1).otherwise(b) / 2).cast("bigint")
        return F.struct(up[0].alias("a"), up[1].alias("b"), cells.alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["cells"])


def overlap_join(df: DataFrame, value: str, bins: DataFrame, lo: str, hi: str, ranges: int | None = None) -> DataFrame:
    """Attach every bin with lo < value <= hi from a table of bins that may overlap and nest; rows without a bin keep one row of NULLs.

    Edges are numbered, so a bin is a run of whole numbers and a value one of them. A run is cut into dyadic cells, about two for each level of a
    binary tree; a number lies in one cell of each level. So numbers and bins meet in equi-joins on cells, and only pairs that belong together
    are made. A bin with a missing edge, or without room between its edges, holds nothing.

    Cells and pairs are many more than the sizes of their tables tell, so the hints keep Spark from broadcasting them.
    """
    bins = staged(bins.select(F.struct(*bins.columns).alias("__bin"), F.col(lo).cast("double").alias("__lo"), F.col(hi).cast("double").alias("__hi")))
    whole = bins.where("__lo < __hi")
    edges = staged(whole.select(F.col("__lo").alias("__v")).union(whole.select("__hi")).distinct())
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")).distinct()
    both = edges.withColumn("__w", F.lit(1)).unionByName(values.withColumn("__w", F.lit(0)))
    place = staged(ranked_values(both, [], "__v", F.col("__w"), ranges).select("__v", F.col("n_before").alias("__i")))
    levels = max(edges.count().bit_length(), 1)
    first = place.select(F.col("__v").alias("__lo"), (F.col("__i") + 1).alias("__first"))
    last = place.select(F.col("__v").alias("__hi"), F.col("__i").alias("__last"))
    runs = whole.join(first, "__lo").join(last, "__hi").select("__bin", F.inline(_dyadic(F.col("__first"), F.col("__last"), levels)))
    met = place.join(values, "__v", "left_semi").select("__i").distinct()
    above = met.select("__i", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    above = above.withColumn("cell", F.expr("shiftright(__i, level)"))
    pairs = staged(above.hint("merge").join(runs, ["level", "cell"]).select("__i", "__bin"))
    numbered = df.withColumn("__v", F.col(value).cast("double")).join(place, "__v", "left").drop("__v")
    return numbered.join(pairs.hint("merge"), "__i", "left").drop("__i").select(*df.columns, "__bin.*")


def set_lookup(df: DataFrame, value: str, sets: DataFrame, members: str, index: str) -> DataFrame:
    """Attach the index of the set (an array column) that contains the value."""
    flat = sets.select(F.explode(members).alias(value), index).groupBy(value).agg(F.min(index).alias(index))
    return df.join(staged(flat), value, "left")


def map_values(df: DataFrame, col: str, table: dict[str, tuple], names: list[str], how: str = "inner") -> DataFrame:
    """Join a literal mapping table; the literal is bounded by the source text, so it is broadcast."""
    spark = df.sparkSession
    rows = [(k, *v) for k, v in table.items()]
    fields = [f"`{col}` string"] + [f"`{n}` {_kind(v)}" for n, v in zip(names, rows[0][1:])]
    return df.join(F.broadcast(spark.createDataFrame(rows, ", ".join(fields))), col, how)


def _kind(v) -> str:
    return {bool: "boolean", int: "int", float: "double", str: "string"}[type(v)]


def unmatched(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet known."""
    return df.join(known.select(key), key, "left_anti")


def restricted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def row_by_number(df: DataFrame, numbered: DataFrame, number: str) -> DataFrame:
    """Lookup by an explicit row number column. Only the numbers in use are joined: if these are few, no hot number is shuffled."""
    used = numbered.join(df.select(number).distinct(), number, "left_semi")
    return df.join(staged(used), number, "left")
