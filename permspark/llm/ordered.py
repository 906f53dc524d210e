"""Running totals over an order that no single task has to hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.sources.writers import staged


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """For each pair value, name: the sum of `value` over the earlier rows of the group.

    Rows are range-sorted by group and order and stored with the number of their range. Totals per range and group are summed up to
    offsets; within a range a window runs over the rows of one group. A hot group is spread over many ranges. Rows equal in group and
    order must be interchangeable. The sums don't depend on where ranges begin.
    """
    ranged = df.repartitionByRange(parallelism(df), *group, *order)
    stored = staged(ranged.withColumn("_range", F.spark_partition_id()))
    totals = stored.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_sum_{n}") for v, n in values.items()])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values.values()],
    )
    own = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = stored.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(n) for v, n in values.items()])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_r"))
    out = rows.join(offsets, same)
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in values.values()])


def neighbours(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `before` and `after`: structs of the order columns and `value` of the rows next to each row in its group, or null.

    Rows of a range find each other in a window over the range; across ranges only the first and last rows are looked at.
    Rows must differ in group and order.
    """
    ranged = df.repartitionByRange(parallelism(df), *group, *order)
    row = F.struct(*group, *order, value)
    stored = staged(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", row))
    place = F.struct(*group, *order)
    ends = stored.groupBy("_range").agg(F.min_by("_row", place).alias("_first"), F.max_by("_row", place).alias("_last"))
    by_range = Window.orderBy("_range")  # one row for each range
    ends = ends.select(
        F.col("_range").alias("_r"), F.lag("_last").over(by_range).alias("_earlier"), F.lead("_first").over(by_range).alias("_later")
    )
    own = Window.partitionBy("_range").orderBy(*group, *order)
    rows = stored.select("*", F.lag("_row").over(own).alias("_lag"), F.lead("_row").over(own).alias("_lead"))
    rows = rows.join(ends, F.col("_range") == F.col("_r"))

    def beside(near: str, far: str) -> Column:
        found = F.coalesce(F.col(near), F.col(far))
        same = reduce(lambda a, b: a & b, [found[g].eqNullSafe(F.col(g)) for g in group], F.lit(True))
        return F.when(same, found)

    return rows.select(*df.columns, beside("_lag", "_earlier").alias("before"), beside("_lead", "_later").alias("after"))
