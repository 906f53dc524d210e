"""Quoted CSV whose fields may hold line ends, read by many tasks; types inferred from all rows.

Spark's own reader gives such a file to one task, because a line end within quotes looks like any other from the middle of a file. Here lines are
read in splits. Every split reports whether it holds an odd number of quotes; a prefix sum over the splits of a file tells each one whether
it begins within quotes, and a running sum within the split tells which line ends end a record. Lines that are whole records go on as they are.
Only lines of records that span several are shuffled, by record, also across the cuts between splits.

Quotes are doubled within quoted fields. Fields that aren't quoted must not hold quotes. Line ends within fields become line feeds. A byte-order mark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from permspark.sources.writers import staged

LINES = "file string, block long, line long, quotes long, value string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split; the splits of a task come one after the other."""
    split, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, value = batch.columns
        change = np.ones(batch.num_rows, dtype=bool)
        same = pc.and_(pc.equal(file.slice(1), file.slice(0, len(file) - 1)), pc.equal(block.slice(1), block.slice(0, len(block) - 1)))
        change[1:] = ~same.to_numpy(zero_copy_only=False)
        change[0] = (file[0].as_py(), block[0].as_py()) != split
        starts = np.flatnonzero(change)
        at = np.arange(batch.num_rows)
        line = at - np.maximum.accumulate(np.where(change, at, 0))
        if not change[0]:
            line[: starts[0] if len(starts) else None] += done
        split, done = (file[-1].as_py(), block[-1].as_py()), int(line[-1]) + 1
        quotes = pc.cast(pc.count_substring(value, '"'), pa.int64())
        yield pa.RecordBatch.from_arrays([file, block, pa.array(line), quotes, value], names=["file", "block", "line", "quotes", "value"])


def read_records(spark: SparkSession, path) -> DataFrame:
    """(file, block, line, record): every record with the place at which it begins; places are in the order of the file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = staged(text.mapInArrow(_numbered, LINES))
    split = Window.partitionBy("file", "block").orderBy("line")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    splits = splits.select(F.col("file").alias("__f"), F.col("block").alias("__b"), (F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).alias("__odd"))
    here = (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b"))
    upto = F.coalesce(F.sum("quotes").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(splits, here).drop("__f", "__b").withColumn("__open", (F.col("__odd") + upto) % 2 == 1)
    begins = F.when(~F.col("__open"), F.col("line"))
    marked = marked.withColumn("__start", F.last(begins, ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ~F.col("__open") & (F.col("quotes") % 2 == 0)
    clean = F.when((F.col("block") == 0) & (F.col("line") == 0), F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("value")
    marked = marked.select("file", "block", "line", "__start", whole.alias("__whole"), clean)
    # lines before the first record of a split belong to the last record of an earlier one
    several = staged(marked.where(~F.col("__whole")))
    last = several.groupBy("file", "block").agg(F.max("__start").alias("__last"))
    place = F.when(F.col("__last").isNotNull(), F.struct("block", F.col("__last").alias("line")))
    carried = last.select(F.col("file").alias("__f"), F.col("block").alias("__b"), F.last(place, ignorenulls=True).over(earlier).alias("__from"))
    own = F.when(F.col("__start").isNotNull(), F.struct("block", F.col("__start").alias("line"))).otherwise(F.col("__from"))
    parts = several.join(carried, here).select("file", own.alias("__at"), F.struct("block", "line", "value").alias("__part"))
    joined = parts.groupBy("file", "__at").agg(F.array_sort(F.collect_list("__part")).alias("__parts"))
    long = joined.select("file", "__at.block", "__at.line", F.array_join(F.transform("__parts", lambda p: p["value"]), "\n").alias("record"))
    return marked.where("__whole").select("file", "block", "line", F.col("value").alias("record")).unionAll(long)


def read_quoted(spark: SparkSession, path, schema: str, skip: int = 0, sep: str = ",") -> DataFrame:
    """Records as columns of the schema, without the first `skip` records of every file (captions, banners, headers) and empty lines."""
    records = read_records(spark, path).where("record <> ''")
    if skip:
        first = Window.partitionBy("file").orderBy("block", "line")
        head = records.select("file", "block", "line").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= skip)
        ends = staged(head.groupBy(F.col("file").alias("__f")).agg(F.max(F.struct("block", "line")).alias("__end")))
        records = records.join(ends, F.col("file") == F.col("__f")).where(F.struct("block", "line") > F.col("__end"))
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return records.select(F.from_csv("record", F.lit(schema), options).alias("__r")).select("__r.*")


# --- types ---------------------------------------------------------------------------------------

#: Texts that count as missing, besides the empty one.
MISSING = ("NA",)
#: The texts of truth values.
TRUE, FALSE = ("TRUE", "True", "true", "T"), ("FALSE", "False", "false", "F")
#: Each kind with the test of a text; a column has the first kind that all its texts pass, and is text if there is none.
KINDS = {
    "boolean": lambda x: x.isin(*TRUE, *FALSE),
    "bigint": lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"),
    "double": lambda x: x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"),
    "date": lambda x: x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & x.try_cast("date").isNotNull(),
}


def present(c, missing=MISSING) -> Column:
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when((c != "") & ~c.isin(*missing), c)


def inferred_types(df: DataFrame, missing=MISSING) -> dict[str, str]:
    """Type of each text column, from all its rows: one aggregate of flags, which doesn't depend on splits or order.

    A column without values is boolean, as the least of the kinds.
    """
    aggs = [
        F.bool_and(F.coalesce(test(present(F.col(f"`{c}`"), missing)), F.lit(True))).alias(f"{i}_{kind}")
        for i, c in enumerate(df.columns)
        for kind, test in KINDS.items()
    ]
    row = df.agg(*aggs).first()
    return {c: next((kind for kind in KINDS if row[f"{i}_{kind}"] is not False), "string") for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str], missing=MISSING) -> DataFrame:
    """Text columns cast to their types, missing texts to NULL."""

    def cast(c: str, kind: str) -> Column:
        x = present(F.col(f"`{c}`"), missing)
        return (F.when(x.isNotNull(), x.isin(*TRUE)) if kind == "boolean" else x.cast(kind)).alias(c)

    return df.select(*[cast(c, types[c]) for c in df.columns])


def read_inferred(spark: SparkSession, path, sep: str = ",", missing=MISSING) -> DataFrame:
    """CSV with a header, types from all rows. The text is stored once and read twice."""
    raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("inferSchema", False).csv(path)
    raw = staged(raw.toDF(*[c.removeprefix("﻿") for c in raw.columns]))
    return typed(raw, inferred_types(raw, missing), missing)
