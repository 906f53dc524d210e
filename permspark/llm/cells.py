"""Meeting the rows of two tables that share a cell, however many rows a cell has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from permspark.sources.writers import staged


def meet(left: DataFrame, right: DataFrame, key: list[str], most: int) -> DataFrame:
    """Both sides dealt by (cell, i, j), sorted, those of `left` (kind 0) before those of `right` (kind 1).

    Both have the column `cell` and otherwise the same columns. Cells without rows on both sides are left out. A cell of more than
    `most` rows on a side is cut into blocks by a hash of `key`; every pair of blocks is a part (i, j) of its own, so all rows of
    `left` meet all of `right` exactly once and no part is larger than about `most` rows of each side.
    """
    counts = [side.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name)) for side, name in ((left, "_bl"), (right, "_br"))]
    sizes = staged(counts[0].join(counts[1], "cell").withColumnRenamed("cell", "_cell"))
    cols = [c for c in left.columns if c != "cell"]

    def dealt(side: DataFrame, kind: int, blocks: str, others: str, names: tuple[str, str]) -> DataFrame:
        own = F.pmod(F.xxhash64(*key), F.col(blocks)).cast("int").alias(names[0])
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(names[1])
        met = side.join(sizes, F.col("cell") == F.col("_cell"))
        return met.select("cell", F.lit(kind).alias("kind"), *cols, own, each).select("cell", "i", "j", "kind", *cols)

    rows = dealt(left, 0, "_bl", "_br", ("i", "j")).unionAll(dealt(right, 1, "_br", "_bl", ("j", "i")))
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(whether a new part begins, kind, rows) for the rows of meet()."""
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n - 1, dtype=bool)
        for k in range(4):
            column = batch.column(k)
            changed |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            part = tuple(batch.column(k)[a].as_py() for k in range(3))
            yield part != before, batch.column(3)[a].as_py(), batch.slice(a, b - a)
            before = part
