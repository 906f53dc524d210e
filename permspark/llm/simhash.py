"""SimHash near-duplicates with pivot distance tables.

Fingerprint: a bit is set if it is set in more than half of the hashes of the text's word shingles. Fingerprints with at most
DISTANCE differing bits are linked; documents of one connected component are near copies.

The table holds each distinct fingerprint's Hamming distances to fixed reference fingerprints. For references r and 0, the distances
give the number of set bits under r, so the STRIPES references of two bits each describe a fingerprint by STRIPES coordinates of which
linked fingerprints differ in at most DISTANCE. Cut into GROUPS groups, linked fingerprints agree on all groups but DISTANCE: they meet
in a cell keyed by the remaining groups, of which there is one for each choice. Within a cell a pair is discarded when any
coordinate, also those of the SCATTERED pseudo-random references, differs by more than DISTANCE; survivors are verified bit by bit.

Copies share a fingerprint, so they count once. In a cell, linked fingerprints are gathered breadth-first, each is compared with
those not reached yet, and only a spanning forest is emitted. A cell of more than CELL fingerprints is cut into blocks, and
every pair of blocks is a task of its own.

Null and empty texts have no shingles: fingerprint zero, linked like any other. Null ids belong to a group but don't name it,
unless the group has no other. Repeated rows are copies. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from permspark.llm.components import components
from permspark.llm.ordered import parallelism
from permspark.llm.text import KINDS, LOWER_BYTES, text_key, utf8
from permspark.sources.writers import staged

SHINGLE = 3
HASH_SEED = 42
DISTANCE = 3
STRIPES, GROUPS, SCATTERED = 32, 6, 16
#: Most fingerprints of a cell, and of a block of a larger cell, that one task compares.
CELL = 20_000
#: Links that a task gathers before it emits a forest of them.
FOREST = 500_000


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint as a signed integer."""
    words = utf8(text).translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last))
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for long texts
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(KINDS["long"])
def fingerprints_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def references() -> np.ndarray:
    """0, the two-bit stripes, and pseudo-random fingerprints (hashes of their numbers)."""
    stripes = [3 << (2 * k) for k in range(STRIPES)]
    scattered = [xxhash.xxh64_intdigest(k.to_bytes(8, "little"), HASH_SEED) for k in range(SCATTERED)]
    return np.array([0, *stripes, *scattered], dtype=np.uint64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (row) to every reference (column)."""
    return np.bitwise_count(prints.view(np.uint64)[:, None] ^ references()[None, :]).astype(np.int8)


def cell_keys(table: np.ndarray) -> np.ndarray:
    """One key for each choice of GROUPS - DISTANCE groups of stripes (columns of the result)."""
    under = (table[:, :1].astype(np.int64) + 2 - table[:, 1 : STRIPES + 1]) // 2  # set bits under each stripe: 0 to 2
    groups = []
    for columns in np.array_split(np.arange(STRIPES), GROUPS):
        code = np.zeros(len(table), dtype=np.int64)
        for c in columns:
            code = code * 3 + under[:, c]
        groups.append(code)
    keys = []
    for number, chosen in enumerate(combinations(range(GROUPS), GROUPS - DISTANCE)):
        key = np.full(len(table), number, dtype=np.int64)
        for g in chosen:
            key = key * 3 ** -(-STRIPES // GROUPS) + groups[g]
        keys.append(key)
    return np.stack(keys, axis=1)


@F.pandas_udf(KINDS["array<long>"])
def cells_of(prints: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in prints:
        yield pd.Series(list(cell_keys(distance_table(batch.to_numpy(dtype=np.int64)))))


def near(prints: np.ndarray, table: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Those of `others` linked with k: first by the largest coordinate difference, then by the bits themselves."""
    left = others[np.abs(table[others] - table[k]).max(axis=1) <= DISTANCE]
    return left[np.bitwise_count(prints[left] ^ prints[k]) <= DISTANCE]


def links_in(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one cell (distinct fingerprints)."""
    if len(prints) < 2:
        return
    prints = prints.view(np.uint64)
    table, rest = distance_table(prints), np.arange(len(prints))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            k = frontier.pop()
            found = near(prints, table, k, rest)
            if len(found):
                rest = np.setdiff1d(rest, found, assume_unique=True)
                frontier += found.tolist()
                a = int(prints[k].view(np.int64))
                yield from ((a, int(b)) for b in prints[found].view(np.int64))


def small_cell_links(prints: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """All links of many cells of one small size; a row holds a cell."""
    flat = prints.view(np.uint64)
    table = distance_table(flat.ravel()).reshape(*flat.shape, -1)
    for i in range(size):
        for j in range(i + 1, size):
            left = np.flatnonzero(np.abs(table[:, i] - table[:, j]).max(axis=1) <= DISTANCE)
            left = left[np.bitwise_count(flat[left, i] ^ flat[left, j]) <= DISTANCE]
            yield from zip(prints[left, i].tolist(), prints[left, j].tolist())


class Forest:
    """Union-find over the links of one task; emits (node, root) and starts anew when it grows large."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = up.setdefault(x, x)
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def add(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def emit(self) -> pa.RecordBatch:
        pairs = [(x, self.top(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        self.up = {}
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
        )


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (cell, i, j, fp) that come sorted by cell and block pair; a cell may span batches."""
    forest, held_key, held = Forest(), None, []

    def finished(prints: np.ndarray):
        for a, b in links_in(np.unique(prints)):
            forest.add(a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, i, j, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        starts = np.concatenate(([0], change))
        ends = np.concatenate((change, [len(cell)]))
        first, last = (cell[0], i[0], j[0]), (cell[-1], i[-1], j[-1])
        if held and held_key != first:
            finished(np.concatenate(held))
            held = []
        if len(starts) == 1:  # one cell fills the batch
            held_key, held = first, [*held, fp]
            continue
        finished(np.concatenate([*held, fp[: ends[0]]]))
        held_key, held = last, [fp[starts[-1] :]]
        sizes = ends[1:-1] - starts[1:-1]
        for size in np.unique(sizes):
            chosen = starts[1:-1][sizes == size]
            if size < 2:
                continue
            if size <= 8:
                for a, b in small_cell_links(fp[chosen[:, None] + np.arange(size)], int(size)):
                    forest.add(a, b)
            else:
                for start in chosen:
                    finished(fp[start : start + size])
            if len(forest.up) > FOREST:
                yield forest.emit()
    if held:
        finished(np.concatenate(held))
    yield forest.emit()


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect what is near, from distinct fingerprints (fp)."""
    cells = prints.select("fp", F.explode(cells_of("fp")).alias("cell"))
    counts = staged(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("cell", "_cell"))
    met = cells.join(counts, F.col("cell") == F.col("_cell"))
    blocks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = met.select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    pairs = pairs.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = pairs.repartition(parallelism(prints), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(cell_links, "a long, b long")


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the document's group."""
    prints = staged(docs.select("doc_id", fingerprints_of("text").alias("fp")))
    least = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(least.select("fp"), cell))
    roots = staged(found.join(least, found.node == least.fp).select("root", "node", "least"))
    groups = staged(roots.groupBy("root").agg(F.min("least").alias("component")))
    named = roots.join(groups, "root").select("node", "component")
    rep = least.join(named, least.fp == named.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id"))
    return prints.join(rep, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_print(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, cell: int = CELL, unnamed: bool = False) -> DataFrame:
    """One row of each group of near copies, with its own columns: the least by id, then by hash of its text.

    Rows that share an id, but not the group, stand for their own groups. With `unnamed`, rows without an id belong to the groups, too, after
    those with one; else only their exact copies among themselves go. Of rows equal in id and text the one with the least hash of all columns stays.
    """
    hashed = docs.select("doc_id", text_key(F.col("text")).alias("_h"), fingerprints_of("text").alias("fp"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("_d"), F.col("_h").alias("_g"))
    prints = staged(hashed if unnamed else hashed.filter("doc_id IS NOT NULL"))
    least = staged(prints.groupBy("fp").agg(F.min(key).alias("least")))
    found = staged(components(links(least.select("fp"), cell)))
    grouped = least.join(found, least.fp == found.node, "left").select(F.coalesce("root", "fp").alias("group"), "least")
    first = staged(grouped.groupBy("group").agg(F.min("least").alias("least")).select("least._d", "least._g").distinct())
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(whole.alias("_row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_h"), F.xxhash64(F.to_json(whole)).alias("_w"))
    chosen = rows.join(first, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left_semi")
    if not unnamed:
        chosen = chosen.unionAll(rows.filter("_id IS NULL"))
    return chosen.groupBy("_id", "_h").agg(F.min_by("_row", "_w").alias("_row")).select("_row.*")
