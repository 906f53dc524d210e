"""Approximate nearest neighbours by inner product: p-stable hashing, buckets visited in the order of estimated success.

Vectors that are equal count once and carry their smallest ids, more of which no list can hold. A band holds vectors whose lengths differ by a
factor of two at most; they are divided by the band's largest length. A table projects them on a few Gaussian directions
and cuts every projection into cells of one width; the cells of all directions are the bucket.

Of a query with projection f, a vector with inner product s (both scaled) has a projection that is normal with mean s f and variance
1 - s**2. So the chance that it lies in a bucket is a product over directions. For every query and table the buckets are visited from
the most to the least likely, until the chances add up to what the tables need to find a vector with probability SUCCESS. The inner product s
that counts is that of the last neighbour of a bounded sample of queries, measured against all rows, so the effort follows the data.

The vectors of a bucket are dealt in blocks, so no bucket is too large, and none is left out. Within a block, products are taken in double
precision; those of the best candidates are summed anew in the order of the components, so that equal vectors have equal scores
wherever they meet. Candidates of all tables are merged for the final ranks.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of different
numbers of components never meet. Repeated rows count once. An id with several vectors is listed for each of them; as a query it stands for the least
of them, and no row with the query's id is among its neighbours. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from permspark.llm.cells import meet, runs
from permspark.sources.writers import staged

NEIGHBOURS, EVERY = 20, 20
#: Tables, width of a cell (of projections with variance one), and vectors that a bucket is to hold on average.
TABLES, WIDTH, BUCKET = 2, 3.0, 1500
#: Probability with which a neighbour is to be found, and the quantile of the sample's last neighbours that it holds for.
SUCCESS, LIKE = 0.97, 0.25
#: Queries (those with the smallest hashes) whose neighbours are measured to fit the search.
SAMPLE = 128
#: Vectors of a block; queries and products that are looked at together; candidates that a task gathers before it reduces them.
BLOCK, QUERIES, AT_ONCE, GATHERED = 4000, 200, 4_000_000, 300_000
SEED = 13


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


@cache
def family(dim: int, table: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and offsets of a table."""
    random = np.random.default_rng([SEED, dim, table])
    return random.standard_normal((dim, directions)), random.uniform(0, WIDTH, directions)


def bucket_key(dim: int, band: int, table: int, cells: np.ndarray) -> np.ndarray:
    """64 bits for each row of cells; should two buckets share them, they are searched as one."""
    key = np.full(len(cells), np.uint64((dim * 1_000_003 + band + 5000) * 64 + table + 1), dtype=np.uint64)
    for column in cells.T:
        key = (key ^ (column.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def probes(projection: np.ndarray, offset: np.ndarray, s: float, mass: float) -> np.ndarray:
    """Buckets (rows of cells) from the most likely on, until their chances add up to `mass`."""
    spread = math.sqrt(max(1 - s * s, 1e-6))
    cells, chances = [], []
    for f, b in zip(projection.tolist(), offset.tolist()):
        middle = s * f + b
        low, high = math.floor((middle - 5 * spread) / WIDTH), math.floor((middle + 5 * spread) / WIDTH)
        edges = [normal((c * WIDTH - middle) / spread) for c in range(low, high + 2)]
        order = sorted(range(high - low + 1), key=lambda k: edges[k] - edges[k + 1])
        cells.append([low + k for k in order])
        chances.append([max(edges[k + 1] - edges[k], 1e-300) for k in order])
    first = math.prod(c[0] for c in chances)
    heap, out, reached = [(-first, (0,) * len(cells), 0)], [], 0.0
    while heap and reached < mass:
        chance, at, last = heapq.heappop(heap)
        reached -= chance
        out.append([c[k] for c, k in zip(cells, at)])
        for d in range(last, len(cells)):  # each combination has one predecessor: its last perturbed direction a step back
            if at[d] + 1 < len(cells[d]):
                heapq.heappush(heap, (chance * chances[d][at[d] + 1] / chances[d][at[d]], (*at[:d], at[d] + 1, *at[d + 1 :]), d))
    return np.array(out, dtype=np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one number of components, kept as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


HASHED = "cell long, key long, ids array<long>, vec binary"
HASHED_ROWS = pa.schema([("cell", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.binary())])


def by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Rows (key, ids, vec, dim, band) parted by dim and band."""
    for batch in batches:
        dims, bands = (batch.column(k).to_numpy() for k in (3, 4))
        kinds = dims.astype(np.int64) << 32 | (bands.astype(np.int64) + 5000)
        for kind in np.unique(kinds):
            rows = np.flatnonzero(kinds == kind)
            yield batch.take(pa.array(rows)), int(dims[rows[0]]), int(bands[rows[0]])


def indexed(sizes: dict, directions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of vectors (key, ids, vec, dim, band), one for each table."""
    for rows, dim, band in by_kind(batches):
        scaled = matrix(rows.column(2)) / sizes[dim, band]
        for table in range(TABLES):
            towards, offset = family(dim, table, directions)
            cells = np.floor((scaled @ towards + offset) / WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_key(dim, band, table, cells)), *(rows.column(k) for k in range(3))], schema=HASHED_ROWS)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # sums of squares may leave the range of doubles
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


def asked(reach: dict, directions: int, mass: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets that queries (key, ids, vec, dim, -) visit, in all bands of their number of components."""
    for rows, dim, _ in by_kind(batches):
        queries = unit(matrix(rows.column(2)))
        for band, s in sorted((b, s) for (d, b), s in reach.items() if d == dim):
            for table in range(TABLES):
                towards, offset = family(dim, table, directions)
                for start in range(0, len(queries), QUERIES):
                    visits = [probes(p, offset, s, mass) for p in queries[start : start + QUERIES] @ towards]
                    same = rows.take(pa.array(start + np.repeat(np.arange(len(visits)), [len(v) for v in visits])))
                    key = bucket_key(dim, band, table, np.concatenate(visits))
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(same.column(c) for c in range(3))], schema=HASHED_ROWS)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += queries[:, k] * vectors[:, k]
    return total


def best_of(queries: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the `most` best vectors of each query, and of those that tie with the last."""
    out = []
    for k in range(0, len(queries), step := max(AT_ONCE // len(vectors), 1)):
        part = queries[k : k + step]
        rough = part @ vectors.T
        if len(vectors) > most:
            last = np.partition(rough, len(vectors) - most, axis=1)[:, len(vectors) - most]
            slack = 1e-12 * len(part[0]) * np.sqrt((part**2).sum(axis=1) * (vectors**2).sum(axis=1).max())
            q, v = np.nonzero(~(rough < (last - slack)[:, None]))
        else:
            q, v = (x.ravel() for x in np.indices(rough.shape))
        out.append((q + k, v, products(part[q], vectors[v])))
    return tuple(np.concatenate(x) for x in zip(*out))


BEST = pa.struct([("by", pa.float64()), ("vec_id", pa.int64()), ("key", pa.int64())])
FOUND = "query long, best array<struct<by: double, vec_id: long, key: long>>"


def reduced(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The `most` best (query, -score, id, key of the vector) of each query, each once."""
    columns = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(order) else np.empty(0, dtype=bool)
    columns = [c[new] for c in columns]
    query = columns[0]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate((start, [len(query)]))))
    return tuple(c[rank < most] for c in columns)


def record(found: list[tuple[np.ndarray, ...]], most: int) -> pa.RecordBatch:
    """A row for each query with the list of its best."""
    query, *columns = reduced(found, most)
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    best = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(BEST))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((start, [len(query)])).astype(np.int32)), best)
    return pa.RecordBatch.from_arrays([pa.array(query[start]), lists], names=["query", "best"])


def merged_rows(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list for each query from rows (query, best) sorted by query; a query may span batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        found = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)), *(c.to_numpy() for c in lists.flatten().flatten())
        found = reduced([found] if held is None else [held, found], most)
        last = found[0] == found[0][-1]
        if not last.all():
            yield record([tuple(c[~last] for c in found)], most)
        held = tuple(c[last] for c in found)
    if held is not None:
        yield record([held], most)


def merged(found: DataFrame, most: int) -> DataFrame:
    """The `most` best of each query, from the lists of several tasks; each task that a query visits has one or few."""
    return found.repartition("query").sortWithinPartitions("query").mapInArrow(partial(merged_rows, most), FOUND)


def ranked_rows(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best candidates of each query in each block, from rows (cell, i, j, kind, key, ids, vec) of meet()."""
    held, vectors, found, size = [], None, [], 0
    for new, kind, rows in runs(batches):
        if new:
            held, vectors = [], None
        if kind == 0:
            held.append(rows)
            continue
        if not held:
            continue
        if vectors is None:
            vectors = np.concatenate([matrix(h.column(6)) for h in held])
            keys = np.concatenate([h.column(4).to_numpy() for h in held])
            ids = pa.concat_arrays([h.column(5) for h in held])
            copies = ids.value_lengths().to_numpy().astype(np.int64)
            flat, first = ids.flatten().to_numpy(), np.cumsum(copies) - copies
        q, v, score = best_of(matrix(rows.column(6)), vectors, most)
        n = copies[v]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = rows.column(4).to_numpy()[q], -score, flat[np.repeat(first[v], n) + each], keys[v]
        found.append(reduced([tuple(c if len(c) == len(each) else np.repeat(c, n) for c in met)] if len(each) > len(v) else [met], most))
        size += len(found[-1][0])
        if size > GATHERED:
            yield record(found, most)
            found, size = [], 0
    if found:
        yield record(found, most)


def last_scores(sample: np.ndarray, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The `most` best scores of every sampled query (one number of components) among the rows of a task; ids are running numbers."""
    found, seen = [], 0
    for rows, dim, _ in by_kind(batches):
        if dim != sample.shape[1]:
            continue
        q, v, score = best_of(sample, matrix(rows.column(2)), most)
        n = rows.column(1).value_lengths().to_numpy().astype(np.int64)[v]
        found = [reduced([*found, (np.repeat(q, n), -np.repeat(score, n), seen + np.arange(n.sum()), np.repeat(v, n))], most)]
        seen += int(n.sum())
    if found:
        yield record(found, most)


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """(vec, ids): every distinct vector with its `most` smallest ids; of many copies, only so many of each part are shuffled on."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    own = Window.partitionBy("vec", "_part").orderBy("id")
    few = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(own)).filter(F.col("_rank") <= most)
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, most)
    return few.groupBy("vec").agg(ids.alias("ids"))


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids, vec, dim, band, size) with the vector as bytes, from rows (key, ids, vec); size is its length as a power of two."""
    names = ["key", "ids", "vec", "dim", "band", "size"]
    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy().astype(np.int64)
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        vectors = [flat[e - n : e] for e, n in zip(ends, lengths)]
        top = [np.abs(v).max() for v in vectors]
        size = [math.log2(t) + 0.5 * math.log2(((v / t) ** 2).sum()) for v, t in zip(vectors, top)]
        columns = [batch.column(0), batch.column(1), [v.tobytes() for v in vectors], lengths, [round(x) for x in size], size]
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


BYTES = "key long, ids array<long>, vec binary, dim int, band int, size double"


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, success: float = SUCCESS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` best vectors found for each query, a row whose id `every` divides."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec")))
    queries = staged(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"), F.count_distinct("vec").alias("own")))
    most = k + (queries.agg(F.max("own")).first()[0] or 0)  # a query's own rows may be among its best
    points = staged(smallest_ids(rows, most).select(F.xxhash64("vec").alias("key"), "ids", "vec").mapInArrow(as_bytes, BYTES))
    named = staged(queries.groupBy("vec").agg(F.min("id").alias("key")))
    members = staged(queries.join(named.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select("id", "key"))
    search = staged(named.select("key", F.array("key").alias("ids"), "vec").mapInArrow(as_bytes, BYTES))

    kinds = points.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()
    sizes = {(r.dim, r.band): 2.0**r.size for r in kinds}
    reach = fitted(points, search, sizes, k + 1)
    directions = max(round(math.log2(max(sum(r.n for r in kinds), 1) / BUCKET)), 1)
    mass = 1 - (1 - success) ** (1 / TABLES)
    left = points.mapInArrow(partial(indexed, sizes, directions), HASHED)
    right = search.mapInArrow(partial(asked, reach, directions, mass), HASHED)
    met = meet(left, right, ["key", "vec"], block)
    lists = staged(merged(met.mapInArrow(partial(ranked_rows, most), FOUND), most))
    met = members.join(lists, F.col("key") == F.col("query"))
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = met.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", (-F.col("b.by")).alias("score"))


def fitted(points: DataFrame, search: DataFrame, sizes: dict, most: int) -> dict[tuple[int, int], float]:
    """For each number of components and band, the scaled inner product of the last neighbour, from a sample of queries and all vectors."""
    reach = {}
    for dim in {d for d, _ in sizes}:
        chosen = search.filter(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").collect()
        if not chosen:
            continue
        sample = unit(np.stack([np.frombuffer(r.vec, dtype=np.float64) for r in chosen]))
        best = merged(points.mapInArrow(partial(last_scores, sample, most), FOUND), most).select(F.element_at("best.by", -1).alias("last"))
        last = -np.array([r["last"] for r in best.collect()])
        reach |= {(d, band): float(np.clip(np.quantile(last, LIKE) / size, 0.0, 0.999)) for (d, band), size in sizes.items() if d == dim}
    return reach
