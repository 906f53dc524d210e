"""Approximate nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permspark.llm import nearest as N

SF = "/root/testdata/sf0.1"


def brute(rows, k=20, every=20):
    """{query_id: [(vec_id, score)]} from rows (id, vector), comparing all."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = {}
    for i, v in queries.items():
        best = set()
        for j, u in {(j, tuple(u)) for j, u in good}:
            if j != i and len(u) == len(v):
                score = 0.0
                for a, b in zip(v, u):
                    score += a * b
                best.add((-score, j, u))
        out[i] = [(j, -s) for s, j, _ in sorted(best)[:k]]
    return {i: x for i, x in out.items() if x}


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(best)) for q, best in want.items()) / max(sum(map(len, want.values())), 1)


def awkward():
    r = np.random.default_rng(2)
    rows = [(k, r.standard_normal(5).tolist()) for k in range(120)]
    rows += [(200 + k, [1.0, 2.0, 0.0, 0.0, 1.0]) for k in range(90)]  # copies, queries among them
    rows += [(400, None), (420, []), (440, [0.0] * 5), (460, [1.0, None, 0.0, 0.0, 0.0]), (480, [math.nan] * 5), (500, [math.inf, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    rows += [(520, [1.0, 1.0]), (521, [1.0, -1.0]), (540, [5.0]), (5, [9.0] * 5), (40, [0.5] * 5), rows[60], (600, [1e-3] * 5), (601, [800.0, 1.0, 1.0, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize("block", [N.BLOCK, 8])
def test_awkward_rows_equal_brute_force(spark, block):
    """So sure of success that every bucket is visited."""
    rows = awkward()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("rank"), F.lit(2).alias("key"), F.lit(3).alias("cell"))
    assert lists(N.nearest(table, success=1 - 1e-12, block=block)) == brute(rows)


def test_empty_table(spark):
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("stretched", [False, True])
def test_recall(spark, stretched):
    """At least 0.9 of the true neighbours, of vectors as given and of vectors of very different lengths; what is found is exact."""
    data = pd.read_parquet(f"{SF}/embeddings.parquet").head(800 if stretched else 2000)
    size = np.random.default_rng(1).lognormal(0, 1.5, len(data)) if stretched else np.ones(len(data))
    rows = [(int(i), [float(x * s) for x in v.astype(float)]) for i, v, s in zip(data["vec_id"], data["embedding"], size)]
    want = brute(rows)
    got = lists(N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert recall(got, want) >= 0.9 and set(got) == set(want)
    vectors = dict(rows)
    for q, best in got.items():
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
        assert all(s == dict(want[q]).get(v, s) for v, s in best)


def test_buckets_come_in_order_of_their_chances():
    offset, projection = np.array([0.3, 1.0, 2.2]), np.array([0.5, -1.5, 0.1])
    s, spread = 0.6, 0.8
    visited = N.probes(projection, offset, s, 0.999)
    assert len(np.unique(visited, axis=0)) == len(visited)

    def chance(row):
        edges = [((c * N.WIDTH - s * f - b) / spread, ((c + 1) * N.WIDTH - s * f - b) / spread) for c, f, b in zip(row, projection, offset)]
        return math.prod(N.normal(high) - N.normal(low) for low, high in edges)

    chances = [chance(row) for row in visited]
    assert all(a >= b - 1e-12 for a, b in zip(chances, chances[1:])) and 0.999 <= sum(chances) < 1
