"""Bags, out-of-bag votes, the subset-size search and permutation importance against plain versions."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from permspark.operators import bagging as B
from permspark.operators import models as M

COLS = ["a", "b", "noise1", "noise2"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(200, 4)).round(6), columns=COLS)
    pdf["id"] = np.arange(200) * 7
    pdf["y"] = np.digitize(2 * pdf.a - pdf.b, [-1, 1]).astype(float)
    pdf["z"] = (2 * pdf.a - pdf.b).round(6)
    return pdf


def weight(tree, key, seed=B.SEED):
    u = int(hashlib.md5(f"{seed}:{tree}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= p for p in B.POISSON)


def test_weights_are_poisson(spark, rows):
    df = spark.createDataFrame(rows)
    got = df.select("id", *[B.bag_weight(t, ["id"]).alias(str(t)) for t in range(30)]).toPandas()
    want = [[weight(t, i) for t in range(30)] for i in got.id]
    assert got.drop(columns="id").to_numpy().tolist() == want
    shares = Counter(np.ravel(want).tolist())
    assert abs(shares[0] / 6000 - np.exp(-1)) < 0.02 and abs(np.mean(want) - 1) < 0.04


@pytest.mark.parametrize("classify", [True, False])
def test_votes_equal_brute_force(spark, rows, classify):
    label = "y" if classify else "z"
    bag = B.fit_bag(spark.createDataFrame(rows), COLS, label, ["id"], classify, trees=27, depth=4)
    got = {r.id: (r.n_trees, r.vote) for r in B.out_of_bag(bag).collect()}
    feats = {r.id: r.features for r in bag.rows.collect()}
    wrong = []
    for r in rows.itertuples():
        out = [bag.trees[t].predict(feats[r.id]) for t in range(27) if weight(t, r.id) == 0]
        assert got[r.id][0] == len(out)
        if not out:
            assert got[r.id][1] is None
            continue
        n = Counter(out)
        vote = min(n, key=lambda c: (-n[c], c)) if classify else np.mean(out)
        assert got[r.id][1] == pytest.approx(vote)
        wrong.append(vote != r.y if classify else (vote - r.z) ** 2)
    assert B.out_of_bag_error(bag) == pytest.approx(np.mean(wrong))
    bag.done()


def test_importance_equals_brute_force(spark, rows):
    bag = B.fit_bag(spark.createDataFrame(rows), COLS, "y", ["id"], True, trees=12, depth=4)
    donor = {r.id: r["__donor"].toArray() for r in B.donors(bag.rows, ["id"], 5).collect()}
    feats = {r.id: r.features.toArray() for r in bag.rows.collect()}
    assert sorted(map(tuple, donor.values())) == sorted(map(tuple, feats.values()))  # a permutation of the rows
    assert sum((donor[i] != feats[i]).any() for i in feats) > 190
    label = dict(zip(rows.id, rows.y))
    got = {r.feature: (r.loss, r.spread, r["rank"]) for r in B.permutation_importance(bag, 5).collect()}
    for j, name in enumerate(COLS):
        losses = []
        for t in range(12):
            out = [i for i in feats if weight(t, i) == 0]
            error = [bag.trees[t].predict(bag_vector(feats[i])) != label[i] for i in out]
            moved = [bag.trees[t].predict(bag_vector(np.where(np.arange(4) == j, donor[i], feats[i]))) != label[i] for i in out]
            losses.append(np.mean(moved) - np.mean(error))
        assert got[name][:2] == (pytest.approx(np.mean(losses)), pytest.approx(np.std(losses, ddof=1)))
    assert got["a"][2] == 1 and got["b"][2] == 2 and got["a"][0] > 0.2 and abs(got["noise1"][0]) < 0.05
    bag.done()


def bag_vector(x):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(x)


def test_nothing_depends_on_partitions(spark, rows):
    df, results = spark.createDataFrame(rows), []
    for parts in (1, 4, 8):
        bag = B.fit_bag(df.repartition(parts), COLS, "y", ["id"], True, trees=5, depth=4)
        cv = M.repeated_cv(df.repartition(parts), COLS, "y", ["id"], True, [1, 2], 3, 1, trees=3, depth=3)
        results.append((B.out_of_bag_error(bag), sorted(map(tuple, cv.collect()))))
        bag.done()
    assert results[0] == results[1] == results[2]


def test_search_goes_on_while_the_error_falls(spark, rows, monkeypatch):
    """Errors as planted: the search goes down from 7 to where no step helps, then up."""
    planted = {7: 0.30, 6: 0.31, 8: 0.29, 10: 0.25, 12: 0.2499, 15: 0.1}
    monkeypatch.setattr(B, "fit_bag", lambda *a, mtry, **k: type("Bag", (), {"mtry": mtry, "done": lambda self: None})())
    monkeypatch.setattr(B, "out_of_bag_error", lambda bag: planted[bag.mtry])
    tried = B.search_mtry(spark.createDataFrame(rows), [f"c{k}" for k in range(50)], "y", ["id"], True)
    assert [r.mtry for r in sorted(tried.collect(), key=lambda r: r.step)] == [7, 6, 8, 10, 12]
    assert B.best_mtry(tried) == 12


def test_bags_are_drawn_once(spark, rows, monkeypatch):
    """Fits, votes and exchanged values read the stored weights, and trials of a search share them."""
    drawn, weight = [], B.bag_weight
    monkeypatch.setattr(B, "bag_weight", lambda t, *a: drawn.append(t) or weight(t, *a))
    df = spark.createDataFrame(rows)
    bag = B.fit_bag(df, COLS, "y", ["id"], True, trees=3, depth=2)
    again = B.fit_bag(df, COLS, "y", ["id"], True, trees=3, depth=2, mtry=2, like=bag)
    assert again.rows is bag.rows and B.out_of_bag(again).count() == len(rows)
    assert B.permutation_importance(bag).count() == len(COLS)
    drawn.clear()
    tried = B.search_mtry(df, COLS, "y", ["id"], True, trees=2, depth=2, factor=2.0, improve=-1.0)
    assert tried.count() > 1 and drawn == [0, 1]
