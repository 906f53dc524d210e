"""Bootstrap by splitting against plain draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permspark.operators import resampling as R
from permspark.operators import stats as T


@pytest.mark.parametrize("n, size", [(1000, 64), (7, 2), (5, 8), (64, 64), (129, 64)])
def test_shares_add_up_and_are_fair(n, size):
    ranges, reps = -(-n // size), 3000
    shares = np.array([R.share(1, 99, n, k, reps, size) for k in range(ranges)])
    assert (shares.sum(axis=0) == n).all() and (shares >= 0).all()
    for k, got in enumerate(shares):
        q = min(size, n - k * size) / n
        assert abs(got.mean() - n * q) < 5 * np.sqrt(n * q * (1 - q) / reps) + 1e-9
        assert abs(got.var() - n * q * (1 - q)) <= 0.15 * n * q * (1 - q) + 1e-9


def test_sums_are_those_of_whole_draws():
    rng = np.random.default_rng(3)
    values = np.column_stack([np.ones(100), rng.normal(size=100), np.arange(100) == 17])
    parts = [R.range_sums(5, 7, 100, k, values[k * 32 : k * 32 + 32], 2000, 32) for k in range(4)]
    total = sum(parts)
    assert (total[:, 0] == 100).all()
    hits = total[:, 2]  # how often one row is drawn: binomial
    assert abs(hits.mean() - 1) < 0.1 and abs(hits.var() - 0.99) < 0.12
    assert abs(total[:, 1].var() / (100 * values[:, 1].var()) - 1) < 0.15


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(900), "g": rng.choice(["a", "b", None], 900), "p": rng.normal(size=900)})
    pdf["o"] = 1e3 + 0.8 * pdf.p + rng.normal(0, 0.7, 900)
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("id") % 50 != 0, F.col("p") + 1e3))
    return df.persist()


def test_summary_agrees_with_plain_draws(pairs):
    one = {r.g: r for r in R.bootstrap_split(pairs, ["g"], "id", "o", "p", 2000, size=64).collect()}
    two = {r.g: r for r in T.bootstrap(pairs, ["g"], "id", "o", "p", 400).collect()}
    again = {r.g: r for r in R.bootstrap_split(pairs.repartition(7), ["g"], "id", "o", "p", 2000, size=64).collect()}
    assert set(one) == {"a", "b", None} and all(one[g].replicates == 2000 for g in one)
    for g in ("a", "b"):
        assert one[g].n == two[g].n
        for c in ("r2_low", "r2_median", "r2_high", "rmse_median"):
            assert getattr(one[g], c) == pytest.approx(getattr(two[g], c), abs=0.03) and getattr(one[g], c) == pytest.approx(getattr(again[g], c), rel=1e-9)
        assert 0 <= one[g].p_median < 1e-10


def test_report_is_text(spark):
    rows = [("e", s, 10, 0.1234, 0.5, 0.9, r) for s, r in (("all", 20.04), ("low", 0.0456), ("high", None))]
    table = spark.createDataFrame(rows, "evaluation string, subset string, n long, r2_low double, r2_median double, r2_high double, rmse_median double")
    got = R.evaluation_report(table, "evaluation", "subset").first()
    assert tuple(got) == ("e", 10, "0.5", "0.12 - 0.9", "20", "0.046", None)
