"""The logistic ranker against Newton's method in numpy, over other tables, and its edge cases."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import ranker

FEATURES = ["a", "b"]


def table(n=300, seed=4):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"query": rng.integers(0, 30, n), "candidate": range(n), "a": rng.normal(50, 9, n), "b": rng.exponential(1, n)})
    f["hit"] = rng.random(n) < 1 / (1 + np.exp(-(0.2 * (f.a - 60) + f.b)))
    f.loc[::9, "b"] = np.nan
    return f


def frame(spark, f):
    return spark.createDataFrame([tuple(None if x != x else x for x in r) for r in f[["query", "candidate", "a", "b", "hit"]].astype(object).values.tolist()], "query long, candidate long, a double, b double, hit boolean").repartition(4)


def fitted(f):
    x = f[FEATURES].fillna(f[FEATURES].median()).to_numpy()
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z, y = np.column_stack([np.ones(len(f)), (x - mean) / scale]), f.hit.to_numpy(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, penalty = np.zeros(3), np.diag([0.0, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + penalty, z.T @ (w * (p - y)) + penalty @ beta)
    return beta


def test_coefficients_equal_a_plain_fit_and_rank_another_table(spark):
    f = table()
    got, want = ranker.fit_ranker(frame(spark, f), "hit", FEATURES), fitted(f)
    assert np.allclose([got.intercept, *got.coefficients], want, atol=1e-8)
    assert got.rows == 300 and got.positives == f.hit.sum()
    other = table(60, seed=9)
    out = ranker.apply_ranker(frame(spark, other), got, "query", "candidate").toPandas().set_index("candidate")
    x = other[FEATURES].fillna(dict(zip(FEATURES, got.fills))).to_numpy()
    linear = (x - got.means) / got.scales @ got.coefficients + got.intercept
    assert np.allclose(out.linear[other.candidate], linear) and np.allclose(out.score[other.candidate], -1 / (1 + np.exp(-linear)))
    for _, g in out.groupby("query"):
        assert list(g.sort_values(["score"]).sort_values("rank").probability) == sorted(g.probability, reverse=True)


@pytest.mark.parametrize("few", [1 << 20, 20, 1])
def test_median_is_exact_however_it_is_found(spark, few):
    for values in ([3.0], [1.0, 2.0], list(np.random.default_rng(1).normal(0, 1, 501)), [5.0] * 80 + [6.0] * 80, [1.0] * 300 + [2.0] * 10 + [float(i) for i in range(100)]):
        rows = spark.createDataFrame([(v,) for v in [*map(float, values), None, float("nan")]], "x double").repartition(3)
        assert ranker.median(rows, "x", few) == np.median(values)


def test_labels_of_one_class_and_empty_tables(spark):
    f = table(40)
    f["hit"] = True
    for rows in (frame(spark, f), frame(spark, f).limit(0)):
        got = ranker.fit_ranker(rows, "hit", FEATURES)
        assert got.coefficients == [0.0, 0.0] and got.intercept == 0.0
    ties = ranker.apply_ranker(frame(spark, f), got, "query", "candidate").toPandas()
    assert all(list(g.sort_values("rank").candidate) == sorted(g.candidate) for _, g in ties.groupby("query"))
