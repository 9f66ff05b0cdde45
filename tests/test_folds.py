"""Fold models against refitting every fold from its rows in numpy; spectra against plain sums."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import folds, permutations, spectra

FEATURES = ["a", "b", "c"]


def table(seed=1, n=90, subjects=7):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"row": range(n), "subject": rng.integers(0, subjects, n).astype("int64"), "a": rng.normal(1000, 5, n), "b": rng.normal(0, 1, n), "c": rng.exponential(2, n)})
    f["y"] = 3 * f.b - 0.1 * f.a + rng.normal(0, 1, n)
    f["kind"], f["side"] = rng.choice(["u", "v", "w"], n), rng.choice(["l", "r"], n)
    f.loc[f.subject == 3, "kind"] = "only"
    return f


def refit(train, test, features, alpha=1.0):
    x, t = train[features].to_numpy(float), test[features].to_numpy(float)
    fill = np.nan_to_num(np.nanmedian(x, axis=0))
    filled = np.where(np.isnan(x), fill, x)
    mean, std = np.nanmean(x, axis=0), filled.std(axis=0)
    std[std == 0] = 1
    z, y = (filled - mean) / std, train.y.to_numpy(float)
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(features)), z.T @ (y - y.mean()))
    return (np.where(np.isnan(t), fill, t) - mean) / std @ beta + y.mean(), beta


def frame(spark, f):
    return spark.createDataFrame(f.astype(object).where(f.notna(), None).values.tolist(), ", ".join(f"{c} {'string' if f[c].dtype == object or str(f[c].dtype) == 'str' else 'double' if f[c].dtype == float else 'long'}" for c in f.columns)).repartition(5)


@pytest.mark.parametrize("holes", [False, True])
def test_ridge_equals_refitting(spark, holes):
    f = table()
    if holes:
        f.loc[::7, "a"] = None
        f.loc[::5, "c"] = None
        f.loc[3, "y"] = None
    predicted, models = folds.ridge(frame(spark, f), "subject", "y", FEATURES)
    got = predicted.toPandas().set_index("row")
    weights = models.toPandas().set_index("subject")
    f = f[f.y.notna()]
    assert len(got) == len(f) and (got.fold_status == "ok").all()
    for s in f.subject.unique():
        want, beta = refit(f[f.subject != s], f[f.subject == s], FEATURES)
        assert np.allclose(got.y_pred[f.row[f.subject == s]], want, rtol=1e-9, atol=1e-9)
        assert np.allclose(weights.weights[s], beta, rtol=1e-7, atol=1e-9)


def test_ridge_without_enough_rows_or_varied_targets(spark):
    few = table(n=10, subjects=3)
    got = folds.ridge(frame(spark, few), "subject", "y", FEATURES)[0].toPandas()
    sizes = few.subject.value_counts()
    assert all(r.fold_status == ("ok" if 10 - sizes[r.subject] >= 8 else "insufficient_training_data") for r in got.itertuples())
    flat = table()
    flat.loc[flat.subject != 2, "y"] = 5.0
    got = folds.ridge(frame(spark, flat), "subject", "y", FEATURES)[0].toPandas()
    assert set(got.fold_status[got.subject == 2]) == {"insufficient_training_data"} and got.y_pred[got.subject == 2].isna().all()
    assert set(got.fold_status[got.subject != 2]) == {"ok"}
    assert folds.ridge(frame(spark, table()).limit(0), "subject", "y", FEATURES)[0].count() == 0
    empty = table()
    empty["c"] = np.nan
    assert set(folds.ridge(frame(spark, empty), "subject", "y", FEATURES)[0].toPandas().fold_status) == {"ok"}


def test_residuals_equal_refitting(spark):
    f = table()
    f.loc[4, "side"] = None
    got = folds.residuals(frame(spark, f), "subject", ["kind", "side"], FEATURES).toPandas().set_index("row")
    for s in f.subject.unique():
        train, test = f[f.subject != s], f[f.subject == s]
        design = pd.get_dummies(train[["kind", "side"]]).astype(float)
        design.insert(0, "one", 1.0)
        beta = np.linalg.pinv(design.to_numpy()) @ train[FEATURES].to_numpy()
        asked = pd.get_dummies(test[["kind", "side"]]).astype(float)
        asked["one"] = 1.0
        want = test[FEATURES].to_numpy() - asked.reindex(columns=design.columns, fill_value=0.0).to_numpy() @ beta
        assert np.allclose(got.loc[test.row, [f"r_{c}" for c in FEATURES]], want, atol=1e-7)


def metric(f, s, kind):
    train = f[f.subject != s]
    x = train[FEATURES].to_numpy()
    std = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / std
    left = np.eye(3)
    if "components" in kind:
        means = np.array([z[(train.subject == k).to_numpy()].mean(axis=0) for k in sorted(train.subject.unique())])
        v = np.linalg.svd(means - means.mean(axis=0))[2][:2]
        left = left - v.T @ v
    if kind == "mahalanobis":
        inverse = np.linalg.pinv(np.cov(z, rowvar=False) + 0.1 * np.eye(3))
        return lambda d: np.sqrt((d / std) @ inverse @ (d / std))
    if kind.startswith("low_rank"):
        values, vectors = np.linalg.eigh(np.cov(z @ left.T, rowvar=False))
        values = np.maximum(values, 1e-6)
        return lambda d: np.linalg.norm(vectors.T @ left @ (d / std) / np.sqrt(0.75 * values + 0.25 * values.mean()))
    return lambda d: np.linalg.norm(left @ (d / std))


@pytest.mark.parametrize("kind", folds.KINDS)
def test_metrics_equal_refitting(spark, kind):
    f = table(n=40)
    states = frame(spark, f)
    ids = states.withColumnRenamed("row", "id")
    got = folds.metric_scores(ids, ids, folds.fold_metrics(states, "subject", FEATURES, kind), "subject", ["side"], FEATURES).collect()
    x = f.set_index("row")
    assert len(got) == sum(n * n for n in f.side.value_counts())
    for r in got:
        d = x.loc[r.query, FEATURES].to_numpy(float) - x.loc[r.candidate, FEATURES].to_numpy(float)
        assert abs(r.score - metric(f, x.subject[r.query], kind)(d)) < 1e-6


def test_metrics_need_others(spark):
    one = frame(spark, table(n=6, subjects=1))
    assert folds.fold_metrics(one, "subject", FEATURES, "mahalanobis").count() == 0
    assert folds.fold_metrics(one.limit(0), "subject", FEATURES, "low_rank").count() == 0


def segments_of(x, width):
    hop = width - width // 2
    return np.array([x[k : k + width] - x[k : k + width].mean() for k in range(0, len(x) - width + 1, hop)]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width))


def plain(x, width):
    turn = np.exp(-2j * np.pi * np.outer(np.arange(width // 2 + 1), np.arange(width)) / width)
    return segments_of(x, width) @ turn.T


@pytest.mark.parametrize(("size", "width"), [(1000, 256), (2305, 288), (130, 130)])
def test_welch_equals_plain_sums(spark, size, width):
    x = np.random.default_rng(size).normal(3, 1, size)
    series = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)] + [("short", i, 1.0) for i in range(100)], "channel string, n long, value double").repartition(3)
    got = spectra.welch(series, 50.0).toPandas().sort_values("frequency")
    assert set(got.channel) == {"c"}
    want = (np.abs(plain(x, width)) ** 2).mean(axis=0) / (50.0 * 0.375 * width)
    want[1 : len(want) - (width % 2 == 0)] *= 2
    assert np.allclose(got.frequency, np.arange(len(want)) * 50.0 / width) and np.allclose(got.power, want)


def test_coherence_equals_plain_sums_and_missing_samples_are_means(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 400)
    y = np.roll(x, 3) + rng.normal(0, 0.5, 400)
    rows = [("x", i, float(v)) for i, v in enumerate(x)] + [("y", i, float(v)) for i, v in enumerate(y)] + [("zero", i, 1.0) for i in range(400)] + [("tiny", 2, 1.0)]
    got = spectra.coherence(spark.createDataFrame(rows, "channel string, n long, value double").repartition(3), 20.0).toPandas()
    assert set(zip(got.left, got.right)) == {("x", "y"), ("x", "zero"), ("y", "zero")}
    assert got[got.right == "zero"].coherence.isna().all()
    a, b = plain(x, 40), plain(y, 40)
    want = np.abs((np.conj(a) * b).sum(axis=0)) ** 2 / (np.abs(a) ** 2).sum(axis=0) / (np.abs(b) ** 2).sum(axis=0)
    assert np.allclose(got[(got.left == "x") & (got.right == "y")].sort_values("frequency").coherence, want)
    assert np.allclose(spectra.filled(np.array([0, 2]), np.array([1.0, 3.0]), 4), [-1, 0, 1, 0])



def test_permutations_equal_refitting_every_round(spark):
    f = table(n=30, subjects=6).drop_duplicates(["subject", "side"])
    f.loc[f.index[3], "y"] = np.nan
    rows = frame(spark, f)
    deal = permutations.shuffled_subjects(rows, "subject", 12).toPandas()
    assert (deal[deal["round"] == 0].subject == deal[deal["round"] == 0].donor).all()
    got = permutations.permuted_ridge(rows, "subject", "side", "y", FEATURES, 12, least=4).toPandas().set_index("round")
    assert len(got) == 13
    y = f.set_index(["subject", "side"]).y
    for r, d in deal.groupby("round"):
        assert sorted(d.subject) == sorted(d.donor) == sorted(f.subject.unique())
        g = f.copy()
        g["y"] = [y.get((d.set_index("subject").donor[s], k), np.nan) for s, k in zip(g.subject, g.side)]
        g = g[g.y.notna()]
        want = pd.concat([pd.Series(refit(g[g.subject != s], g[g.subject == s], FEATURES)[0], index=g.index[g.subject == s]) for s in g.subject.unique() if (g.subject != s).sum() >= 4])
        rho = np.corrcoef(g.y[want.index].rank(), want.rank())[0, 1]
        assert got.n[r] == len(want) and abs(got.spearman[r] - rho) < 1e-9
    summary = permutations.null_summary(spark.createDataFrame([(0, 5, 0.5), (1, 5, 0.5), (2, 5, 0.1), (3, 5, None)], "round long, n long, spearman double")).first()
    assert (summary.n_rounds, summary.observed, summary.p_value) == (2, 0.5, 2 / 3) and abs(summary.null_mean - 0.3) < 1e-12
