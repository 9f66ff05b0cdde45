"""A balanced logistic ranker: fitted by reweighted least squares as distributed sums, frozen, and applied to other tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.folds import present


@dataclass(frozen=True)
class FrozenRanker:
    """What a ranker needs on tables it has not seen: imputing, scaling and coefficients, by feature."""

    features: list[str]
    fills: list[float]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    rows: int
    positives: int


def median(rows: DataFrame, column: str, few: int = 1 << 20) -> float | None:
    """The exact median of the values that are there. Over ``few`` values are narrowed to those near the middle before they are sorted."""
    x = rows.select(present(column).alias("x")).where("x is not null")
    n = x.count()
    if not n:
        return None
    below, held = 0, n
    while held > few:
        low, high = x.agg(F.percentile_approx("x", [max(0.0, ((n - 1) // 2 - below) / held - 0.01), min(1.0, (n // 2 - below) / held + 0.01)], 1000).alias("q")).first().q
        inside = x.where(F.col("x").between(low, high))
        less, now = x.where(F.col("x") < low).count(), inside.count()
        if low == high or now == held or not below + less <= (n - 1) // 2 <= n // 2 < below + less + now:
            break
        x, below, held = inside, below + less, now
    counts = x.groupBy("x").count()
    order = counts.withColumn("upto", F.sum("count").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + below)
    middle = order.agg(F.min(F.when(F.col("upto") > (n - 1) // 2, F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > n // 2, F.col("x"))).alias("b")).first()
    return (middle.a + middle.b) / 2


def _sums(data: DataFrame, beta: np.ndarray, weights: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the weighted logistic loss at ``beta`` (intercept first), a row of sums a batch."""
    k = len(beta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.column_stack([np.ones(len(b)), np.stack(b["z"].to_numpy())])
                y = b["y"].to_numpy(np.float64)
                w, linear = np.where(y == 1, weights[1], weights[0]), x @ beta
                p = 1 / (1 + np.exp(-np.clip(linear, -500, 500)))
                loss = (w * (np.logaddexp(0, linear) - y * linear)).sum()
                yield pd.DataFrame({"s": [np.concatenate([[loss], x.T @ (w * (p - y)), (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()])]})

    parts = data.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    s = np.array([r.v for r in parts.orderBy("i").collect()])  # (k + 1) squared numbers at most
    return s[0], s[1 : k + 1], s[k + 1 :].reshape(k, k)


def fit_ranker(rows: DataFrame, label: str, features: list[str], strength: float = 1.0, rounds: int = 100) -> FrozenRanker:
    """Logistic regression with balanced classes and a squared penalty of 1 / (2 * strength) on all but the intercept.

    Missing features take the median of the rows (0 if there is none); features are scaled by mean and population deviation (0: 1).
    Newton's steps, halved where the loss would rise, until a step is under 1e-12 of the coefficients. Rows without a label take no
    part. A label of one class only gives coefficients of 0 and no intercept.
    """
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("boolean").cast("int").alias("y"), *(present(f).alias(f) for f in features)).persist()  # read by every pass
    fills = [median(rows, f) or 0.0 for f in features]
    whole = [F.coalesce(F.col(f), F.lit(v)) for f, v in zip(features, fills)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones"), *(F.avg(c) for c in whole), *(F.stddev_pop(c) for c in whole)).first()
    n, ones, p = got[0], got[1], len(features)
    means, scales = [float(m or 0.0) for m in got[2 : 2 + p]], [float(s) if s else 1.0 for s in got[2 + p :]]
    beta = np.zeros(p + 1)
    if 0 < ones < n:
        data = rows.select("y", F.array(*((c - F.lit(m)) / F.lit(s) for c, m, s in zip(whole, means, scales))).alias("z"))
        weights, ridge = (n / (2 * (n - ones)), n / (2 * ones)), np.diag([0.0, *[1 / strength] * p])
        total = lambda b, s: s[0] + b @ ridge @ b / 2
        sums = _sums(data, beta, weights)
        for _ in range(rounds):
            step = np.linalg.solve(sums[2] + ridge, sums[1] + ridge @ beta)
            after = _sums(data, beta - step, weights)
            while total(beta - step, after) > total(beta, sums) * (1 + 1e-12) and np.abs(step).max() > 1e-14:
                step = step / 2
                after = _sums(data, beta - step, weights)
            beta, sums = beta - step, after
            if np.abs(step).max() <= 1e-12 * max(1.0, np.abs(beta).max()):
                break
    rows.unpersist()
    return FrozenRanker(list(features), fills, means, scales, [float(b) for b in beta[1:]], float(beta[0]), n, int(ones))


def apply_ranker(rows: DataFrame, ranker: FrozenRanker, query: str, candidate: str) -> DataFrame:
    """``rows`` with ``linear``, ``probability``, ``score`` (its negative) and ``rank`` in its query, ties to the smaller candidate."""
    terms = [(F.coalesce(present(f), F.lit(v)) - F.lit(m)) / F.lit(s) * F.lit(c) for f, v, m, s, c in zip(ranker.features, ranker.fills, ranker.means, ranker.scales, ranker.coefficients)]
    scored = rows.withColumn("linear", sum(terms, F.lit(ranker.intercept)))
    scored = scored.withColumn("probability", 1 / (1 + F.exp(-F.greatest(F.least("linear", F.lit(50.0)), F.lit(-50.0))))).withColumn("score", -F.col("probability"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("score", candidate)))
