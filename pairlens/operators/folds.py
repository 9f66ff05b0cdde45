"""Models that leave one subject out: fitted from Gram matrices of all rows less the held-out subject's own.

One pass gathers a Gram matrix a subject; every fold's is the total less that. Scaling, imputing, regression, metrics and components
are then small dense problems, one a subject, which Spark deals over tasks. Rows without a subject take no part in any fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: str | Column) -> Column:
    """The value, null where it is not a number."""
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(x), x)


def grams(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``by``, ``gram``: sums of products of (1, columns) over each group's rows, row by row of the matrix; columns hold no nulls.

    Tasks send a matrix a batch and group, and the matrices' entries are summed, so one group may hold any share of the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes, names = pd.factorize(b[by])
                x = np.column_stack([np.ones(len(b)), b[columns].to_numpy(np.float64)])
                order = np.argsort(codes, kind="stable")
                parts = np.split(x[order], np.cumsum(np.bincount(codes))[:-1])
                yield pd.DataFrame({by: names, "gram": [(p.T @ p).ravel() for p in parts]})

    kind = dict(rows.dtypes)[by]
    parts = rows.where(F.col(by).isNotNull()).select(by, *columns).mapInPandas(run, f"{by} {kind}, gram array<double>")
    entries = parts.select(by, F.posexplode("gram").alias("i", "g")).groupBy(by, "i").agg(F.sum("g").alias("g"))
    return entries.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda e: e.g).alias("gram"))


def fold_grams(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``by``, ``rest``: the Gram matrix of all rows of the other groups."""
    own = grams(rows, by, columns)
    total = own.select(F.posexplode("gram").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    total = total.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda e: e.g).alias("total"))
    return own.crossJoin(F.broadcast(total)).select(by, F.zip_with("total", "gram", lambda t, g: t - g).alias("rest"))  # total: one row


def centres(rows: DataFrame, columns: list[str]) -> list[float]:
    """Means of all rows: subtracted before products are summed, so that folds lose no digits."""
    means = rows.agg(*(F.avg(present(c)).alias(c) for c in columns)).first()
    return [float(m or 0.0) for m in means]


def per_fold(folds: DataFrame, fit: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """Each fold's row through ``fit``; folds are small and many, so they are dealt over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([fit(r) for _, r in b.iterrows()])

    return folds.mapInPandas(run, schema)


# regression


def fold_medians(rows: DataFrame, by: str, features: list[str]) -> DataFrame:
    """``by``, ``feature``, ``median``: medians over the other groups' rows, for features that miss values somewhere.

    Values are counted before they meet the folds: the product is of folds and distinct (group, value) pairs of these features.
    """
    missing = rows.agg(*(F.count(F.when(present(f).isNull(), 1)).alias(f) for f in features)).first()
    wanted = [f for f in features if missing[f]]
    named = F.array(*(F.struct(F.lit(f).alias("feature"), present(f).alias("x")) for f in wanted)) if wanted else F.expr("cast(array() as array<struct<feature:string,x:double>>)")
    values = rows.where(F.col(by).isNotNull()).select(by, F.explode(named).alias("v")).select(by, "v.*").where("x is not null").groupBy(by, "feature", "x").count()
    folds = rows.where(F.col(by).isNotNull()).select(F.col(by).alias("fold")).distinct()
    return values.join(folds, F.col("fold") != F.col(by)).groupBy("fold", "feature").agg(F.percentile("x", F.lit(0.5), F.col("count")).alias("median")).withColumnRenamed("fold", by)


def ridge(rows: DataFrame, subject: str, target: str, features: list[str], alpha: float = 1.0, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Ridge regression that leaves each subject out: predictions and models.

    Predictions: the columns of ``rows`` with ``y_pred`` and ``fold_status``, for rows with a subject and a target. Models:
    subject, ``weights``, ``means``, ``scales``, ``fills`` (arrays by feature), ``y_mean``, ``n``, ``fold_status``. Missing values
    take the median of the fold's other subjects (0 if there is none); features are scaled by the mean of their present values and
    the deviation of the imputed ones (0: 1). Folds with under ``least`` rows or a single target value have null predictions.
    """
    rows = rows.where(F.col(subject).isNotNull() & present(target).isNotNull())
    p, mid = len(features), centres(rows, [*features, target])
    x = [F.coalesce(present(f) - F.lit(m), F.lit(0.0)).alias(f"x{i}") for i, (f, m) in enumerate(zip(features, mid))]
    gone = [present(f).isNull().cast("double").alias(f"n{i}") for i, f in enumerate(features)]
    plain = rows.select(F.col(subject).alias("s"), *x, *gone, (present(target) - F.lit(mid[-1])).alias("y"))
    folds = fold_grams(plain, "s", [*(f"x{i}" for i in range(p)), *(f"n{i}" for i in range(p)), "y"])
    fills = fold_medians(rows, subject, features).groupBy(F.col(subject).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m"))
    folds = folds.join(fills, "s", "left").select("s", "rest", F.array(*(F.coalesce(F.col("m")[f], F.lit(0.0)) for f in features)).alias("fills"))
    # whether the others' targets differ: their least and greatest, from the two outermost subjects at each end
    ends = plain.groupBy("s").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    low, high = ends.orderBy("low").limit(2).collect(), ends.orderBy(F.desc("high")).limit(2).collect()
    other = lambda two, c: F.when(F.col("s") == two[0].s, F.lit(two[1][c] if len(two) > 1 else None)).otherwise(F.lit(two[0][c])) if two else F.lit(None)
    folds = folds.withColumn("varied", F.coalesce(other(low, "low") < other(high, "high"), F.lit(False)))

    def fit(row: pd.Series) -> dict:
        g = np.asarray(row["rest"], np.float64).reshape(2 * p + 2, 2 * p + 2)
        n, fill = round(g[0, 0]), np.asarray(row["fills"], np.float64)
        names = {"s": row["s"], "fills": fill, "n": n}
        if n < least or not row["varied"]:
            return names | {"weights": None, "means": None, "scales": None, "y_mean": None, "fold_status": "insufficient_training_data"}
        there = n - g[0, p + 1 : 2 * p + 1]
        mean = np.where(there > 0, g[0, 1 : p + 1] / np.maximum(there, 1), 0.0 - np.array(mid[:p]))
        impute = np.zeros((p, 2 * p + 1))  # imputed, centred features from (1, values, missing)
        impute[:, 1 : p + 1], impute[:, p + 1 :] = np.eye(p), np.diag(fill - np.array(mid[:p]))
        whole = impute @ g[:-1, :-1] @ impute.T
        var = np.diag(whole) / n - (impute @ g[:-1, 0] / n) ** 2
        scale = np.sqrt(np.maximum(var, 0))
        scale = np.where(scale > 1e-9 * np.sqrt(np.maximum(np.diag(whole) / n, 1e-300)), scale, 1.0)
        impute[:, 0] = -mean
        z = impute / scale[:, None]
        y_mean = g[0, -1] / n
        low = np.linalg.cholesky(z @ g[:-1, :-1] @ z.T + alpha * np.eye(p))
        beta = np.linalg.solve(low.T, np.linalg.solve(low, z @ (g[:-1, -1] - y_mean * g[:-1, 0])))
        return names | {"weights": beta, "means": mean + np.array(mid[:p]), "scales": scale, "y_mean": y_mean + mid[-1], "fold_status": "ok"}

    kind = dict(rows.dtypes)[subject]
    schema = f"s {kind}, fills array<double>, n long, weights array<double>, means array<double>, scales array<double>, y_mean double, fold_status string"
    models = per_fold(folds, fit, schema).withColumnRenamed("s", subject)
    terms = [F.col("weights")[i] * (F.coalesce(present(f), F.col("fills")[i]) - F.col("means")[i]) / F.col("scales")[i] for i, f in enumerate(features)]
    predicted = rows.join(models, subject).withColumn("y_pred", sum(terms, F.col("y_mean")))
    return predicted.select(*rows.columns, "y_pred", "fold_status"), models


# residuals


def residuals(rows: DataFrame, subject: str, factors: list[str], features: list[str]) -> DataFrame:
    """``rows`` with ``r_<feature>``: what least squares on the factors' levels, fitted to the other subjects, leaves of each feature.

    Dummy coding with an intercept and no level left out, solved by the least-norm solution. A level that the other subjects do
    not have adds nothing, nor does a null one. Missing features give missing residuals, and their rows are left out of the fit.
    The factors' levels are gathered: they are few, as each is a column of the design.
    """
    levels = {f: [r[0] for r in rows.where(F.col(f).isNotNull()).select(f).distinct().orderBy(f).collect()] for f in factors}
    coded = [(F.col(f) == F.lit(v)) for f in factors for v in levels[f]]
    mid, k, p = centres(rows, features), 1 + len(coded), len(features)
    there = rows.where(F.col(subject).isNotNull())
    for f in features:
        there = there.where(present(f).isNotNull())
    design = there.select(F.col(subject).alias("s"), *(F.coalesce(c, F.lit(False)).cast("double").alias(f"d{i}") for i, c in enumerate(coded)), *((present(f) - F.lit(m)).alias(f"y{i}") for i, (f, m) in enumerate(zip(features, mid))))

    def fit(row: pd.Series) -> dict:
        g = np.asarray(row["rest"], np.float64).reshape(k + p, k + p)
        # least-norm solutions of the features as they are, not centred: a row with an unseen level shows the difference
        return {"s": row["s"], "beta": (np.linalg.pinv(g[:k, :k], rcond=1e-10, hermitian=True) @ (g[:k, k:] + np.outer(g[:k, 0], mid))).ravel()}

    folds = fold_grams(design, "s", [*(f"d{i}" for i in range(k - 1)), *(f"y{i}" for i in range(p))])
    models = per_fold(folds, fit, f"s {dict(rows.dtypes)[subject]}, beta array<double>")
    place, at = {}, 1
    for f in factors:
        index = F.lit(None).cast("int")
        for v in levels[f]:
            index, at = F.when(F.col(f) == F.lit(v), F.lit(at)).otherwise(index), at + 1
        place[f] = index
    fitted = [sum((F.coalesce(F.get("beta", place[f] * p + i), F.lit(0.0)) for f in factors), F.col("beta")[i]) for i in range(p)]
    joined = rows.join(models.withColumnRenamed("s", subject), subject)
    return joined.select(*rows.columns, *((present(f) - fit).alias(f"r_{f}") for f, fit in zip(features, fitted)))


# metrics

#: What is added to a covariance, and size and shrinkage of the low-rank metric.
RIDGE, RANK, SHRINKAGE, COMPONENTS = 0.1, 10, 0.25, 2
KINDS = ("plain", "mahalanobis", "components", "low_rank", "low_rank_components")


def low_rank(cov: np.ndarray, n: int, rank: int = RANK, shrinkage: float = SHRINKAGE) -> np.ndarray:
    """The transform of a low-rank metric: leading directions over the roots of their variances, which are drawn to their mean."""
    values, vectors = np.linalg.eigh(cov)
    keep = np.argsort(values)[::-1][: min(rank, len(values), max(1, n - 2))]
    held = np.maximum(values[keep], 1e-6)
    return vectors[:, keep].T / np.sqrt((1 - shrinkage) * held + shrinkage * held.mean())[:, None]


def leading(scatter: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` leading directions, none without variance."""
    values, vectors = np.linalg.eigh(scatter)
    keep = np.argsort(values)[::-1][:n]
    return vectors[:, keep[values[keep] > 1e-10 * max(values.max(), 1e-300)]].T


def fold_metrics(states: DataFrame, subject: str, features: list[str], kind: str, components: int = COMPONENTS) -> DataFrame:
    """``subject``, ``scales``, ``transform`` (rows of a matrix, flat): the metric that the other subjects' states give.

    The distance of two states is the length of transform @ (difference / scales). ``mahalanobis``: the inverse of the covariance
    plus 0.1; ``components``: without the leading directions in which subjects' means differ; ``low_rank``: the leading directions
    of the covariance, shrunk; ``low_rank_components``: those of what is left without the subjects' directions. States without a
    subject or with a missing feature take no part; subjects with under three other states have no metric.
    """
    d = len(features)
    whole = states.where(F.col(subject).isNotNull())
    for f in features:
        whole = whole.where(present(f).isNotNull())
    mid = centres(whole, features)
    plain = whole.select(F.col(subject).alias("s"), *((present(f) - F.lit(m)).alias(f"x{i}") for i, (f, m) in enumerate(zip(features, mid))))
    names = [f"x{i}" for i in range(d)]
    folds = fold_grams(plain, "s", names).withColumnRenamed("rest", "rows")
    means = plain.groupBy("s").agg(*(F.avg(c).alias(c) for c in names))
    folds = folds.join(fold_grams(means, "s", names).withColumnRenamed("rest", "means"), "s")

    def scatter(flat: np.ndarray) -> tuple[int, np.ndarray]:
        g = np.asarray(flat, np.float64).reshape(d + 1, d + 1)
        n = round(g[0, 0])
        return n, g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(n, 1)

    def fit(row: pd.Series) -> dict:
        n, spread = scatter(row["rows"])
        if n < 3:
            return {"s": row["s"], "scales": None, "transform": None}
        cov = spread / (n - 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(scale >= 1e-8, scale, 1.0)
        cov = cov / np.outer(scale, scale)
        left = np.eye(d)
        if kind in ("components", "low_rank_components"):
            m, between = scatter(row["means"])
            if m > 1:
                found = leading(between / np.outer(scale, scale), components)
                left = left - found.T @ found
        if kind == "mahalanobis":
            left = np.linalg.cholesky(np.linalg.inv(cov + RIDGE * np.eye(d))).T
        elif kind.startswith("low_rank"):
            left = low_rank(left @ cov @ left.T, n) @ left
        return {"s": row["s"], "scales": scale, "transform": left.ravel()}

    fitted = per_fold(folds, fit, f"s {dict(states.dtypes)[subject]}, scales array<double>, transform array<double>")
    return fitted.where("transform is not null").withColumnRenamed("s", subject)


def metric_scores(queries: DataFrame, candidates: DataFrame, metrics: DataFrame, subject: str, block: list[str], features: list[str]) -> DataFrame:
    """``block``, ``query``, ``candidate``, ``score``: distances of every query from the candidates of its block, by its subject's metric.

    ``queries`` and ``candidates`` have ``id``, the block's columns and the features, queries the subject too.
    """
    d = len(features)
    asked = queries.join(metrics, subject).select(F.col("id").alias("query"), *block, F.array(*(present(f) for f in features)).alias("q"), "scales", "transform")
    met = asked.join(candidates.select(F.col("id").alias("candidate"), *block, F.array(*(present(f) for f in features)).alias("c")), block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                gap = (np.stack(b["q"].to_numpy()).astype(np.float64) - np.stack(b["c"].to_numpy()).astype(np.float64)) / np.stack(b["scales"].to_numpy())
                score = np.empty(len(b))
                for _, at in b.groupby("query").indices.items():  # a query's rows share its transform
                    score[at] = np.linalg.norm(gap[at] @ b["transform"].iloc[at[0]].reshape(-1, d).T, axis=1)
                yield b[["query", "candidate", *block]].assign(score=np.where(np.isfinite(score), score, None))

    kinds = dict(met.dtypes)
    return met.mapInPandas(run, f"query {kinds['query']}, candidate {kinds['candidate']}, " + ", ".join(f"{c} {kinds[c]}" for c in block) + ", score double")
