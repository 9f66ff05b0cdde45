"""Centroid clustering of integer vectors: equal vectors once, with their multiplicities as weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import cut, table
from pairlens.llm.va_topk import whole_vectors

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64


def first_centroids(rows: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors of the rows with the smallest sha256 of ``1:<vec_id>``, in that order; ties go to the smaller vector."""
    named = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [r.v for r in named.orderBy("h", "v").limit(clusters).collect()]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller number) and squared distance, in exact integers."""
    gaps = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = gaps.argmin(axis=1)
    return at, gaps[np.arange(len(at)), at]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def weighted_sums(weighted: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``cluster``, ``n`` and ``s`` (weighted componentwise sums) of the vectors nearest to each centroid.

    Every task sends a row a batch and cluster at most, so a cluster's rows meet as sums.
    """
    fixed, dim = np.array(centroids, np.int64), len(centroids[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, w = _matrix(b["v"]), b["n"].to_numpy(np.int64)
                at, _ = nearest(x, fixed)
                total = np.zeros((len(fixed), dim), np.int64)
                np.add.at(total, at, x * w[:, None])
                many = np.zeros(len(fixed), np.int64)
                np.add.at(many, at, w)
                held = np.flatnonzero(many)
                yield pd.DataFrame({"cluster": held, "n": many[held], "s": list(total[held])})

    parts = weighted.select("v", "n").mapInPandas(sums, "cluster int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact)


def moved(weighted: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round of Lloyd: centroids become floor(sum / count) of their vectors; empty ones stay."""
    out = list(centroids)
    for cluster, n, *s in weighted_sums(weighted, centroids).collect():  # a row a centroid
        out[cluster] = [int(x) // n for x in s]
    return out


def clusters_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` of every vector that takes part.

    Vectors with exactly ``dim`` components, none of them null or non-finite, and a vec_id take part, with components as
    floor(scale * x); each repeated row counts. Equal vectors are grouped before anything is moved, by partial sums, so copies cost
    a row a task; rounds run over the distinct vectors with weighted integer sums. Only the centroids and sums of as many rows
    come to the driver. Fewer rows than ``clusters`` give as many centroids; none give no rows. Components beyond 2**26 may
    overflow the integer distances.
    """
    rows = whole_vectors(vectors, scale).where(F.size("v") == dim)
    weighted = cut(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    centroids = first_centroids(rows, clusters)
    if centroids:
        for _ in range(rounds):
            centroids = moved(weighted, centroids)
    fixed = np.array(centroids, np.int64).reshape(-1, dim)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, gap = nearest(_matrix(b["v"]), fixed)
                yield pd.DataFrame({"v": b["v"], "n": b["n"], "cluster": at.astype(np.int32), "distance": gap})

    settled = cut(weighted.mapInPandas(assign, "v array<long>, n long, cluster int, distance long"))
    spread = settled.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("inertia")).collect()
    by_cluster = {r.cluster: r.inertia for r in spread}
    names = vectors.sparkSession.createDataFrame([(k, by_cluster.get(k, 0), sum(by_cluster.values()), list(map(int, c))) for k, c in enumerate(fixed)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(settled.select("v", "cluster", "distance"), "v").join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters_of(table(spark, sf_dir, "embeddings"))
    return out.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")
