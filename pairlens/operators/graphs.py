"""Graphs: Laplacian spectra of a group's graph, their distance, and signals along signed shortest paths of contacts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.sources.cache import checkpointed

#: Shorter signals are not reconstructed.
LEAST_SAMPLES = 128


def laplacian_spectra(edges: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """``by``, ``i`` (from 0), ``eigenvalue``: the ``k`` least eigenvalues (None: all) of each group's weighted Laplacian.

    ``edges``: by, a, b, weight, undirected; repeated ones add up, loops and missing ends or weights go. A group is one small dense
    matrix, of its nodes (regions), whatever the number of rows its weights are summed from.
    """
    kind = dict(edges.dtypes)[by]
    once = edges.where("a is not null and b is not null and weight is not null and a <> b").groupBy(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("weight"))

    def spectrum(g: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(np.concatenate([g["a"], g["b"]]))
        a, b = codes.reshape(2, -1)
        adjacency = np.zeros((len(names), len(names)))
        adjacency[a, b] = adjacency[b, a] = g["weight"]
        values = np.linalg.eigvalsh(np.diag(adjacency.sum(axis=1)) - adjacency)[:k]
        return pd.DataFrame({by: [g[by].iloc[0]] * len(values), "i": range(len(values)), "eigenvalue": values})

    return once.groupBy(by).applyInPandas(spectrum, f"{by} {kind}, i int, eigenvalue double")


def spectral_deviation(spectra: DataFrame, others: DataFrame, by: str) -> DataFrame:
    """``left``, ``right``, ``deviation``: root mean squared gap of the eigenvalues that both spectra have, for every two groups."""
    left, right = (t.select(F.col(by).alias(n), "i", F.col("eigenvalue").alias(f"e_{n}")) for t, n in ((spectra, "left"), (others, "right")))
    gap = F.col("e_left") - F.col("e_right")
    return left.join(right, "i").groupBy("left", "right").agg(F.sqrt(F.avg(gap * gap)).alias("deviation"))


def edge_paths(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``recording``, ``a``, ``b``, ``path``: the shortest way from contact a to contact b over a recording's bipolar edges.

    ``edges``: recording, lo, hi, at (their order). A path is an array of (lo, hi, sign), +1 where it goes from lo to hi; among
    shortest ones that whose edges come first. All recordings and targets go a step at a time, each step a join with the edges,
    and of the ways to a contact the best stays, so rows never exceed targets times contacts. Targets without a way have no row.
    """
    step = lambda sign: F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.lit(sign).alias("sign"))
    both = edges.select("recording", F.col("lo").alias("node"), F.col("hi").alias("next"), "at", step(1).alias("edge")).unionByName(edges.select("recording", F.col("hi").alias("node"), F.col("lo").alias("next"), "at", step(-1).alias("edge")))
    none = F.expr("cast(array() as array<struct<lo:int,hi:int,sign:int>>)")
    reached = checkpointed(targets.distinct().select("recording", "a", "b", F.col("a").alias("node"), F.expr("cast(array() as array<bigint>)").alias("key"), none.alias("path")))
    front = reached
    while front.where("node <> b").head(1):
        tried = front.where("node <> b").join(both, ["recording", "node"]).select("recording", "a", "b", F.col("next").alias("node"), F.concat("key", F.array(F.col("at").cast("bigint"))).alias("key"), F.concat("path", F.array("edge")).alias("path"))
        best = tried.groupBy("recording", "a", "b", "node").agg(F.min_by("path", "key").alias("path"), F.min("key").alias("key"))
        front = checkpointed(best.join(reached, ["recording", "a", "b", "node"], "left_anti").join(reached.where("node = b and a <> b").select("recording", "a", "b"), ["recording", "a", "b"], "left_anti").select(*reached.columns))
        reached = checkpointed(reached.unionByName(front))
    return reached.where("node = b and size(path) > 0").select("recording", "a", "b", "path")


def reconstructed(signals: DataFrame, paths: DataFrame, least: int = LEAST_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Signals of targets as signed sums along their paths, and where they come from.

    ``signals``: recording, lo, hi, n (sample number), value. Signals: recording, a, b, n, value, as long as the path's shortest
    edge, at samples that all its edges have. Provenance: recording, a, b, ``mode`` (``bipolar_path_sum``, or
    ``bipolar_path_too_short`` under ``least`` samples), ``path_length``, ``sources``.
    """
    sizes = signals.groupBy("recording", "lo", "hi").agg((F.max("n") + 1).alias("size"))
    parts = paths.select("recording", "a", "b", "path", F.explode("path").alias("e")).select("recording", "a", "b", F.size("path").alias("path_length"), "path", "e.*")
    labels = F.concat_ws(";", F.expr("transform(path, e -> concat(e.lo, e.hi, ':', if(e.sign > 0, '+1', '-1')))"))
    whole = parts.join(sizes, ["recording", "lo", "hi"]).groupBy("recording", "a", "b", "path_length", labels.alias("sources")).agg(F.min("size").alias("size"))
    mode = F.when(F.col("size") >= least, "bipolar_path_sum").otherwise("bipolar_path_too_short").alias("mode")
    provenance = whole.select("recording", "a", "b", mode, "path_length", "sources")
    wanted = parts.join(whole.where(F.col("size") >= least).select("recording", "a", "b", "size"), ["recording", "a", "b"])
    summed = wanted.join(signals, ["recording", "lo", "hi"]).where("n < size").groupBy("recording", "a", "b", "path_length", "n").agg(F.sum(F.col("sign") * F.col("value")).alias("value"), F.count(F.lit(1)).alias("met"))
    return summed.where("met = path_length").select("recording", "a", "b", "n", "value"), provenance
