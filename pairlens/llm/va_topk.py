"""Exact top-k inner-product search with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import cut, table

_WHOLE = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
_EXACT = "aggregate(zip_with(q, v, (a, b) -> a * b), 0L, (s, x) -> s + x)"


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``v``: components as floor(scale * x), without vectors that are null or hold null or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(f"vec_id is not null and embedding is not null and {_WHOLE}")
    return rows.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale}D * x) as bigint))").alias("v"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: ``class_id``, ``v``, ``ids`` (the k + 1 smallest vec_ids that hold it).

    The rank filter is applied before the shuffle too, so a vector that a third of the rows hold sends k + 1 rows a task.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    return cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.monotonically_increasing_id()))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of each query with any vector between low and high."""
    size = float(np.abs(q).max(initial=0)) * max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0))) * max(1, q.shape[1])
    kind = np.float64 if size < 2**52 else object
    q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, bits: int = 6, tile: int = 2048, query_tile: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest integer inner products of every query's vector with the others.

    ``is_query``: SQL condition on ``vec_id``. Ties go to the smaller vec_id; a row is never its own result. Equal vectors are one
    class, as candidates and as queries. Every component is quantised to ``bits`` bits between its least and greatest value (two
    numbers a dimension, the only statistics gathered). Blocks of quantised cells are scanned against blocks of queries for lower
    and upper bounds; what cannot be among a block's k + 1 best goes at once, then what lies below the (k + 1)th best lower bound
    of all blocks. Exact vectors of the most promising candidates are read first, and then only of those whose upper bound reaches
    the (k + 1)th exact score. Vectors that are null, or hold null or non-finite components, and null vec_ids take no part;
    vectors are compared with vectors of their own length only; repeated rows count once. Empty tables give no rows. Components
    beyond 2**31 may overflow the integer score.
    """
    rows = cut(whole_vectors(vectors, scale))
    classes = classes_of(rows, k)
    sized = classes.withColumn("dim", F.size("v"))
    edges = cut(sized.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    grid: dict[int, list] = {}
    for dim, i, low, high in edges.orderBy("dim", "i").collect():
        grid.setdefault(dim, []).append((low, max(1, -((low - high - 1) // (1 << bits)))))
    asked = cut(rows.where(is_query).join(classes.select("class_id", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q_id")))
    queries = cut(asked.select("q_id").distinct().join(classes.select(F.col("class_id").alias("q_id"), F.col("v").alias("q")), "q_id"))
    n_tiles, n_query_tiles = -(-classes.count() // tile), max(1, -(-queries.count() // query_tile))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A tile's vectors become the approximation file: a byte a component."""
        for b in batches:
            out = []
            for dim, flat in zip(b["dim"], b["flat"]):
                g = np.array(grid.get(dim, []), np.int64).reshape(-1, 2)
                x = np.asarray(flat, np.int64).reshape(-1, dim) if dim else np.empty((0, 0), np.int64)
                out.append(((x - g[:, 0]) // g[:, 1]).astype(np.uint8).tobytes())
            yield pd.DataFrame({"dim": b["dim"], "ids": b["ids"], "cells": out})

    spread = sized.withColumn("t", F.pmod(F.xxhash64("class_id"), F.lit(max(1, n_tiles))))
    tiles = spread.groupBy("dim", "t").agg(F.collect_list(F.struct("class_id", "v")).alias("all")).select("dim", F.col("all.class_id").alias("ids"), F.flatten("all.v").alias("flat"))
    files = cut(tiles.mapInPandas(cells, "dim int, ids array<long>, cells binary"))
    blocks = queries.withColumn("dim", F.size("q")).withColumn("b", F.pmod(F.xxhash64("q_id", F.lit(3)), F.lit(n_query_tiles)))
    blocks = blocks.groupBy("dim", "b").agg(F.collect_list(F.struct("q_id", "q")).alias("all")).select("dim", "b", F.col("all.q_id").alias("q_ids"), F.flatten("all.q").alias("q_flat"))
    met = files.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_query_tiles - 1)))).join(cut(blocks), ["dim", "b"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, ids, data, q_ids, q_flat in zip(*(batch[c] for c in ("dim", "ids", "cells", "q_ids", "q_flat"))):
                ids, q_ids = np.asarray(ids, np.int64), np.asarray(q_ids, np.int64)
                g = np.array(grid.get(dim, []), np.int64).reshape(-1, 2)
                low = np.frombuffer(data, np.uint8).reshape(len(ids), dim).astype(np.int64) * g[:, 1] + g[:, 0]
                least, most = bounds(np.asarray(q_flat, np.int64).reshape(len(q_ids), dim), low, low + g[:, 1] - 1)
                if len(ids) > k + 1:
                    floor = np.sort(least, axis=1)[:, -(k + 1)]
                    i, j = np.nonzero(most >= floor[:, None])
                else:
                    i, j = (x.ravel() for x in np.indices(least.shape))
                yield pd.DataFrame({"q_id": q_ids[i], "class_id": ids[j], "least": least[i, j].astype(np.int64), "most": most[i, j].astype(np.int64)})

    near = cut(met.mapInPandas(scan, "q_id long, class_id long, least long, most long"))
    best = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("least")))
    floor = cut(near.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("q_id").agg(F.min("least").alias("floor"), F.count(F.lit(1)).alias("n")))
    near = near.join(floor, "q_id").where(F.expr(f"n < {k + 1} or most >= floor")).select("q_id", "class_id", "most")
    near = cut(near.withColumn("turn", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("most"), "class_id"))))

    def exact(some: DataFrame) -> DataFrame:
        read = some.join(queries, "q_id").join(classes.select("class_id", "v", "ids"), "class_id")
        return read.select("q_id", "ids", F.expr(_EXACT).alias("score"))

    first = cut(exact(near.where(F.col("turn") <= 2 * (k + 1))))
    order = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score")))
    sure = cut(first.withColumn("r", order).where(F.col("r") == k + 1).select("q_id", F.col("score").alias("sure")))
    later = near.where(F.col("turn") > 2 * (k + 1)).join(sure, "q_id").where("most >= sure")
    scored = first.unionByName(exact(later.select("q_id", "class_id"))).select("q_id", F.explode("ids").alias("vec_id"), "score")
    top = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    top = cut(scored.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q_id", "vec_id", "score"))
    mine = asked.join(top, "q_id").where("vec_id <> query_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
