"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (tests only) a fresh local one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        found = tempfile.mkdtemp(prefix="pairlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def give_back() -> None:
    """Returns a worker's freed memory to the system, as workers stay while other queries run (glibc only; elsewhere nothing)."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes an execution's exchange files when the execution ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once, in the shared folder, and forgets how it came about, with its exchange files."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Scratch:
    """Written tables in the shared folder, deleted when the block ends: ``with Scratch(spark) as keep: t = keep(df)``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.at: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.base}/{self.n}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.n}")
        self.at[id(kept)] = f"{self.base}/{self.n}"
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Deletes one of the tables, once what was made of it is kept too."""
        self._delete(self.at.pop(id(kept)))

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self._delete(self.base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(df: DataFrame, column: str, fn: Callable[[list], tuple[pa.Array, ...]], fields: str) -> DataFrame:
    """``df`` with new columns ``fields`` that ``fn`` makes of a batch of ``column``'s values; other columns pass untouched."""
    at, added = df.columns.index(column), StructType.fromDDL(fields)
    names = [*df.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(b.column(at).to_pylist())], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


#: So many links (16 bytes each) one task settles at once; more take the rounds.
FEW_LINKS = 1 << 19


def _few_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        both = pd.concat(parts)
        names, flat = np.unique(both[["a", "b"]].to_numpy(), return_inverse=True)
        u, v = flat.reshape(-1, 2).T
        label, now = np.arange(len(names)), None
        while now is None or (now != label).any():
            now, low = label, np.minimum(label[u], label[v])
            label = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            np.minimum.at(label, now[u], low)
            np.minimum.at(label, now[v], low)
            while (label[label] != label).any():
                label = label[label]
        yield pd.DataFrame({"node": names, "component": names[label]})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: columns ``a``, ``b`` (same orderable type). Self loops and repeats are harmless. Returns ``node``, ``component``
    (the smallest node reachable) for every node that has a link to another one. Each round only sends every node's links to the
    smallest node known nearby, so a hub costs one aggregate and one splittable join; rounds grow with the logarithm of the
    longest chain. Every round is checkpointed, so a lost executor repeats one round at most. Up to ``FEW_LINKS`` links between longs
    are settled by a single task, which spares the rounds.
    """

    def small(e: DataFrame) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return star(e, e)

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return star(both, both.where("b > a"))

    def star(seen: DataFrame, moved: DataFrame) -> DataFrame:
        least = cut(seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        links = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return links.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = stamp(now)
    if 0 < mark[0] <= FEW_LINKS and now.schema["a"].dataType == LongType():
        return now.coalesce(1).mapInPandas(_few_links, "node long, component long")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = cut(small(large(now)))
        was, mark = mark, stamp(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
