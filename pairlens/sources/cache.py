"""Tables computed once into the shared folder, and read back while their inputs and their recipe stay the same."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (single machines and tests), the session's checkpoint folder or a new local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-"))
        found = sc.getCheckpointDir()
    return found


def _place(spark: SparkSession, path: str):  # noqa: ANN202  a file system and a path of the JVM
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stamp(spark: SparkSession, inputs: list[str]) -> str:
    """Names, sizes and times of all files of the inputs, by Spark's file systems, as one hash; missing inputs count as such."""
    found = []
    for path in sorted(inputs):
        fs, where = _place(spark, path)
        if not fs.exists(where):
            found.append(f"{path} missing")
            continue
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def load_or_build(spark: SparkSession, name: str, inputs: list[str], recipe: str, build: Callable[[], DataFrame], base: str | None = None) -> DataFrame:
    """The table ``name``: read from the shared folder if the same inputs and recipe made it before, else built and written.

    It is written beside its place and moved there whole, so a writer that fails leaves nothing that looks finished, and of two
    that build at once one wins. ``base``: another folder that driver and executors share.
    """
    key = hashlib.sha256(f"{recipe}\n{stamp(spark, inputs)}".encode()).hexdigest()[:32]
    home = f"{base or shared_dir(spark)}/pairlens-tables"
    fs, where = _place(spark, f"{home}/{name}-{key}")
    if not fs.exists(where):
        _, draft = _place(spark, f"{home}/draft-{uuid.uuid4().hex}")
        build().write.parquet(draft.toString())
        if fs.exists(where) or not fs.rename(draft, where):
            fs.delete(draft, True)
    return spark.read.parquet(where.toString())


def forget(spark: SparkSession, base: str | None = None) -> None:
    """Deletes all tables that were kept."""
    fs, where = _place(spark, f"{base or shared_dir(spark)}/pairlens-tables")
    fs.delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and checkpointed in the shared folder, without how it came about."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
