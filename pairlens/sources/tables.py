"""Readers, writers, listings, hashes and freshness of tables and files, through Spark's own readers and file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAIR_KEYS = ("subject", "session", "task", "run")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists_and_filled(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there and holds bytes, on any file system that Spark can reach."""
    fs, found = _path(spark, path)
    return bool(fs.exists(found)) and fs.getContentSummary(found).getLength() > 0


def modified(spark: SparkSession, path: str) -> int | None:
    """Milliseconds of the last change; None if it isn't there."""
    fs, found = _path(spark, path)
    return int(fs.getFileStatus(found).getModificationTime()) if fs.exists(found) else None


def is_fresh(spark: SparkSession, outputs: list[str], inputs: list[str], force: bool = False) -> bool:
    """Whether a step can be left out: every output is there, filled, and no older than the newest input."""
    if force or not outputs or not all(exists_and_filled(spark, x) for x in outputs):
        return False
    times = [t for x in inputs if (t := modified(spark, x)) is not None]
    return not times or min(modified(spark, x) for x in outputs) >= max(times)


def read_table(spark: SparkSession, base: str, schema: StructType | str | None = None, prefer_parquet: bool = True) -> DataFrame:
    """``base``.parquet if it is there, else ``base``.csv; NaN becomes null, as missing numbers are null in every operator."""
    kinds = ("parquet", "csv") if prefer_parquet else ("csv", "parquet")
    kind = next((k for k in kinds if exists_and_filled(spark, f"{base}.{k}")), None)
    if kind is None:
        raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv")
    return no_nan(spark.read.parquet(f"{base}.parquet") if kind == "parquet" else read_text_table(spark, f"{base}.csv", schema))


def read_text_table(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; types from ``schema`` or, without one, by a pass over the file. A byte-order mark before the first
    column's name goes."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "").option("nanValue", "nan")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_optional(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """The table, or one of its schema without rows if it isn't there."""
    return read_text_table(spark, path, schema, sep) if exists_and_filled(spark, path) else spark.createDataFrame([], schema)


def read_state_vectors(spark: SparkSession, base: str, keys: tuple[str, ...] = PAIR_KEYS) -> DataFrame:
    """State vectors with their keys as text, ``unknown`` where they are missing."""
    df = read_table(spark, base)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) if c in keys else F.col(c) for c in df.columns])


def read_json_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document; empty if it isn't there."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists_and_filled(spark, path) else {}


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``subspace``, ``position``, ``feature`` of a document {"subspaces": {name: [feature, ..]}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "subspaces map<string, array<string>>").alias("d"))
    return whole.select(F.explode("d.subspaces").alias("subspace", "features")).select("subspace", F.posexplode("features").alias("position", "feature"))


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path``, ``length``, ``modified`` of the files below ``root`` whose names match; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.where(~F.col("path").rlike(r"/\.")).select("path", "length", F.col("modificationTime").alias("modified"))


def hash_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path``, ``sha256`` of whole files, each read by one task."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def verify_listed(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``listed`` (``name``) with whether a file of that name is there and its length."""
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return listed.join(there, "name", "left").withColumn("there", F.col("length").isNotNull())


def no_nan(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, base: str, formats: tuple[str, ...] = ("parquet",)) -> list[str]:
    """Writes ``base``.parquet and/or ``base``.csv (folders of part files) and returns their paths."""
    out = []
    for kind in formats:
        path = f"{base}.{kind}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
        out.append(path)
    return out


def write_metadata(spark: SparkSession, path: str, hashes: DataFrame, **about: str) -> None:
    """One JSON document on a run: what the caller says and the hashes of its inputs (a row a file)."""
    facts = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(about.items())], F.col("inputs"), F.current_timestamp().alias("written")))
    hashes.groupBy().agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("inputs")).select(facts.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def failure_log(checks: DataFrame) -> DataFrame:
    """Rows of ``checks`` (``recording``, ``status``, ..) that are not ok; one that says so if there is none."""
    bad = checks.where(F.coalesce(F.col("status"), F.lit("missing")) != "ok")
    none = checks.sparkSession.range(1).select(*[(F.lit("none") if c == "status" else F.lit(None)).cast(t).alias(c) for c, t in checks.dtypes])
    return bad.unionByName(none.join(bad.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_anti"))
