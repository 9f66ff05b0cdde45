import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pairlens.sources import tables as T


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_meg.fif").write_bytes(b"abc")
    (tmp_path / "a" / ".hidden_meg.fif").write_bytes(b"h")
    (tmp_path / "rows.csv").write_text("﻿subject,run,value\n1,,1.5\n2,7,nan\n")
    (tmp_path / "rows.tsv").write_text("k\tv\na\t1\n")
    (tmp_path / "inv.json").write_text(json.dumps({"subspaces": {"s": ["f2", "f1"], "t": []}}))
    return tmp_path


def test_reads(spark, folder):
    got = T.read_state_vectors(spark, f"{folder}/rows").collect()
    assert [(r.subject, r.run, r.value) for r in got] == [("1", "unknown", 1.5), ("2", "7", None)]
    assert T.read_text_table(spark, f"{folder}/rows.tsv", sep="\t").collect()[0].asDict() == {"k": "a", "v": 1}
    assert T.read_optional(spark, f"{folder}/none.csv", "a int, b string").count() == 0
    assert [tuple(r) for r in T.read_inventory(spark, f"{folder}/inv.json").collect()] == [("s", 0, "f2"), ("s", 1, "f1")]
    assert T.read_json_document(spark, f"{folder}/inv.json")["subspaces"]["t"] == [] and T.read_json_document(spark, f"{folder}/no.json") == {}
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, f"{folder}/none")


def test_files(spark, folder):
    files = T.list_files(spark, str(folder), "*_meg.fif")
    assert [(r.path.split("/")[-1], r.length) for r in files.collect()] == [("x_meg.fif", 3)]
    assert T.hash_files(spark, f"{folder}/a/x_meg.fif").first().sha256 == hashlib.sha256(b"abc").hexdigest()
    listed = spark.createDataFrame([("x_meg.fif",), ("y_meg.fif",)], "name string")
    assert {r.name: r.there for r in T.verify_listed(listed, files).collect()} == {"x_meg.fif": True, "y_meg.fif": False}


def test_writes(spark, folder):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id int, name string, x double")
    paths = T.write_table(df, f"{folder}/out", ("csv", "parquet"))
    assert all(T.exists_and_filled(spark, p) for p in paths)
    for prefer in (True, False):
        assert sorted(map(tuple, T.read_table(spark, f"{folder}/out", "id int, name string, x double", prefer).collect())) == [(1, "a", 0.5), (2, None, None)]
    assert T.is_fresh(spark, paths, [f"{folder}/rows.csv"]) and not T.is_fresh(spark, paths, [], force=True) and not T.is_fresh(spark, [f"{folder}/no"], [])
    T.write_metadata(spark, f"{folder}/meta", T.hash_files(spark, f"{folder}/rows.csv"), command="test")
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    assert meta["command"] == "test" and len(meta["inputs"]) == 1
    checks = spark.createDataFrame([("r1", "ok"), ("r2", "read_error"), ("r3", None)], "recording string, status string")
    assert {r.recording for r in T.failure_log(checks).collect()} == {"r2", "r3"}
    assert [tuple(r) for r in T.failure_log(checks.where("status = 'ok'")).collect()] == [(None, "none")]


def test_tables_are_built_once_for_the_same_inputs_and_recipe(spark, tmp_path):
    from pairlens.sources import cache

    built, given = [], f"{tmp_path}/given.parquet"

    def build():
        built.append(1)
        return spark.read.parquet(given).withColumn("twice", F.col("id") * 2)

    spark.range(5).write.parquet(given)
    for recipe, times in (("double", 1), ("double", 1), ("double it", 2)):
        got = cache.load_or_build(spark, "t", [given], recipe, build, base=str(tmp_path))
        assert sorted(r.twice for r in got.collect()) == [0, 2, 4, 6, 8] and len(built) == times
    spark.range(7).write.mode("overwrite").parquet(given)
    assert cache.load_or_build(spark, "t", [given], "double", build, base=str(tmp_path)).count() == 7 and len(built) == 3
    with pytest.raises(ZeroDivisionError):
        cache.load_or_build(spark, "u", [given], "fails", lambda: 1 / 0, base=str(tmp_path))
    cache.forget(spark, str(tmp_path))
    assert cache.load_or_build(spark, "t", [given, f"{tmp_path}/none"], "double", build, base=str(tmp_path)).count() == 7 and len(built) == 4


def test_no_relation_reads_the_same_rows_twice(spark):
    from pairlens.plans import book, evidence

    for name in ("gate_table", "random_label_null", "condition_deltas", "state_pairs"):
        n = book.uses(name, evidence.BOOK)
        assert n[name] == 1 and n.get("windows", 1) == 1
    plan = book.run(spark, "/root/testdata/sf0.001", "gate_table", evidence.BOOK)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan") < 20
