"""Refits on subsets against running the plain pools on the subset's pairs alone."""

import numpy as np

from pairlens.operators import pools as P
from pairlens.operators import sensitivity as V
from pairlens.operators.retrieval import FEATURES

SCHEMA = "subject int, task string, " + ", ".join(f"{k}_{c} double" for k in "xy" for c in FEATURES)


def cohort(spark):
    rng = np.random.default_rng(11)
    rows = [(s, t, *map(float, rng.normal(size=8))) for s in range(7) for t in "ABC" if (s + ord(t)) % 5]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_refits_equal_running_on_the_subset_alone(spark):
    pairs = cohort(spark)
    members = V.whole(pairs).unionByName(V.left_out(pairs, "subject", "without")).unionByName(V.left_out(pairs, "task", "no")).unionByName(V.kept_only(pairs, "task", "only"))
    got = {}
    for r in V.refitted_scores(pairs, members).collect():
        got.setdefault(r["condition"], {})[r["q_subject"], r["q_task"], r["c_subject"]] = (r["score"], r["second"], r["rank"])
    assert len(got) == 1 + 7 + 3 + 3
    for name, some in (("all", "true"), ("without:2", "subject <> 2"), ("no:B", "task <> 'B'"), ("only:C", "task = 'C'")):
        alone = {(r["q_subject"], r["q_task"], r["c_subject"]): (r["score"], r["second"], r["rank"]) for r in P.pool_scores(pairs.where(some), ("same_task",)).collect()}
        assert set(got[name]) == set(alone)
        assert all(np.allclose(got[name][k][:2], alone[k][:2], atol=2e-6) and got[name][k][2] == alone[k][2] for k in alone), name
    table = {r["condition"]: r for r in V.sensitivity(pairs, members).collect()}
    for name, some in (("all", "true"), ("without:4", "subject <> 4")):
        both = [r for r in P.gated(P.pool_scores(pairs.where(some), ("same_task",))).collect() if r["q_subject"] == r["c_subject"]]
        assert table[name]["n_pairs"] == table[name]["n_queries"] == len(both)
        assert np.isclose(table[name]["gated_mrr"], np.mean([1 / r["new_rank"] for r in both])) and np.isclose(table[name]["base_top1"], np.mean([r["rank"] == 1 for r in both]))
    for r in table.values():
        assert np.isclose(r["mrr_drop"], table["all"]["gated_mrr"] - r["gated_mrr"]) and r["collapse"] == (r["top1_drop"] >= 0.25 or r["mrr_drop"] >= 0.2 or r["gated_top1"] <= 0.5)


def test_refits_of_few_and_no_pairs(spark):
    pairs = cohort(spark)
    two = pairs.where("subject in (0, 2)")
    members = V.whole(two).unionByName(V.left_out(two, "subject", "without"))
    found = {r["condition"]: r for r in V.sensitivity(two, members).collect()}
    assert found["without:0"]["n_subjects"] == 1 and found["without:0"]["n_queries"] is None and found["without:0"]["gated_mrr"] is None
    none = pairs.limit(0)
    assert V.refitted_scores(none, V.whole(none)).count() == 0 and V.sensitivity(none, V.whole(none)).count() == 0
    unnamed = two.withColumn("ward", V.F.when(V.F.col("task") == "A", "w"))
    assert {r["task"] for r in V.left_out(unnamed, "ward", "ward").collect()} == {"B", "C"} & {r["task"] for r in two.collect()} and V.kept_only(unnamed, "ward", "w").where("task <> 'A'").count() == 0
