"""Retrieval refitted to subsets of the pairs: pools, scales and ranks are made anew in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators import pools as P
from pairlens.operators.retrieval import FEATURES

# fixed values of the collapse rule
TOP1_DROP, MRR_DROP, LEAST_TOP1 = 0.25, 0.20, 0.50
WHOLE = "all"


def left_out(pairs: DataFrame, column: str, label: str) -> DataFrame:
    """``condition``, subject, task: for each value of ``column`` the pairs of all other values, named ``label``:value.

    A pair is in as many subsets as there are other values, by definition; pairs without a value are in each.
    """
    rows = pairs.select("subject", "task", F.col(column).cast("string").alias("value"))
    names = rows.select(F.col("value").alias("gone")).where("gone is not null").distinct()
    kept = rows.join(names, ~F.col("value").eqNullSafe(F.col("gone")))
    return kept.select(F.concat(F.lit(f"{label}:"), "gone").alias("condition"), "subject", "task")


def kept_only(pairs: DataFrame, column: str, label: str) -> DataFrame:
    """``condition``, subject, task: a subset for each value of ``column``."""
    return pairs.where(F.col(column).isNotNull()).select(F.concat(F.lit(f"{label}:"), F.col(column).cast("string")).alias("condition"), "subject", "task")


def whole(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit(WHOLE).alias("condition"), "subject", "task")


def fold_scales(members: DataFrame) -> DataFrame:
    """Mean ``m_*`` and sample deviation ``d_*`` of each subset's states without each of its subjects, from sums less the subject's own."""
    states = members.select("condition", "subject", F.explode(F.array(*(F.struct(*((F.col(f"x_{c}") + (F.col(f"y_{c}") if on else F.lit(0.0))).alias(c) for c in FEATURES)) for on in (False, True)))).alias("v")).select("condition", "subject", "v.*")
    own = states.groupBy("condition", "subject").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in FEATURES), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in FEATURES))
    w = Window.partitionBy("condition")  # a row a subject
    rest = {k: F.sum(k).over(w) - F.col(k) for k in ("n", *(f"{k}_{c}" for k in "sq" for c in FEATURES))}
    less = own.select("condition", "subject", *(v.alias(k) for k, v in rest.items())).where("n > 1")
    out = []
    for c in FEATURES:
        mean = F.col(f"s_{c}") / F.col("n")
        sd = F.sqrt(F.greatest((F.col(f"q_{c}") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
        out += [mean.alias(f"m_{c}"), F.when(sd >= 1e-8, sd).otherwise(F.lit(1.0)).alias(f"d_{c}")]
    return less.select("condition", "subject", *out)


def refitted_scores(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """As ``pools.pool_scores`` with a subset for a condition: candidates are the pairs of the query's task in its subset.

    ``members``: condition, subject, task (once each). Subsets in which nobody else has two states give no rows for that subject.
    """
    rows = members.select("condition", "subject", "task").join(pairs, ["subject", "task"])
    left = rows.join(fold_scales(rows), ["condition", "subject"]).select("condition", F.col("subject").alias("q_subject"), F.col("task").alias("q_task"), *(F.col(f"x_{c}").alias(f"q_{c}") for c in FEATURES), *(f"{k}_{c}" for k in "md" for c in FEATURES))
    right = rows.select("condition", F.col("task").alias("q_task"), F.col("subject").alias("c_subject"), F.col("task").alias("c_task"), *((F.col(f"x_{c}") + F.col(f"y_{c}")).alias(f"c_{c}") for c in FEATURES))
    z = lambda side, c: (F.col(f"{side}_{c}") - F.col(f"m_{c}")) / F.col(f"d_{c}")
    distance = sum((P.cosine_distance([z("q", c) for c in g], [z("c", c) for c in g]) for g in P.GROUPS), F.lit(0.0)) / len(P.GROUPS)
    second = F.abs(z("q", "price") - z("c", "price"))
    return P.ranked(left.join(right, ["condition", "q_task"]).select(*P.QUERY, *P.CANDIDATE, F.round(distance, 6).alias("score"), F.round(second, 6).alias("second")))


def sensitivity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per subset: its pairs and subjects, top1 and mean reciprocal rank of the base and the gated order, what they lose against the
    whole, and whether the gated order collapses. ``members`` must hold the subset WHOLE; one without any query has null metrics."""
    both = P.gated(refitted_scores(pairs, members))
    true = both.where((F.col("q_subject") == F.col("c_subject")) & (F.col("q_task") == F.col("c_task")))
    rates = [f(F.col(r)).alias(f"{n}_{m}") for n, r in (("base", "rank"), ("gated", "new_rank")) for m, f in (("top1", lambda x: F.avg((x == 1).cast("double"))), ("mrr", lambda x: F.avg(1 / x)))]
    found = true.groupBy("condition").agg(F.count(F.lit(1)).alias("n_queries"), *rates)
    sizes = members.join(pairs.select("subject", "task"), ["subject", "task"]).groupBy("condition").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("subject").alias("n_subjects"))
    seen = found.where(F.col("condition") == WHOLE).select(F.col("gated_top1").alias("t"), F.col("gated_mrr").alias("r"))
    lost = sizes.join(found, "condition", "left").join(F.broadcast(seen))  # one row
    lost = lost.withColumn("top1_drop", F.col("t") - F.col("gated_top1")).withColumn("mrr_drop", F.col("r") - F.col("gated_mrr")).drop("t", "r")
    gain = [(F.col(f"gated_{m}") - F.col(f"base_{m}")).alias(f"gain_{m}") for m in ("top1", "mrr")]
    collapse = (F.col("top1_drop") >= TOP1_DROP - 1e-12) | (F.col("mrr_drop") >= MRR_DROP - 1e-12) | (F.col("gated_top1") <= LEAST_TOP1)
    return lost.select("*", *gain, collapse.alias("collapse"))
