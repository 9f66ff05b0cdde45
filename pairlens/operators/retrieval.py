"""Paired-state retrieval: state vectors, pairs, scaling without the query's subject, distances, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("quantity", "price", "discount", "tax")


def state_vectors(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Means per (subject, task, state): subject is the supplier's nation, task the line status, states A (off) and R (on)."""
    rows = lineitem.where(F.col("l_returnflag").isin("A", "R")).join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("subject")), "l_suppkey")
    named = rows.select("subject", F.col("l_linestatus").alias("task"), F.col("l_returnflag").alias("state"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return named.groupBy("subject", "task", "state").agg(F.count(F.lit(1)).alias("n_rows"), *[F.round(F.avg(c), 8).alias(c) for c in FEATURES])


def pairs(vectors: DataFrame) -> DataFrame:
    """A row per (subject, task) with both states: ``x_*`` off, ``y_*`` on minus off."""
    off = vectors.where("state = 'A'").select("subject", "task", *[F.col(c).alias(f"x_{c}") for c in FEATURES])
    on = vectors.where("state = 'R'").select("subject", "task", *[F.col(c).alias(f"on_{c}") for c in FEATURES])
    both = off.join(on, ["subject", "task"])
    return both.select("subject", "task", *[f"x_{c}" for c in FEATURES], *[F.round(F.col(f"on_{c}") - F.col(f"x_{c}"), 8).alias(f"y_{c}") for c in FEATURES])


def fold_scale(pairs: DataFrame) -> DataFrame:
    """Mean and sample deviation of each feature over off and on states of all other subjects, from totals less the subject's own."""
    states = pairs.select("subject", F.explode(F.array(*[F.struct(*[(F.col(f"x_{c}") + (F.col(f"y_{c}") if on else F.lit(0.0))).alias(c) for c in FEATURES]) for on in (False, True)])).alias("v")).select("subject", "v.*")
    own = states.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in FEATURES], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in FEATURES])
    totals = own.agg(F.sum("n").alias("n_all"), *[F.sum(f"{k}_{c}").alias(f"{k}a_{c}") for k in "sq" for c in FEATURES])
    m, out = F.col("n_all") - F.col("n"), ["subject"]
    for c in FEATURES:
        mean = (F.col(f"sa_{c}") - F.col(f"s_{c}")) / m
        sd = F.sqrt(F.greatest((F.col(f"qa_{c}") - F.col(f"q_{c}") - m * mean * mean) / (m - 1), F.lit(0.0)))
        out += [mean.alias(f"m_{c}"), F.when(sd >= 1e-8, sd).otherwise(F.lit(1.0)).alias(f"d_{c}")]
    return own.crossJoin(F.broadcast(totals)).where(m > 1).select(*out)  # totals: one row


def ranked_candidates(table: DataFrame) -> DataFrame:
    """Candidates of every pair among the pairs of its task, ranked by distance of the scaled vectors; ties go to the smaller subject.

    The query is the off state, a candidate's vector its off state plus its change; scaling is fitted to both states of all other subjects (a subject without others has no row).
    """
    query = table.join(fold_scale(table), "subject").select(F.col("subject").alias("query"), "task", *[F.col(f"x_{c}").alias(f"q_{c}") for c in FEATURES], *[f"d_{c}" for c in FEATURES])
    other = table.select(F.col("subject").alias("candidate"), "task", *[(F.col(f"x_{c}") + F.col(f"y_{c}")).alias(f"c_{c}") for c in FEATURES])
    distance = sum((((F.col(f"q_{c}") - F.col(f"c_{c}")) / F.col(f"d_{c}")) ** 2 for c in FEATURES), F.lit(0.0))
    scored = query.join(other, "task").select("task", "query", "candidate", F.round(F.sqrt(distance), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("task", "query").orderBy("score", "candidate"))
    return scored.withColumn("rank", rank).withColumn("is_true", F.col("query") == F.col("candidate"))


def metrics(ranked: DataFrame, *by: str) -> DataFrame:
    true = ranked.where("is_true")
    return true.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("top1"),
        F.round(F.avg((F.col("rank") <= 3).cast("double")), 6).alias("top3"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"),
    )


def diagnostics(ranked: DataFrame) -> DataFrame:
    """Per query: rank of the true candidate, its score, the best wrong one, and the margin between them."""
    grouped = ranked.groupBy("task", "query").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min(F.when(F.col("is_true"), F.col("rank"))).alias("true_rank"),
        F.min(F.when(F.col("is_true"), F.col("score"))).alias("true_score"), F.min(F.when(~F.col("is_true"), F.col("score"))).alias("best_wrong"),
    )
    return grouped.withColumn("margin", F.round(F.col("best_wrong") - F.col("true_score"), 6))


def subject_left_out(ranked: DataFrame) -> DataFrame:
    """Metrics without each subject's queries, from sums."""
    true = ranked.where("is_true").select(F.col("query").alias("subject"), (F.col("rank") == 1).cast("double").alias("hit"), (1 / F.col("rank")).alias("rr"))
    own = true.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.sum("rr").alias("r"))
    every = true.agg(F.count(F.lit(1)).alias("na"), F.sum("hit").alias("ha"), F.sum("rr").alias("ra"))
    both = own.crossJoin(F.broadcast(every)).where("na > n")
    return both.select("subject", (F.col("na") - F.col("n")).alias("n_queries"), F.round((F.col("ha") - F.col("h")) / (F.col("na") - F.col("n")), 6).alias("top1"), F.round((F.col("ra") - F.col("r")) / (F.col("na") - F.col("n")), 6).alias("mrr"))
