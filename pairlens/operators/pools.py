"""Candidate pools, group-balanced scores, rerankers and per-query diagnostics over pairs (subject, task, x_*, y_*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.retrieval import FEATURES, fold_scale

GROUPS = (("quantity", "price"), ("discount", "tax"))
CONDITIONS = ("same_task", "same_subject_added", "all")
QUERY = ("condition", "q_subject", "q_task")
CANDIDATE = ("c_subject", "c_task")
TOP_K, SECOND_WEIGHT, PENALTY = 5, 0.5, 2.0


def reverse_pairs(pairs: DataFrame) -> DataFrame:
    """Off and on states change places."""
    return pairs.select("subject", "task", *[(F.col(f"x_{c}") + F.col(f"y_{c}")).alias(f"x_{c}") for c in FEATURES], *[(-F.col(f"y_{c}")).alias(f"y_{c}") for c in FEATURES])


def cosine_distance(a: list[Column], b: list[Column]) -> Column:
    dot, x, y = (sum((u * v for u, v in zip(p, q)), F.lit(0.0)) for p, q in ((a, b), (a, a), (b, b)))
    size = F.sqrt(x) * F.sqrt(y)
    return F.when(size > 1e-12, 1 - dot / size).otherwise(F.lit(1.0))


def pool(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """Candidates of each query: equal tasks, those and the query's own subject, or all pairs (which is quadratic by definition)."""
    tasks = left.join(right, F.col("q_task") == F.col("c_task"))
    if condition == "same_task":
        return tasks
    if condition == "same_subject_added":
        return tasks.unionByName(left.join(right, (F.col("q_subject") == F.col("c_subject")) & (F.col("q_task") != F.col("c_task"))))
    return left.crossJoin(right)


def ranked(scores: DataFrame, by: str = "score", name: str = "rank") -> DataFrame:
    """Place of each candidate in its query's list, best first, ties by subject and task; and the list's length."""
    w = Window.partitionBy(*QUERY)
    return scores.withColumn(name, F.row_number().over(w.orderBy(by, *CANDIDATE))).withColumn("n_candidates", F.count(F.lit(1)).over(w))


def pool_scores(pairs: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """Mean over feature groups of the cosine distance of the query's off state and the candidate's on state, scaled without the
    query's subject; ``second``: distance in scaled price alone. A row per condition, query and candidate."""
    left = pairs.join(fold_scale(pairs), "subject").select(F.col("subject").alias("q_subject"), F.col("task").alias("q_task"), *[F.col(f"x_{c}").alias(f"q_{c}") for c in FEATURES], *[f"{k}_{c}" for k in "md" for c in FEATURES])
    right = pairs.select(F.col("subject").alias("c_subject"), F.col("task").alias("c_task"), *[(F.col(f"x_{c}") + F.col(f"y_{c}")).alias(f"c_{c}") for c in FEATURES])
    z = lambda side, c: (F.col(f"{side}_{c}") - F.col(f"m_{c}")) / F.col(f"d_{c}")
    distance = sum((cosine_distance([z("q", c) for c in g], [z("c", c) for c in g]) for g in GROUPS), F.lit(0.0)) / len(GROUPS)
    out = None
    for condition in conditions:
        some = pool(left, right, condition).select(F.lit(condition).alias("condition"), "q_subject", "q_task", *CANDIDATE, F.round(distance, 6).alias("score"), F.round(F.abs(z("q", "price") - z("c", "price")), 6).alias("second"))
        out = some if out is None else out.unionByName(some)
    return ranked(out)


def zscore(value: Column, w) -> Column:
    sd = F.stddev_pop(value).over(w)
    return (value - F.avg(value).over(w)) / F.when(sd > 1e-9, sd).otherwise(F.lit(1.0))


def gated(scores: DataFrame) -> DataFrame:
    """The first TOP_K places are ordered anew by both scores, standardised among themselves; the rest keep their order."""
    inside = F.col("rank") <= TOP_K
    w = Window.partitionBy(*QUERY, inside)
    new = F.when(inside, -(zscore(-F.col("score"), w) + SECOND_WEIGHT * zscore(-F.col("second"), w))).otherwise(1000.0 + F.col("rank"))
    return ranked(scores.withColumn("new_score", F.round(new, 6)), "new_score", "new_rank")


def with_reverse(scores: DataFrame, reverse: DataFrame) -> DataFrame:
    """Scores with those of the candidate as query, on to off; missing ones take the query's largest."""
    back = reverse.select("condition", F.col("c_subject").alias("q_subject"), F.col("c_task").alias("q_task"), F.col("q_subject").alias("c_subject"), F.col("q_task").alias("c_task"), F.col("score").alias("back"), F.col("rank").alias("back_rank"))
    both = scores.join(back, [*QUERY, *CANDIDATE], "left")
    return both.withColumn("back", F.coalesce("back", F.max("back").over(Window.partitionBy(*QUERY))))


def cycle(scores: DataFrame, reverse: DataFrame, penalties: bool = True) -> DataFrame:
    """Sum of the standardised scores in both directions; penalties for another task and for the query's own subject elsewhere."""
    w = Window.partitionBy(*QUERY)
    new = zscore(F.col("score"), w) + zscore(F.col("back"), w)
    if penalties:
        other = F.col("q_task") != F.col("c_task")
        new = new + PENALTY * other.cast("double") + PENALTY * (other & (F.col("q_subject") == F.col("c_subject"))).cast("double")
    return ranked(with_reverse(scores, reverse).withColumn("new_score", F.round(new, 6)), "new_score", "new_rank")


def k_reciprocal(scores: DataFrame, reverse: DataFrame) -> DataFrame:
    """As ``cycle`` without penalties, less one if each is among the other's first TOP_K, less the overlap of those lists."""
    name = F.concat_ws("|", "c_subject", "c_task")
    front = scores.where(F.col("rank") <= TOP_K).groupBy(*QUERY).agg(F.collect_set(name).alias("front"))
    behind = reverse.where(F.col("rank") <= TOP_K).groupBy("condition", F.col("q_subject").alias("c_subject"), F.col("q_task").alias("c_task")).agg(F.collect_set(name).alias("behind"))
    both = with_reverse(scores, reverse).join(front, list(QUERY), "left").join(behind, ["condition", *CANDIDATE], "left")
    union = F.size(F.array_union("front", "behind"))
    overlap = F.coalesce(F.when(union > 0, F.size(F.array_intersect("front", "behind")) / union), F.lit(0.0))
    mutual = F.coalesce(((F.col("rank") <= TOP_K) & (F.col("back_rank") <= TOP_K)).cast("double"), F.lit(0.0))
    w = Window.partitionBy(*QUERY)
    both = both.withColumn("mutual", mutual).withColumn("overlap", F.round(overlap, 6))
    new = zscore(F.col("score"), w) + zscore(F.col("back"), w) - (F.col("mutual") + F.col("overlap"))
    return ranked(both.withColumn("new_score", F.round(new, 6)), "new_score", "new_rank")


def query_diagnostics(scores: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    """Per query: true rank, first candidate, margin to the nearest distractor, reciprocal rank, percentile, chance and failure type."""
    true = (F.col("q_subject") == F.col("c_subject")) & (F.col("q_task") == F.col("c_task"))
    d = scores.groupBy(*QUERY).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max(F.when(true, F.col(rank))).alias("true_rank"), F.max(F.when(true, F.col(score))).alias("true_score"),
        F.min(F.when(~true, F.col(score))).alias("nearest"), F.min_by(F.struct("c_subject", "c_task"), rank).alias("top"),
    )
    same, task = F.col("top_subject") == F.col("q_subject"), F.col("top_task") == F.col("q_task")
    kind = F.when(F.col("true_rank").isNull(), "true_pair_missing").when(F.col("true_rank") == 1, "success").when(same, "same_subject_wrong_task").when(task, "other_subject_same_task").otherwise("other_subject_wrong_task")
    return d.select(
        *QUERY, "n_candidates", "true_rank", F.col("top.c_subject").alias("top_subject"), F.col("top.c_task").alias("top_task"), F.round(F.col("nearest") - F.col("true_score"), 6).alias("margin"),
        F.round(1 / F.col("true_rank"), 6).alias("reciprocal_rank"), F.round(1 - (F.col("true_rank") - 1) / F.greatest(F.lit(1), F.col("n_candidates") - 1), 6).alias("percentile"), F.round(1 / F.col("n_candidates"), 6).alias("chance"),
    ).withColumn("outcome", kind)


def pool_metrics(diagnostics: DataFrame) -> DataFrame:
    """Retrieval metrics of each condition; the fingerprint gap is the share of first places of the query's subject, less top1."""
    share = lambda x: F.avg(x.cast("double"))
    hit, same = F.col("true_rank") == 1, F.col("top_subject") == F.col("q_subject")
    return diagnostics.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.round(share(F.col("true_rank") <= k), 6).alias(f"top{k}") for k in (1, 3, 5)], F.round(F.avg(1 / F.col("true_rank")), 6).alias("mrr"),
        F.round(F.avg("percentile"), 5).alias("percentile"), F.round(F.avg("true_rank"), 6).alias("mean_rank"), F.round(F.expr("percentile(true_rank, 0.5)"), 6).alias("median_rank"),
        F.sum((~hit).cast("long")).alias("failures"), F.round(F.avg("margin"), 5).alias("mean_margin"), F.round(share(same), 6).alias("same_subject_rate"), F.round(share(same) - share(hit), 6).alias("fingerprint_gap"),
    )


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query how the outcome of two variants differs."""
    a, b = (d.select(*QUERY, F.col("true_rank").alias(n)) for d, n in ((before, "rank_before"), (after, "rank_after")))
    was, now = F.col("rank_before") == 1, F.col("rank_after") == 1
    kind = F.when(was & now, "kept_success").when(was, "lost").when(now, "gained").otherwise("kept_failure")
    return a.join(b, list(QUERY)).withColumn("change", kind).withColumn("improvement", F.col("rank_before") - F.col("rank_after"))


def same_subject_negatives(scores: DataFrame) -> DataFrame:
    """Place of the true candidate among those of the query's own subject."""
    own = scores.where("q_subject = c_subject")
    true = F.col("q_task") == F.col("c_task")
    d = own.groupBy(*QUERY).agg(F.max(F.when(true, F.col("score"))).alias("true_score"), F.min(F.when(~true, F.col("score"))).alias("best_wrong"), F.sum((~true).cast("long")).alias("n_negatives"))
    return d.where("n_negatives > 0").withColumn("success", F.col("true_score") <= F.col("best_wrong"))
