"""Rerankers that weigh both directions of a search, shared neighbours, quality flags and confounds, all variants in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.pools import CANDIDATE, QUERY, TOP_K

# fixed values of the rerankers
REVERSE_WEIGHT, MUTUAL_BONUS, OVERLAP_BONUS = 1.0, 1.0, 1.0
QUALITY_PENALTY, TASK_PENALTY, SUBJECT_PENALTY = 2.0, 2.0, 2.0
BROAD_POOL, LEAST_SPREAD = 20, 1e-8


class Variant(NamedTuple):
    """Which terms count. ``broad_only``: lists under BROAD_POOL candidates keep their scores. ``blind``: the penalty for the query's
    own subject spares no candidate, so the score never asks which candidate is the right one."""

    name: str
    neighbours: bool
    quality: bool
    confounds: bool
    broad_only: bool
    blind: bool = False


VARIANTS = (
    Variant("neighbours", True, False, False, False),
    Variant("neighbours_quality", True, True, False, False),
    Variant("neighbours_quality_confounds", True, True, True, True),
    Variant("quality_confounds", False, True, True, True),
    Variant("quality_confounds_blind", False, True, True, True, True),
)
LIST = ["variant", *QUERY]


def _standardised(value: str, w) -> Column:
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd >= LEAST_SPREAD, sd).otherwise(F.lit(1.0))


def _nearest(scores: DataFrame, by: list[Column], ids: Column, name: str) -> DataFrame:
    """The TOP_K candidates of each list."""
    return scores.where(F.col("rank") <= TOP_K).groupBy(*by).agg(F.collect_set(ids).alias(name))


def terms(scores: DataFrame, reverse: DataFrame, flags: DataFrame) -> DataFrame:
    """Every candidate with the terms of all variants.

    ``scores``, ``reverse``: lists of both directions as ``pools.pool_scores`` gives them; of ``reverse`` only the condition 'all'
    counts, whatever the forward condition. ``flags``: subject, task (once each), quality. A reverse score that is missing takes
    the list's largest, and where a list has none its largest forward score; a missing flag is one of its own. Lists hold TOP_K
    names at most, so the sets that are joined don't grow.
    """
    back = reverse.where("condition = 'all'")
    back_ids = [F.col("q_subject").alias("c_subject"), F.col("q_task").alias("c_task")]
    found = back.select(*back_ids, F.col("c_subject").alias("q_subject"), F.col("c_task").alias("q_task"), F.col("score").alias("back"), F.col("rank").alias("back_rank"))
    name = F.struct("c_subject", "c_task")
    front, behind = _nearest(scores, [F.col(c) for c in QUERY], name, "front"), _nearest(back, back_ids, name, "behind")
    flag = lambda side: flags.select(F.col("subject").alias(f"{side}_subject"), F.col("task").alias(f"{side}_task"), F.col("quality").alias(f"{side}_quality"))
    both = scores.join(found, [*QUERY[1:], *CANDIDATE], "left").join(front, list(QUERY), "left").join(behind, list(CANDIDATE), "left").join(flag("q"), ["q_subject", "q_task"], "left").join(flag("c"), list(CANDIDATE), "left")
    w = Window.partitionBy(*QUERY)
    both = both.withColumn("filled", F.coalesce("back", F.max("back").over(w), F.max("score").over(w)))
    union, task = F.size(F.array_union("front", "behind")), F.col("q_task") != F.col("c_task")
    same = F.col("q_subject") == F.col("c_subject")
    return both.select(
        *QUERY, *CANDIDATE, "score", "rank", "n_candidates", F.coalesce("back_rank", F.lit(-1)).alias("back_rank"),
        (_standardised("score", w) + REVERSE_WEIGHT * _standardised("filled", w)).alias("both_ways"),
        F.coalesce((F.col("rank") <= TOP_K) & (F.col("back_rank") <= TOP_K), F.lit(False)).alias("mutual"),
        F.coalesce(F.round(F.size(F.array_intersect("front", "behind")) / union, 6), F.lit(0.0)).alias("overlap"),
        (~F.col("q_quality").eqNullSafe(F.col("c_quality"))).alias("other_quality"), task.alias("other_task"), same.alias("same_subject"), (same & ~task).alias("is_true"),
    )


def reranked(found: DataFrame, variants: tuple[Variant, ...] = VARIANTS) -> DataFrame:
    """``terms`` once for each variant with ``applied``, ``new_score`` and ``new_rank``; ties go to the better place before, then by name."""

    def one(v: Variant) -> Column:
        own = F.col("same_subject") if v.blind else F.col("same_subject") & ~F.col("is_true")
        new = F.col("both_ways")
        if v.neighbours:
            new = new - (MUTUAL_BONUS * F.col("mutual").cast("double") + OVERLAP_BONUS * F.col("overlap"))
        if v.quality:
            new = new + QUALITY_PENALTY * F.col("other_quality").cast("double")
        if v.confounds:
            new = new + TASK_PENALTY * F.col("other_task").cast("double") + SUBJECT_PENALTY * own.cast("double")
        applied = F.col("n_candidates") >= BROAD_POOL if v.broad_only else F.lit(True)
        return F.struct(F.lit(v.name).alias("variant"), applied.alias("applied"), F.round(F.when(applied, new).otherwise(F.col("score")), 6).alias("new_score"))

    each = found.withColumn("v", F.explode(F.array(*map(one, variants)))).select("v.*", *found.columns)
    return each.withColumn("new_rank", F.row_number().over(Window.partitionBy(*LIST).orderBy("new_score", "rank", *CANDIDATE)))


def components(rows: DataFrame) -> DataFrame:
    """Per list of a variant: what its true candidate had, and how many candidates each term touched. Lists without one have no row."""
    true = lambda c: F.max(F.when(F.col("is_true"), F.col(c)))
    count = lambda x: F.sum(x.cast("long"))
    return rows.groupBy(*LIST).agg(
        F.max("n_candidates").alias("n_candidates"), F.max("applied").alias("applied"), true("rank").alias("forward_rank"), true("back_rank").alias("reverse_rank"), true("new_rank").alias("new_rank"),
        true("mutual").alias("true_mutual"), true("overlap").alias("true_overlap"), true("other_quality").alias("true_other_quality"), count(F.col("mutual")).alias("n_mutual"), F.avg("overlap").alias("mean_overlap"),
        count(F.col("other_quality")).alias("n_other_quality"), count(F.col("other_task")).alias("n_other_task"), count(F.col("same_subject") & ~F.col("is_true")).alias("n_same_subject_wrong"),
    ).where("forward_rank is not null")


def first_places(rows: DataFrame) -> DataFrame:
    """Per condition and variant: top1, mean reciprocal rank, and what stands first: the own subject, a wrong task, another quality."""
    share = lambda x: F.avg(x.cast("double"))
    top = rows.where("new_rank = 1").groupBy("condition", "variant").agg(
        share(F.col("same_subject")).alias("top_same_subject"), share(F.col("same_subject") & ~F.col("is_true")).alias("top_same_subject_wrong"),
        share(F.col("other_task")).alias("top_other_task"), share(F.col("other_quality")).alias("top_other_quality"),
    )
    true = rows.where("is_true").groupBy("condition", "variant").agg(F.count(F.lit(1)).alias("n_queries"), share(F.col("new_rank") == 1).alias("top1"), F.avg(1 / F.col("new_rank")).alias("mrr"))
    return top.join(true, ["condition", "variant"], "left")
