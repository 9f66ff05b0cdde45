"""Candidate targets ranked within contexts, without each subject, and how reliably a feature ranks among them.

States are rows (subject, task, medication 'off' or 'on', quality, feature, value), a row a state and feature. Rankings come from
counts, sums and squares by context, so a state is read once however many contexts it belongs to. Rows without a finite value take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the objective, the reference and the reliability scores
MOVED, FLOOR, LEAST_SCALE = 0.6, 0.05, 0.1
ENERGY, RISK, COMPLEXITY, STABILITY = 0.15, 0.25, 0.1, 0.2
SENSITIVE = ("STN", "GPi", "GPe", "Thalamus")
EDGE = "edge_coupling_modulation"
TASKS = ("HoldL", "MoveL")
TOP = 10
BASE_TERMS = {"top10_frequency": 0.25, "rank_score": 0.15, "subject_coverage": 0.15, "task_coverage": 0.10, "quality_survival": 0.15, "uncertainty_score": 0.10, "stability": 0.10}
SIDE_TERMS = {"top10_frequency": 0.20, "rank_score": 0.15, "subject_coverage": 0.10, "side_coverage": 0.10, "family_coverage": 0.10, "quality_survival": 0.15, "uncertainty_score": 0.10, "stability": 0.10}
CONTEXT = ("rank_source", "rank_context", "task_context", "subject_context", "side_context", "family_context")
BASE_SOURCES, SIDE_SOURCES = ("overall", "task", "subject_task", "quality"), ("sideaware", "quality")


def _context(when: Column, source: str, name: Column | str, task: Column | str = "", subject: Column | str = "", side: Column | str = "", family: Column | str = "") -> Column:
    text = [F.lit(x) if isinstance(x, str) else x for x in (source, name, task, subject, side, family)]
    text[1] = F.concat(F.lit(f"{source}:"), text[1])
    return F.when(when, F.struct(*(t.cast("string").alias(n) for t, n in zip(text, CONTEXT))))


def contexts_of() -> Column:
    """Every context of a state: all, its task (of TASKS), its subject's task, the quality filters, and its side-aware strata. A task
    is a family, 'Hold' or 'Move', and a side, 'L' or 'R'; others belong to no stratum. Null tasks and subjects are of the name ''."""
    task, subject, always = F.coalesce(F.col("task"), F.lit("")), F.coalesce(F.col("subject").cast("string"), F.lit("")), F.lit(True)
    side, family = F.right(task, F.lit(1)), F.left(task, F.lit(4))
    strata = task.isin("HoldL", "HoldR", "MoveL", "MoveR")
    return F.array_compact(F.array(
        _context(always, "overall", "all_recordings"), _context(task.isin(*TASKS), "task", task, task), _context(always, "subject_task", F.concat(task, F.lit(":"), subject), task, subject),
        _context(~F.col("quality").eqNullSafe("low_quality"), "quality", "exclude_low_quality"), _context(F.col("quality") == "good", "quality", "good_only"),
        _context(strata, "sideaware", task, family, "", side, family), _context(strata & (side == "L"), "sideaware", "left_side", "", "", "L"), _context(strata & (side == "R"), "sideaware", "right_side", "", "", "R"),
        _context(strata & (family == "Hold"), "sideaware", "hold_family", "Hold", "", "", "Hold"), _context(strata & (family == "Move"), "sideaware", "move_family", "Move", "", "", "Move"),
    ))


def _sums(states: DataFrame, *by: str) -> DataFrame:
    """n, s, q (count, sum, squares) of off and on states, by ``by`` and feature; numbers only."""
    x, out = F.col("value").cast("double"), []
    for m in ("off", "on"):
        own = F.col("medication") == m
        out += [F.sum(own.cast("long")).alias(f"n_{m}"), F.sum(F.when(own, x).otherwise(0.0)).alias(f"s_{m}"), F.sum(F.when(own, x * x).otherwise(0.0)).alias(f"q_{m}")]
    known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return states.where(known & F.col("medication").isin("off", "on")).groupBy(*by, "feature").agg(*out)


def _ranked(sums: DataFrame, by: list[str], descriptors: DataFrame, sensitive: tuple[str, ...]) -> DataFrame:
    """Features of each context by objective: the off mean moved ``MOVED`` of the way to the on mean.

    Without any off state all states are current, without any on state all are the reference, and with a single on state the scale
    is that of all states. Features without a current or reference value are left out. ``descriptors``: feature (once each), node,
    target_type; missing ones cost as plain nodes. Ties: larger gain, then feature.
    """
    w = Window.partitionBy(*by)
    any_off, most_on = F.max("n_off").over(w) > 0, F.max("n_on").over(w)
    both = {k: F.col(f"{k}_off") + F.col(f"{k}_on") for k in "nsq"}
    pick = lambda k, side, use: F.when(use, F.col(f"{k}_{side}")).otherwise(both[k])
    mean = lambda side, use: pick("s", side, use) / F.nullif(pick("n", side, use), F.lit(0))
    use = most_on > 1
    n, s, q = (pick(k, "on", use) for k in "nsq")
    spread = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    found = sums.select(*by, "feature", mean("off", any_off).alias("current"), mean("on", most_on > 0).alias("target"), F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(LEAST_SCALE)).alias("scale")).dropna(subset=["current", "target"])
    z = (F.col("target") - F.col("current")) / F.col("scale")
    found = found.withColumn("zz", z * z).withColumn("total", F.sum("zz").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    found = found.join(descriptors.select("feature", "node", "target_type"), "feature", "left")
    edge = F.col("target_type").eqNullSafe(EDGE)
    found = found.withColumn("effect_size", MOVED * (F.col("target") - F.col("current"))).withColumn("risk", 0.25 + F.when(F.col("node").isin(*sensitive), 0.35).otherwise(0.0) + F.when(edge, 0.1).otherwise(0.0))
    post = F.sqrt(F.greatest((F.col("total") - F.col("zz") * (1 - (1 - MOVED) ** 2)) / F.col("n"), F.lit(0.0)))
    size = F.abs("effect_size")
    found = found.withColumn("stability_estimate", 1 / (1 + size)).withColumn("uncertainty", FLOOR + 0.05 * size + 0.1 * F.col("risk")).withColumn("gain", F.round(F.sqrt(F.col("total") / F.col("n")) - post, 9))
    objective = post + ENERGY * size * size + RISK * F.col("risk") + COMPLEXITY * F.when(edge, 0.45).otherwise(0.25) - STABILITY * F.col("stability_estimate")
    found = found.withColumn("objective", F.round(objective, 9))
    place = F.row_number().over(w.orderBy("objective", F.desc("gain"), "feature"))
    return found.select(*by, "feature", place.alias("rank"), "objective", F.col("gain").alias("expected_delta_deviation"), "effect_size", "uncertainty", "stability_estimate")


def rank_targets(states: DataFrame, descriptors: DataFrame, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """A row a context and feature: the rankings of all contexts of ``contexts_of``."""
    each = states.withColumn("c", F.explode(contexts_of())).select("c.*", "medication", "feature", "value")
    return _ranked(_sums(each, *CONTEXT), list(CONTEXT), descriptors, sensitive)


def rank_without_subjects(states: DataFrame, descriptors: DataFrame, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """``removed_subject`` (null: nobody) and the ranking of all other subjects' states, from sums less the subject's own."""
    own = _sums(states.where("subject is not null"), "subject")
    names = own.select(F.col("subject").alias("removed_subject")).distinct()
    total = _sums(states.where("subject is not null"))
    # every subject leaves every feature: subjects times features by definition
    every = names.join(F.broadcast(total))  # a row a feature
    less = every.join(own.withColumnRenamed("subject", "removed_subject").select("removed_subject", "feature", *(F.col(f"{k}_{m}").alias(f"o{k}_{m}") for k in "nsq" for m in ("off", "on"))), ["removed_subject", "feature"], "left")
    less = less.select("removed_subject", "feature", *((F.col(f"{k}_{m}") - F.coalesce(f"o{k}_{m}", F.lit(0))).alias(f"{k}_{m}") for m in ("off", "on") for k in "nsq"))
    whole = total.select(F.lit(None).cast(states.schema["subject"].dataType).alias("removed_subject"), *total.columns)
    return _ranked(whole.unionByName(less).where("n_off + n_on > 0"), ["removed_subject"], descriptors, sensitive)


def left_out_stability(ranks: DataFrame) -> DataFrame:
    """How the first ``TOP`` of each ``rank_without_subjects`` differ from those of everybody."""
    full = ranks.where("removed_subject is null").select("feature", F.col("rank").alias("full_rank"))
    both = ranks.where("removed_subject is not null").join(full, "feature", "left")
    high, first = F.col("rank") <= TOP, F.max(F.when(F.col("full_rank") == 1, F.col("rank")))
    overlap = F.sum((high & (F.col("full_rank") <= TOP)).cast("long"))
    return both.groupBy("removed_subject").agg(F.min_by("feature", "rank").alias("top1_feature"), F.coalesce(overlap, F.lit(0)).alias("top10_overlap"), (F.coalesce(overlap, F.lit(0)) / TOP).alias("top10_overlap_fraction"), (first - 1).alias("full_top1_shift"), F.coalesce(first <= TOP, F.lit(False)).alias("full_top1_stays"))


def _features(observations: DataFrame, seen: DataFrame, known: DataFrame | None) -> DataFrame:
    """Counts and means of every feature over all contexts of ``seen``: where it has no rank, it has the one after the last of ``observations``.

    A missing rank is counted, not written out: contexts times features are never built. It is in nobody's first ``TOP``.
    """
    names = seen.select("feature") if known is None else seen.select("feature").unionByName(known.select("feature"))
    names = names.unionByName(observations.select("feature")).distinct()
    size = F.broadcast(names.agg(F.count(F.lit(1)).alias("n_features")))  # these three: one row each
    last = F.broadcast(observations.agg(F.max("rank").alias("last")))
    contexts = F.broadcast(seen.agg(F.countDistinct("rank_context").alias("n_contexts"), F.max("rank").alias("seen_last")))
    hit = F.col("rank") <= TOP
    has = lambda x: F.coalesce(F.max(F.when(hit, x)), F.lit(False))
    quality = F.col("rank_source") == "quality"
    own = seen.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("rank").alias("s"), F.sum(F.col("rank") * F.col("rank")).alias("q"), F.sum((F.col("rank") <= 5).cast("long")).alias("h5"), F.sum(hit.cast("long")).alias("h10"),
        F.countDistinct(F.when(hit & (F.col("rank_source") == "subject_task") & (F.col("subject_context") != ""), F.col("subject_context"))).alias("n_subjects"),
        F.countDistinct(F.when(hit & F.col("task_context").isin(*TASKS), F.col("task_context"))).alias("n_tasks"),
        has(quality & F.col("rank_context").contains("exclude_")).alias("survives"), has(quality & F.col("rank_context").contains("good_only")).alias("in_good"),
        *(has(F.col(c) == v).alias(n) for n, c, v in (("in_left", "side_context", "L"), ("in_right", "side_context", "R"), ("in_hold", "family_context", "Hold"), ("in_move", "family_context", "Move"))),
        F.avg("expected_delta_deviation").alias("mean_expected_delta"), F.avg("uncertainty").alias("mean_uncertainty"), F.avg("stability_estimate").alias("mean_stability"),
    )
    found = names.join(own, "feature", "left").join(size).join(last).join(contexts).where("n_contexts > 0")
    found = found.fillna(0, ["k", "s", "q", "h5", "h10", "n_subjects", "n_tasks"]).fillna(False, ["survives", "in_good", "in_left", "in_right", "in_hold", "in_move"])
    absent = F.greatest("last", "n_features") + 1
    found = found.withColumn("absent", absent).withColumn("gone", F.col("n_contexts") - F.col("k"))
    weights = seen.select("feature", "rank", F.lit(1).cast("long").alias("times")).unionByName(found.where("gone > 0").select("feature", F.col("absent").cast("int").alias("rank"), F.col("gone").alias("times")))
    middle = weights.groupBy("feature").agg(F.expr("percentile(rank, 0.5D, times)").alias("median_rank"))
    n, s = F.col("n_contexts"), F.col("s") + F.col("gone") * F.col("absent")
    spread = F.sqrt(F.greatest((F.col("q") + F.col("gone") * F.col("absent") * F.col("absent")) / n - (s / n) * (s / n), F.lit(0.0)))
    any_gone = F.max(F.when(F.col("gone") > 0, F.col("absent"))).over(Window.partitionBy())  # a row a feature
    found = found.withColumn("most", F.greatest("seen_last", "n_features", any_gone)).join(middle, "feature")
    low, high = (f(F.col("mean_uncertainty")).over(Window.partitionBy()) for f in (F.min, F.max))
    scaled = F.when(high - low <= 1e-8 + 1e-5 * F.abs(low), F.lit(0.5)).otherwise(1 - (F.col("mean_uncertainty") - low) / (high - low))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return found.select(
        "feature", "n_contexts", (F.col("h5") / n).alias("top5_frequency"), (F.col("h10") / n).alias("top10_frequency"), (s / n).alias("mean_rank"), "median_rank", spread.alias("rank_sd"), "n_subjects", "n_tasks", "survives", "in_good",
        "mean_expected_delta", "mean_uncertainty", clip(F.coalesce("mean_stability", F.lit(0.5))).alias("stability"), clip(1 - (s / n - 1) / F.greatest(F.lit(1), F.col("most") - 1)).alias("rank_score"), F.coalesce(scaled, F.lit(0.5)).alias("uncertainty_score"),
        ((F.col("survives").cast("double") + F.col("in_good").cast("double")) / 2).alias("quality_survival"), ((F.col("in_left").cast("double") + F.col("in_right").cast("double")) / 2).alias("side_coverage"),
        ((F.col("in_hold").cast("double") + F.col("in_move").cast("double")) / 2).alias("family_coverage"),
    )


def _score(found: DataFrame, terms: dict[str, float], name: str) -> DataFrame:
    return found.withColumn(name, F.least(F.greatest(sum((w * F.col(c) for c, w in terms.items()), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def reliability(ranks: DataFrame, n_subjects: int, n_tasks: int = len(TASKS), known: DataFrame | None = None, task: str | None = None) -> DataFrame:
    """Seven-term score of each feature over the contexts of BASE_SOURCES. ``task``: those of this task and the quality filters only."""
    rows = ranks.where(F.col("rank_source").isin(*BASE_SOURCES))
    seen = rows if task is None else rows.where((F.col("task_context") == task) | (F.col("rank_source") == "quality"))
    found = _features(rows, seen, known).drop("side_coverage", "family_coverage")
    share = lambda c, n: F.lit(0.0) if n <= 0 else F.col(c) / n
    return _score(found.withColumn("subject_coverage", share("n_subjects", n_subjects)).withColumn("task_coverage", share("n_tasks", n_tasks)), BASE_TERMS, "reliability_score")


def sideaware_reliability(ranks: DataFrame, base: DataFrame, known: DataFrame | None = None, side: str | None = None, family: str | None = None) -> DataFrame:
    """Eight-term score over the side-aware strata and quality filters; subjects are covered as in ``base`` (``reliability``), or not at all."""
    seen = ranks.where(F.col("rank_source").isin(*SIDE_SOURCES))
    for column, value in (("side_context", side), ("family_context", family)):
        seen = seen if value is None else seen.where((F.col(column) == value) | (F.col("rank_source") == "quality"))
    found = _features(seen, seen, known).drop("n_subjects", "n_tasks").join(base.select("feature", "n_subjects", "n_tasks", "subject_coverage"), "feature", "left")
    return _score(found.fillna(0, ["n_subjects", "n_tasks", "subject_coverage"]), SIDE_TERMS, "sideaware_reliability_score")


def reliability_weights(base: DataFrame, sideaware: DataFrame) -> DataFrame:
    """Mean of both scores where a feature has them, over the largest mean, within 0.05 and 1."""
    scores = base.select("feature", F.col("reliability_score").alias("score")).unionByName(sideaware.select("feature", F.col("sideaware_reliability_score").alias("score")))
    mean = scores.groupBy("feature").agg(F.avg("score").alias("score"))
    most = F.max("score").over(Window.partitionBy())  # a row a feature
    return mean.select("feature", F.least(F.greatest(F.when(most > 0, F.col("score") / most).otherwise(F.lit(1.0)), F.lit(0.05)), F.lit(1.0)).alias("weight"))
