"""Permutations of what is known of recordings' geometry among queries, with the scores that follow from each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.permutations import draw
from pairlens.sources.cache import checkpointed

# fixed values of the soft evidence score
CENTRE_RANGE, SPAN_RANGE, UNKNOWN = 8.0, 4.0, 0.5
SOURCE_WEIGHT, GEOMETRY_WEIGHT, SPAN_WEIGHT = 0.5, 0.25, 0.5
TRAITS = ("source", "center", "span")
METRICS = ("top1", "mrr", "percentile")


def normalized_distance(a: Column, b: Column, whole: float) -> Column:
    """Gap as a share of ``whole``, 1 at most; where a side is missing or no number, ``UNKNOWN``."""
    known = lambda x: x.isNotNull() & ~F.isnan(x)
    return F.when(known(a) & known(b), F.least(F.abs(a - b) / whole, F.lit(1.0))).otherwise(F.lit(UNKNOWN))


def soft_score(rank_fraction: Column, query: str, candidate: str) -> Column:
    """Place by the base score, and penalties for another source and for distant contacts; missing sources count as equal names."""
    q, c = ({t: F.col(f"{side}.{t}") for t in TRAITS} for side in (query, candidate))
    other = (~q["source"].eqNullSafe(c["source"])).cast("double")
    gap = normalized_distance(q["center"], c["center"], CENTRE_RANGE) + SPAN_WEIGHT * normalized_distance(q["span"], c["span"], SPAN_RANGE)
    return F.round(rank_fraction + SOURCE_WEIGHT * other + GEOMETRY_WEIGHT * gap, 9)


def dealt_traits(traits: DataFrame, rounds: int, strata: list[str]) -> DataFrame:
    """``round``, ``query``, ``given``: whole trait rows dealt to the queries of the same stratum in 1..rounds; in round 0 each has its own."""
    own = traits.select(F.col("id").alias("query"), F.struct(*TRAITS).alias("given"), *strata)
    every = own.join(F.broadcast(traits.sparkSession.range(rounds + 1).select(F.col("id").alias("round"))))  # numbers of rounds only
    within = Window.partitionBy("round", *strata)
    mixed = F.row_number().over(within.orderBy(draw("round", "query"), "query"))
    placed = every.withColumn("at", F.row_number().over(within.orderBy("query"))).withColumn("to", F.when(F.col("round") == 0, F.col("at")).otherwise(mixed))
    placed = checkpointed(placed)
    here = placed.select("round", *(F.coalesce(F.col(s).cast("string"), F.lit("")).alias(s) for s in strata), "at", "query")
    there = placed.select("round", *(F.coalesce(F.col(s).cast("string"), F.lit("")).alias(s) for s in strata), F.col("to").alias("at"), "given")
    return here.join(there, ["round", *strata, "at"]).select("round", "query", "given")


def geometry_permutations(scores: DataFrame, traits: DataFrame, rounds: int, strata: list[str] | None = None) -> DataFrame:
    """``round``, ``n_queries``, ``top1``, ``mrr``, ``percentile`` of the soft score after each round's deal of queries' traits.

    ``scores``: query, candidate, is_true, rank_fraction; ``traits``: id (once each), source, center, span and the ``strata`` columns.
    A query's list depends on the traits it was dealt and not on the round, so each query meets each different row of traits once,
    however many rounds deal it; ties go to the smaller rank_fraction, then the smaller candidate. Queries without traits or without
    a true candidate take no part; candidates without traits are compared as unknown.
    """
    scores = scores.select("query", "candidate", "is_true", "rank_fraction")
    asked = scores.where("is_true").select(F.col("query").alias("id")).distinct()
    dealt = checkpointed(dealt_traits(traits.join(asked, "id", "left_semi"), rounds, strata or []))
    cases = dealt.select("query", "given").distinct()
    against = scores.join(traits.select(F.col("id").alias("candidate"), F.struct(*TRAITS).alias("met")), "candidate", "left")
    score = soft_score(F.col("rank_fraction"), "given", "met")
    met = cases.join(against, "query").select("query", "given", "is_true", F.struct(score.alias("score"), "rank_fraction", "candidate").alias("key"))
    true = met.where("is_true").groupBy("query", "given").agg(F.min("key").alias("true"))
    places = met.join(true, ["query", "given"]).groupBy("query", "given").agg((1 + F.sum((F.col("key") < F.col("true")).cast("long"))).alias("place"), F.count(F.lit(1)).alias("n"))
    percentile = 1 - (F.col("place") - 1) / F.greatest(F.lit(1), F.col("n") - 1)
    joined = dealt.join(places, (dealt["query"] == places["query"]) & dealt["given"].eqNullSafe(places["given"])).select("round", "place", percentile.alias("percentile"))
    return joined.groupBy("round").agg(F.count(F.lit(1)).alias("n_queries"), F.avg((F.col("place") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("place")).alias("mrr"), F.avg("percentile").alias("percentile"))


def null_by_metric(by_round: DataFrame) -> DataFrame:
    """``metric``, ``n_rounds``, ``observed``, ``null_mean``, ``null_sd``, ``p_value``: round 0 against the others, larger being more extreme."""
    long = by_round.select("round", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("e")).select("round", "e.*")
    seen = long.where("round = 0").select("metric", F.col("value").alias("observed"))
    both = long.where("round > 0").join(F.broadcast(seen), "metric")  # three rows
    extreme = F.sum((F.col("value") >= F.col("observed") - 1e-12).cast("long"))
    return both.groupBy("metric", "observed").agg(F.count(F.lit(1)).alias("n_rounds"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), ((1 + extreme) / (1 + F.count(F.lit(1)))).alias("p_value")).select(
        "metric", "n_rounds", "observed", "null_mean", "null_sd", "p_value"
    )
