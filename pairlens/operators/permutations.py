"""Permutations of whole subjects with refitting in every round, dealt by round and subject."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.folds import grams, per_fold, present
from pairlens.sources.cache import checkpointed


def draw(*parts: str) -> Column:
    """A number that only depends on the parts' text: the first 8 hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def shuffled_subjects(rows: DataFrame, subject: str, rounds: int) -> DataFrame:
    """``round``, ``subject``, ``donor``: a permutation of the subjects in each of 1..rounds, and the identity in round 0."""
    every = rows.where(F.col(subject).isNotNull()).select(F.col(subject).alias("subject")).distinct()
    dealt = every.join(F.broadcast(every.sparkSession.range(rounds + 1).select(F.col("id").alias("round"))))  # numbers of rounds only
    mine = Window.partitionBy("round")
    placed = dealt.withColumn("at", F.row_number().over(mine.orderBy("subject"))).withColumn("to", F.when(F.col("round") == 0, F.col("at")).otherwise(F.row_number().over(mine.orderBy(draw("round", "subject"), "subject"))))
    placed = checkpointed(placed)
    return placed.select("round", "subject", "at").join(placed.select("round", F.col("subject").alias("donor"), F.col("to").alias("at")), ["round", "at"]).drop("at")


def permuted_ridge(rows: DataFrame, subject: str, slot: str, target: str, features: list[str], rounds: int, alpha: float = 1.0, least: int = 8) -> DataFrame:
    """``round``, ``n``, ``spearman``: how ridge regressions that leave a subject out predict the targets that each round deals out.

    In a round each subject takes another one's targets, slot by slot (none where that one has no such slot); every fold is fitted
    anew to the round's other subjects. Rows without a subject, target or feature take no part. A round is as many rows as the
    table; Gram matrices meet as sums by round and subject, so neither a round nor the rounds have to fit a task.
    """
    p = len(features)
    whole = rows.select(F.col(subject).alias("subject"), F.col(slot).alias("slot"), present(target).alias("y"), *(present(f).alias(f"x{i}") for i, f in enumerate(features)))
    whole = checkpointed(whole.dropna(subset=["subject", *(f"x{i}" for i in range(p))]))
    given = whole.select(F.col("subject").alias("donor"), "slot", "y").where("y is not null")
    dealt = shuffled_subjects(whole, "subject", rounds).join(whole.drop("y"), "subject").join(given, ["donor", "slot"]).withColumn("fold", F.concat_ws("|", "round", "subject"))
    dealt = checkpointed(dealt.select("round", "fold", "y", *(f"x{i}" for i in range(p))))
    own = checkpointed(grams(dealt, "fold", [*(f"x{i}" for i in range(p)), "y"]).withColumn("round", F.substring_index("fold", "|", 1).cast("long")))
    total = own.select("round", F.posexplode("gram").alias("i", "g")).groupBy("round", "i").agg(F.sum("g").alias("g"))
    total = total.groupBy("round").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda e: e.g).alias("total"))
    folds = own.join(total, "round").select("fold", F.zip_with("total", "gram", lambda t, g: t - g).alias("rest"))

    def fit(row: pd.Series) -> dict:
        g = np.asarray(row["rest"], np.float64).reshape(p + 2, p + 2)
        n = round(g[0, 0])
        spread = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(n, 1)
        if n < least or spread[p, p] <= 1e-12 * g[-1, -1]:
            return {"fold": row["fold"], "weights": None, "base": None}
        scale = np.sqrt(np.maximum(np.diag(spread)[:p], 0) / n)
        scale = np.where(scale > 1e-9 * np.sqrt(np.maximum(np.diag(g)[1 : p + 1] / n, 1e-300)), scale, 1.0)
        beta = np.linalg.solve(spread[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p), spread[:p, p] / scale) / scale
        return {"fold": row["fold"], "weights": beta, "base": (g[0, -1] - beta @ g[0, 1 : p + 1]) / n}

    models = per_fold(folds, fit, "fold string, weights array<double>, base double").where("weights is not null")
    predicted = dealt.join(models, "fold").select("round", "y", sum((F.col("weights")[i] * F.col(f"x{i}") for i in range(p)), F.col("base")).alias("pred"))
    rank = lambda c: F.rank().over(Window.partitionBy("round").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("round", c)) - 1) / 2
    ranked = predicted.select("round", rank("y").alias("ry"), rank("pred").alias("rp"))
    moments = ranked.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ry", "rp").alias("c"), F.stddev_pop("ry").alias("sy"), F.stddev_pop("rp").alias("sp"))
    return moments.select("round", "n", (F.col("c") / F.nullif(F.col("sy") * F.col("sp"), F.lit(0.0))).alias("spearman"))


def null_summary(by_round: DataFrame) -> DataFrame:
    """``n_rounds``, ``observed``, ``null_mean``, ``p_value`` of round 0 against the others, larger values being more extreme."""
    null, seen = by_round.where("round > 0"), F.broadcast(by_round.where("round = 0").select(F.col("spearman").alias("observed")))  # one row
    extreme = F.sum((F.col("spearman") >= F.col("observed") - 1e-12).cast("long"))
    return null.crossJoin(seen).groupBy("observed").agg(F.count("spearman").alias("n_rounds"), F.avg("spearman").alias("null_mean"), ((1 + extreme) / (1 + F.count("spearman"))).alias("p_value")).select("n_rounds", "observed", "null_mean", "p_value")
