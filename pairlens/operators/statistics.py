"""Effects, rank correlation, multiple testing, variance shares, bootstraps and nulls over tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A whole number from 0 to 2 ** 32 - 1 that depends on the parts alone: the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts])), 1, 8), 16, 10).cast("long")


def long_form(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return table.unpivot(list(keys), list(columns), "feature", "value")


def transition_effects(long: DataFrame) -> DataFrame:
    """Per feature: count, mean and median change, mean over sample deviation, share of the commoner sign."""
    up, down = F.avg((F.col("value") > 0).cast("double")), F.avg((F.col("value") < 0).cast("double"))
    sd = F.stddev_samp("value")
    return long.where("value is not null and not isnan(value)").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_delta"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median_delta"),
        F.round(F.when(sd > 1e-12, F.avg("value") / sd), 6).alias("dz"), F.when(up >= down, "positive").otherwise("negative").alias("direction"), F.round(F.greatest(up, down), 6).alias("sign_consistency"),
    )


def average_rank(table: DataFrame, column: str, keys: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 within the keys; ties share their mean rank."""
    w = Window.partitionBy(*keys)
    first = F.rank().over(w.orderBy(column))
    return table.withColumn(name, first + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2.0)


def spearman(table: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of two columns within the keys, ties by mean rank; null if a side does not vary."""
    rows = table.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = average_rank(average_rank(rows, x, keys, "_x"), y, keys, "_y")
    vary = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(vary, F.corr("_x", "_y")), 6).alias("rho"))


def false_discovery(table: DataFrame, p: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg values within the keys: the least of p * n / place from each place on, at most 1."""
    w = Window.partitionBy(*keys)
    placed = table.withColumn("_at", F.row_number().over(w.orderBy(p, *order))).withColumn("_n", F.count(F.lit(1)).over(w))
    later = w.orderBy(F.desc("_at"))
    return placed.withColumn("q_value", F.round(F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_at")).over(later)), 6)).drop("_at", "_n")


def variance_share(long: DataFrame, factor: str) -> DataFrame:
    """Share of each feature's variance that lies between the factor's groups, from sums of one aggregate."""
    g = long.groupBy("feature", F.col(factor).alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    t = g.groupBy("feature").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean_part = F.col("s") * F.col("s") / F.col("n")
    whole = F.col("q") - mean_part
    return t.select("feature", F.lit(factor).alias("factor"), "n_groups", F.round(F.when(whole > 1e-12, (F.col("b") - mean_part) / whole), 6).alias("between_share"))


def subject_bootstrap(values: DataFrame, subject: str, value: str, rounds: int, keys: Sequence[str]) -> DataFrame:
    """Mean of ``value`` in each round of subjects drawn with replacement (by MD5), then its mean and 95 % interval.

    Rows are summed by subject first, so a round costs one row a subject however many rows there are.
    """
    own = values.groupBy(*keys, F.col(subject).alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    placed = own.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_s")) - 1).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    slots = placed.select(*keys, "_at", "_k").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = slots.withColumn("_at", F.pmod(draw("round", "_at"), F.col("_k")).cast("int")).groupBy(*keys, "round", "_at").agg(F.count(F.lit(1)).alias("times"))
    means = drawn.join(placed.select(*keys, "_at", "n", "v"), [*keys, "_at"]).groupBy(*keys, "round").agg((F.sum(F.col("v") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    return means.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rounds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.expr("percentile(m, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("high"))


def sign_flip(long: DataFrame, rounds: int, *ids: str) -> DataFrame:
    """Null of the mean change under random signs (by MD5): observed mean and (1 + rounds at least as far from 0) / (1 + rounds)."""
    seen = long.groupBy("feature").agg(F.avg("value").alias("seen"))
    flipped = long.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).groupBy("feature", "round").agg(F.avg(F.col("value") * F.when(draw("round", "feature", *ids) % 2 == 0, 1.0).otherwise(-1.0)).alias("m"))
    far = F.sum((F.abs("m") >= F.abs("seen") - 1e-9).cast("long"))
    return flipped.join(seen, "feature").groupBy("feature").agg(F.round(F.first("seen"), 6).alias("mean_delta"), F.round((1 + far) / (1.0 + rounds), 6).alias("p_value"))
