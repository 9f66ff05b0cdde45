"""Windows of recordings from their events, and what falls into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FALLBACK = "fixed_window_fallback"


def event_windows(events: DataFrame, recordings: DataFrame, max_windows: int | None = None, max_duration: float | None = None, fixed: float = 10.0, order: tuple[str, ...] = ("onset",)) -> DataFrame:
    """``recording``, ``onset``, ``duration``, ``condition``, ``source``: the windows of every recording.

    ``events``: recording, onset, duration, condition and the columns of ``order``; ``recordings``: recording, duration,
    default_condition (one row each). Missing onsets and durations count as 0. Events of no duration, before 0 or from the
    recording's end on go; so do those whose condition begins with ``bad`` where the recording has others, and, where the default
    condition is not ``unknown`` and some of these contain it (any case), all that don't. The first ``max_windows`` by ``order``
    stay, clipped to ``max_duration``. Recordings without events get tumbling windows of ``fixed`` seconds (1 at least), the last
    ones clipped to the end, under their default condition. Counts of the kinds of events meet as sums, so a recording may be long.
    """
    known = recordings.select("recording", F.col("duration").alias("end"), F.coalesce("default_condition", F.lit("unknown")).alias("default"))
    own = events.select("recording", *{"condition", *order} - {"onset", "duration", "recording"}, F.coalesce("onset", F.lit(0.0)).alias("onset"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
    valid = own.join(known, "recording").where("duration > 0 and onset >= 0 and onset < end").withColumn("condition", F.coalesce("condition", F.lit("nan")))
    good = ~F.lower("condition").startswith("bad")
    hinted = good & (F.lower("default") != "unknown") & (F.col("default") != "") & F.contains(F.lower("condition"), F.lower("default"))
    valid = valid.withColumn("grade", F.when(hinted, 2).when(good, 1).otherwise(0))
    best = valid.groupBy("recording").agg(F.max("grade").alias("best"))
    kept = valid.join(best, "recording").where("grade = best")
    if max_windows is not None:
        kept = kept.withColumn("turn", F.row_number().over(Window.partitionBy("recording").orderBy(*order))).where(F.col("turn") <= max_windows)
    clipped = F.col("duration") if max_duration is None else F.least("duration", F.lit(float(max_duration)))
    from_events = kept.select("recording", "onset", clipped.alias("duration"), "condition", F.lit("events").alias("source"))
    end = F.greatest(F.col("end"), F.lit(0.0)) if max_duration is None else F.least(F.greatest(F.col("end"), F.lit(0.0)), F.lit(float(max_duration)))
    step = max(1.0, float(fixed))
    count = F.greatest(F.lit(1).cast("long"), F.floor(F.col("length") / step))
    if max_windows is not None:
        count = F.least(count, F.lit(max_windows))
    rest = known.join(best, "recording", "left_anti").withColumn("length", end).where("length > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    onset = F.col("i") * F.lit(step)
    tumbling = rest.where(onset < F.col("length")).select("recording", onset.alias("onset"), F.least(F.lit(step), F.col("length") - onset).alias("duration"), F.col("default").alias("condition"), F.lit(FALLBACK).alias("source"))
    return from_events.unionByName(tumbling)


def in_windows(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """``samples`` (recording, at, ..) joined to the windows that hold them: onset <= at < onset + duration.

    Windows are dealt to the buckets of ``width`` seconds that they touch and samples to their own, so that the join is by equal
    recording and bucket; a window meets the samples of its buckets only.
    """
    bucket = lambda t: F.floor(t / F.lit(float(width)))
    dealt = windows.withColumn("_end", F.col("onset") + F.col("duration")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("onset")), bucket(F.col("_end")))))
    met = samples.withColumn("_bucket", bucket(F.col("at"))).join(dealt, ["recording", "_bucket"])
    return met.where("at >= onset and at < _end").drop("_bucket", "_end")
