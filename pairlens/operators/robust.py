"""Huber regression of one feature, a line a group, fitted by Newton's steps over sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.folds import present
from pairlens.sources.cache import checkpointed

#: Where residuals count as outliers (in scales), and the penalty of the squared slope.
EPSILON, ALPHA, LEAST = 1.35, 1e-4, 6
CALM = 12


def _step(row: pd.Series) -> dict:
    """From sums at (w, b, s), the next slope, intercept and scale.

    While ``calm`` is above 0, reweighted least squares and the best scale in turn, which never raise the loss; then Newton's steps
    of all three at once. A point with a greater loss than the last one is given up for that, and calm steps follow.
    """
    w, b, s, n = row["w"], row["b"], row["s"], row["n"]
    loss = n * s + row["rr"] / s + 2 * EPSILON * row["ar"] - EPSILON**2 * s * row["n_out"] + ALPHA * w * w
    names = {k: row[k] for k in row.index if k.startswith("g_")}
    if loss > row["loss"] * (1 + 1e-12) and row["calm"] <= 0:
        return names | {"w": row["w0"], "b": row["b0"], "s": row["s0"], "w0": row["w0"], "b0": row["b0"], "s0": row["s0"], "loss": row["loss"], "gap": 1.0, "calm": CALM}
    out = EPSILON * s
    if row["calm"] > 0:
        h = np.array([[row["zz"] + out * row["ozz"] + ALPHA * s, row["z"] + out * row["oz"]], [row["z"] + out * row["oz"], row["n_in"] + out * row["o"]]])
        step = np.linalg.solve(h, [row["rz"] + out * row["gz"] - ALPHA * s * w, row["r"] + out * row["g"]])
        left = n - EPSILON**2 * row["n_out"]
        new = np.array([w + step[0], b + step[1], np.sqrt(row["rr"] / left) if left > 0 and row["rr"] > 0 else 2 * s])
    else:
        gradient = np.array([-2 / s * row["rz"] - 2 * EPSILON * row["gz"] + 2 * ALPHA * w, -2 / s * row["r"] - 2 * EPSILON * row["g"], n - row["rr"] / s**2 - EPSILON**2 * row["n_out"]])
        h = np.array([[2 / s * row["zz"] + 2 * ALPHA, 2 / s * row["z"], 2 / s**2 * row["rz"]], [0, 2 / s * row["n_in"], 2 / s**2 * row["r"]], [0, 0, 2 * row["rr"] / s**3]])
        h = np.triu(h) + np.triu(h, 1).T
        new = np.array([w, b, s]) - np.linalg.solve(h + 1e-14 * np.trace(h) * np.eye(3), gradient)
        new[2] = min(max(new[2], s / 4), 4 * s)
    gap = float(np.abs(new - [w, b, s]).max() / max(abs(w), abs(b), s))
    return names | {"w": new[0], "b": new[1], "s": new[2], "w0": w, "b0": b, "s0": s, "loss": loss, "gap": gap, "calm": max(row["calm"] - 1, 0)}


def huber_slopes(rows: DataFrame, by: list[str], x: str, y: str, rounds: int = 200) -> DataFrame:
    """``by``, ``n``, ``slope``, ``intercept``, ``status``: a line a group, robust to outlying ``y``, on ``x`` scaled to mean 0 and deviation 1.

    Minimises slope, intercept and scale together: squared residuals within 1.35 scales, linear ones beyond, and a small penalty of
    the squared slope. Rows that miss x or y take no part. Groups with under 6 rows or a single x or y have null results and status
    ``insufficient_variation``; points that lie on a line give that line. A round is one aggregate over all rows; groups of any
    size meet as sums, and only whether all have settled comes to the driver.
    """
    names = [f"g_{i}" for i in range(len(by))]
    clean = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names)), present(x).alias("x"), present(y).alias("y")).where("x is not null and y is not null")
    moments = [F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("cv"), (F.min("x") < F.max("x")).alias("vx"), (F.min("y") < F.max("y")).alias("vy")]
    stats = checkpointed(clean.groupBy(*names).agg(*moments))
    stats = stats.withColumn("c", F.col("cv") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)))
    fit = F.col("vx") & F.col("vy") & (F.col("n") >= LEAST)
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]  # noqa: E731  null groups too
    data = clean.alias("c").join(stats.where(fit).alias("t"), same("c", "t")).select(*(F.col(f"c.{n}").alias(n) for n in names), ((F.col("x") - F.col("mx")) / F.nullif("sx", F.lit(0.0))).alias("zx"), "y").persist()
    spread = F.col("sy") * F.sqrt(F.greatest(1 - F.col("c") * F.col("c"), F.lit(0.0)))
    start = {"w": F.col("c") * F.col("sy"), "b": F.col("my"), "s": spread}
    state = checkpointed(stats.where(fit).select(*names, *(e.alias(k) for k, e in start.items()), *(e.alias(f"{k}0") for k, e in start.items()), F.lit(float("inf")).alias("loss"), F.lit(1.0).alias("gap"), F.lit(CALM).alias("calm"), (spread <= 1e-9 * F.col("sy")).alias("exact")))
    exact = state.where("exact").select(*names, "w", "b")
    state = state.where("not exact").drop("exact")
    schema, columns = state.schema, state.columns

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([_step(r) for _, r in batch.iterrows()])[columns]

    r, inside = F.col("y") - F.col("b") - F.col("w") * F.col("zx"), F.col("inside")
    inner = {"n_in": F.lit(1.0), "z": F.col("zx"), "zz": F.col("zx") * F.col("zx"), "r": F.col("e"), "rz": F.col("e") * F.col("zx"), "rr": F.col("e") * F.col("e")}
    outer = {"n_out": F.lit(1.0), "g": F.sign("e"), "gz": F.sign("e") * F.col("zx"), "ar": F.abs("e"), "o": 1 / F.abs("e"), "oz": F.col("zx") / F.abs("e"), "ozz": F.col("zx") * F.col("zx") / F.abs("e")}
    for _ in range(rounds):
        met = data.alias("d").join(state.alias("q"), same("d", "q")).select(*(F.col(f"d.{n}").alias(n) for n in names), "zx", "w", "b", "s", "w0", "b0", "s0", "loss", "gap", "calm", r.alias("e")).withColumn("inside", F.abs("e") <= EPSILON * F.col("s"))
        held = [*names, "w", "b", "s", "w0", "b0", "s0", "loss", "gap", "calm"]
        sums = met.groupBy(*held).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(F.when(inside, e).otherwise(0.0)).alias(k) for k, e in inner.items()), *(F.sum(F.when(inside, 0.0).otherwise(e)).alias(k) for k, e in outer.items()))
        state = checkpointed(sums.mapInPandas(steps, schema))
        if not state.where("gap > 1e-12").head(1):
            break
    data.unpersist()
    found = state.select(*names, "w", "b").unionByName(exact)
    out = stats.alias("t").join(found.alias("f"), same("t", "f"), "left")
    status = F.when(F.col("w").isNull(), "insufficient_variation").otherwise("ok").alias("status")
    return out.select(*(F.col(f"t.{n}").alias(c) for c, n in zip(by, names)), "n", F.col("w").alias("slope"), F.col("b").alias("intercept"), status)
