"""Welch spectra, band powers and coherence of sampled series, by segments of bounded length.

A series is a table with a channel, a sample number (from 0) and a value; samples may be missing. Segments overlap by half, lose
their mean and take a periodic Hann window; missing samples take the mean. Only segments that lie within the series count. Samples
are dealt to segments before anything is sorted or gathered, so a task holds segments and never a channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band edges in Hz, both ends included, and the least power that has a logarithm.
BANDS = {"alpha": (8.0, 12.0), "low_beta": (13.0, 20.0), "high_beta": (20.0, 35.0), "broad_beta": (13.0, 35.0)}
COUPLING_BANDS = {"alpha": (8.0, 12.0), "low_beta": (13.0, 20.0), "high_beta": (20.0, 30.0), "broad_beta": (13.0, 30.0), "gamma": (35.0, 70.0)}
LEAST_POWER = 1e-30
LEAST_SAMPLES, LEAST_PAIRED = 128, 8


def sampled(rows: DataFrame, channel: str, time: str, value: str, step: float) -> DataFrame:
    """``channel``, ``n``, ``value``: means over steps of ``step`` seconds, numbered from the step of the table's first time.

    Rows without a channel, time or finite value take no part.
    """
    whole = rows.where(F.col(channel).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(time).cast("timestamp_ntz"))
    at = F.floor(micros / F.lit(round(step * 1e6))).cast("long")
    placed = whole.select(F.col(channel).alias("channel"), at.alias("at"), F.col(value).cast("double").alias("value"))
    first = F.broadcast(placed.agg(F.min("at").alias("first")))  # one row
    return placed.crossJoin(first).groupBy("channel", (F.col("at") - F.col("first")).alias("n")).agg(F.avg("value").alias("value"))


def lengths(series: DataFrame) -> DataFrame:
    """``channel``, ``size``: samples from number 0 to the last."""
    return series.groupBy("channel").agg((F.max("n") + 1).alias("size"))


def segments(rows: DataFrame, keys: list[str], sample: Column) -> DataFrame:
    """``keys``, ``segment``, ``width`` and the samples of each segment; ``rows`` have ``n``, ``size`` and ``width``."""
    hop = F.col("width") - F.floor(F.col("width") / 2)
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - F.col("width") + 1) / hop))
    high = F.least(F.floor(F.col("n") / hop), F.floor((F.col("size") - F.col("width")) / hop))
    dealt = rows.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("segment", F.explode(F.sequence("low", "high")))
    place = (F.col("n") - F.col("segment") * hop).cast("int").alias("place")
    return dealt.groupBy(*keys, "segment", "width").agg(F.collect_list(F.struct(place, sample)).alias("samples"))


def filled(places: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """A segment without its mean; missing samples are zero, which is the mean."""
    out = np.zeros(width)
    if len(values):
        out[places] = values - values.mean()
    return out


def hann(width: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)


def _sums(of: Callable[[dict[str, np.ndarray], int], np.ndarray], keys: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of ``of(samples, width)`` (``parts`` rows of numbers a segment) over a batch's segments of one key and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple, list] = {}
            offsets, flat = b.column(keys + 2).offsets.to_numpy(), b.column(keys + 2).values
            fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
            names = list(zip(*(b.column(i).to_pylist() for i in range(keys)), b.column(keys + 1).to_pylist()))
            for k, name in enumerate(names):
                got = of({f: v[offsets[k] : offsets[k + 1]] for f, v in fields.items()}, name[-1])
                held = total.setdefault(name, [0, 0.0])
                held[0], held[1] = held[0] + 1, held[1] + got
            cols = list(zip(*((*name, n, *sums.tolist()) for name, (n, sums) in total.items())))
            if cols:
                types = [*(b.schema.field(i).type for i in range(keys)), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*b.schema.names[:keys], "width", "n", *(f"p{i}" for i in range(parts))])

    return run


def _averages(cut: DataFrame, keys: list[str], of: Callable[[dict[str, np.ndarray], int], np.ndarray], parts: int) -> DataFrame:
    """``keys``, ``width``, ``k`` (number of the frequency), ``p0``..: means over segments; batches meet as sums."""
    kinds = dict(cut.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "width long", "n long", *(f"p{i} array<double>" for i in range(parts))])
    sums = cut.mapInArrow(_sums(of, len(keys), parts), schema)
    lines = sums.select(*keys, "width", "n", F.posexplode(F.arrays_zip(*(f"p{i}" for i in range(parts)))).alias("k", "p"))
    return lines.groupBy(*keys, "width", "k").agg(*((F.sum(f"p.p{i}") / F.sum("n")).alias(f"p{i}") for i in range(parts)))


def welch(series: DataFrame, rate: float, width: int | None = None) -> DataFrame:
    """``channel``, ``frequency``, ``power``: power spectral density. ``width``: samples a segment (None: by the series' length).

    Series under 128 samples have no spectrum; a segment has an eighth of a series' samples, 256 to 4,096.
    """
    eighth = F.least(F.lit(4096), F.greatest(F.lit(256), F.floor(F.col("size") / 8)), F.col("size"))
    sized = lengths(series).where(F.col("size") >= LEAST_SAMPLES).withColumn("width", (eighth if width is None else F.least(F.lit(width), F.col("size"))).cast("long"))
    cut = segments(series.join(sized, "channel"), ["channel"], F.col("value"))

    def power(samples: dict[str, np.ndarray], width: int) -> np.ndarray:
        window = hann(width)
        out = np.abs(np.fft.rfft(filled(samples["place"], samples["value"], width) * window)) ** 2 / (rate * (window**2).sum())
        out[1 : len(out) - (width % 2 == 0)] *= 2
        return out[None]

    return _averages(cut, ["channel"], power, 1).select("channel", (F.col("k") * F.lit(rate) / F.col("width")).alias("frequency"), F.col("p0").alias("power"))


def gamma_band(rate: float) -> dict[str, tuple[float, float]]:
    """The gamma band that a sampling rate allows: 60 to 90 Hz, else 35 to 55 Hz or as far as 0.9 of half the rate, else none."""
    half = rate / 2
    return {"gamma": (60.0, 90.0)} if half > 95 else {"gamma": (35.0, min(55.0, half * 0.9))} if half > 45 else {}


def _in_bands(spectra: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, (a, b) in bands.items()))).alias("b")
    return spectra.select("*", named).select(*spectra.columns, "b.*").where("frequency >= low and frequency <= high")


def band_powers(spectra: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """``channel``, ``band``, ``power`` (trapezoids over the band; null with under two frequencies), ``log_power``."""
    order = Window.partitionBy("channel", "band").orderBy("frequency")
    strips = _in_bands(spectra, bands).withColumn("area", (F.col("frequency") - F.lag("frequency").over(order)) * (F.col("power") + F.lag("power").over(order)) / 2)
    return strips.groupBy("channel", "band").agg(F.sum("area").alias("power")).withColumn("log_power", F.log10(F.greatest("power", F.lit(LEAST_POWER))))


def coherence(series: DataFrame, rate: float) -> DataFrame:
    """``left``, ``right``, ``frequency``, ``coherence`` (magnitude squared) of every two channels, ``left`` before ``right``.

    A pair has as many samples as its shorter series (8 at least), a segment two seconds of them (32 samples at least). Where one
    of the spectra is zero, coherence is null.
    """
    size = lengths(series)
    two = size.select(F.col("channel").alias("left"), F.col("size").alias("a")).join(size.select(F.col("channel").alias("right"), F.col("size").alias("b")), F.col("left") < F.col("right"))
    two = two.withColumn("size", F.least("a", "b")).where(F.col("size") >= LEAST_PAIRED).withColumn("width", F.least("size", F.lit(int(max(rate * 2, 32)))).cast("long"))
    sides = two.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("channel")), F.struct(F.lit(1).alias("side"), F.col("right").alias("channel")))).alias("e")).select("left", "right", "size", "width", "e.*")
    cut = segments(series.join(F.broadcast(sides), "channel"), ["left", "right"], F.struct("side", "value").alias("s"))
    cut = cut.withColumn("samples", F.expr("transform(samples, x -> struct(x.place as place, x.s.side as side, x.s.value as value))"))

    def cross(samples: dict[str, np.ndarray], width: int) -> np.ndarray:
        mine = [samples["side"] == k for k in (0, 1)]
        x, y = (np.fft.rfft(filled(samples["place"][m], samples["value"][m], width) * hann(width)) for m in mine)
        z = np.conj(x) * y
        return np.stack([np.abs(x) ** 2, np.abs(y) ** 2, z.real, z.imag])

    got = _averages(cut, ["left", "right"], cross, 4)
    value = (F.col("p2") * F.col("p2") + F.col("p3") * F.col("p3")) / F.nullif(F.col("p0") * F.col("p1"), F.lit(0.0))
    return got.select("left", "right", (F.col("k") * F.lit(rate) / F.col("width")).alias("frequency"), value.alias("coherence"))


def band_coherence(spectra: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """``left``, ``right``, ``band``, ``coherence``: the mean over the band's frequencies."""
    return _in_bands(spectra, bands).groupBy("left", "right", "band").agg(F.avg("coherence").alias("coherence"))
