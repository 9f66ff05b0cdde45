"""SimHash near-duplicates by exact tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import add_columns, connected_components, cut, table

SEED = 42


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 3-word shingles, as an unsigned integer; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a very long text unpacks a bounded piece at a time
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def run(texts: list) -> tuple[pa.Array]:
        return (pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return add_columns(rows, "text", run, "fp long").select("doc_id", "fp")


def offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the differences of population counts within the radius: zero, and those whose first entry not zero is positive."""
    found = [()]
    for _ in range(parts):
        found = [(*x, d) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in found if next((d for d in x if d), 1) > 0]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs (a[i], b[i]): every value with the smallest value of its group."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new[label] == label).all():
            break
        label = new[label]
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def tile_links(x: np.ndarray, y: np.ndarray, radius: int, same: bool, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of x and y that differ in ``radius`` bits or fewer, as a spanning forest; a bounded strip at a time."""
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)
    rows = max(1, cells // max(1, len(y)))
    for i in range(0, len(x), rows):
        near = np.bitwise_count(x[i : i + rows, None].view(np.uint64) ^ y[None, :].view(np.uint64)) <= radius
        p, q = np.nonzero(near)
        if same:
            keep = p + i < q
            p, q = p[keep], q[keep]
        if len(p):
            left, right = forest(np.concatenate([left, x[i + p]]), np.concatenate([right, y[q]]))
    return left, right


def links(fps: DataFrame, radius: int = 2, parts: int = 4, tile: int = 4096) -> DataFrame:
    """Spanning forests (``a``, ``b``) of the links between distinct fingerprints ``fp``.

    The fingerprint's bits fall into ``parts`` equal runs; the population counts of the runs name a cell. Two fingerprints within
    the radius lie in cells whose counts differ by the radius in sum at most, so all other pairs of tiles are skipped. A cell with
    many fingerprints is cut by hash into tiles of about ``tile`` rows. Counts by cell are a table of (64 / parts + 1) ** parts
    rows at most (83,521), the only thing that is broadcast.
    """
    width = 64 // parts
    base = width + 1
    runs = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]
    cell = sum((r.cast("int") * base**i for i, r in enumerate(runs)), F.lit(0))
    with_cell = fps.withColumn("cell", cell)
    counts = cut(with_cell.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_tiles")))
    tiles = cut(
        with_cell.join(F.broadcast(counts), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), "n_tiles").cast("int"))
        .groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))
    )
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in offsets(parts, radius)])
    digits = [F.floor(F.col("cell") / base**i).cast("int") % base for i in range(parts)]
    there = [digits[i] + F.col(f"o.d{i}") for i in range(parts)]
    inside = F.lit(True)
    for t in there:
        inside = inside & t.between(0, width)
    other = sum((t * base**i for i, t in enumerate(there)), F.lit(0)).alias("cell_b")
    index = tiles.select("cell", "tile")
    pairs = (
        index.withColumn("o", F.explode(moves)).where(inside).select("cell", "tile", other)
        .join(index.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b")), "cell_b")
        .where("cell <> cell_b or tile <= tile_b")
    )
    both = (
        pairs.join(tiles, ["cell", "tile"])
        .join(tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b")), ["cell_b", "tile_b"])
        .select("fps", "fps_b", F.expr("cell = cell_b and tile = tile_b").alias("same"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [tile_links(np.asarray(x), np.asarray(y), radius, s) for x, y, s in zip(b["fps"], b["fps_b"], b["same"])]
            a, c = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(a):
                a, c = forest(a, c)
            yield pd.DataFrame({"a": a, "b": c})

    return both.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, parts: int = 4, tile: int = 4096) -> DataFrame:
    """Class of near copies of every document.

    ``docs``: ``doc_id``, ``text``; other columns are ignored. Returns ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest doc_id reachable over links of ``radius`` differing bits or fewer), one row per input row.
    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Rows with a null doc_id get
    their fingerprint, join no class and have a null component. Repeated rows come out repeated; an empty table gives no rows.
    Equal fingerprints meet in one aggregate before any comparison, so a huge group of copies is one fingerprint.
    """
    prints = cut(fingerprints(docs))
    reps = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = cut(connected_components(links(reps.select("fp"), radius, parts, tile)))
    named = reps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = cut(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    classes = cut(named.join(firsts, "component").select("fp", "component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.expr("case when doc_id is not null then component_id end").alias("component_id")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class only the document with the smallest doc_id stays; rows without an id stay, and rows
    that share an id are one document."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut(gone), "doc_id", "left_anti").select(*docs.columns)
