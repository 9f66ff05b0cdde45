"""Near copies by SimHashes in tiles, verified by the similarity of their shingles; small sets by an exact join of prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import connected_components, cut, give_back
from pairlens.llm.shared_keys import linked, packed, sharing
from pairlens.llm.simhash_tiles import forest
from pairlens.llm.template_decontam import windows

WORDS, SHARE = 5, 0.8
#: Words of a SimHash; bits by which those of sets that link may differ, in all and in the first two words; and sets too small for it.
#: At a Jaccard similarity of 0.8 they differ in 38.8 of 256 bits on average with a standard deviation of 5.7, and in 19.4 of 128 with one
#: of 4.1, so both bounds are six deviations away.
PRINT, RADIUS, FIRST_RADIUS, FEW = 4, 74, 44, 20
#: Fingerprints of a tile, and sets of a part of a group that is verified at once.
TILE, PART = 1 << 15, 1024
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
EPS = 1e-9


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles of ``size`` words, by rising value; one of the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(windows(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), size))


def prefix(hashes: np.ndarray, common: dict[int, int], share: float) -> np.ndarray:
    """What two sets of similarity ``share`` or more must have one of: the first n - ceil(share * n) + 1, rare ones first."""
    n = len(hashes)
    want = n - math.ceil(share * n - EPS) + 1 if n else 0
    if not common:
        return hashes[:want]
    weight = np.fromiter((common.get(h, 0) for h in hashes.tolist()), np.int64, n)
    return hashes[np.argsort(weight, kind="stable")[:want]]


def simhash(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set of hashes, as four words; zeros if it is empty."""
    counts = np.zeros(64 * PRINT, np.int64)
    for i in range(0, len(hashes), 1 << 13):  # a very long text unpacks a bounded piece at a time
        h = hashes[i : i + (1 << 13), None] * _ODD
        h = (h ^ (h >> np.uint64(32))) * _ODD[::-1]
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def close(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, share: float, radius: int, same: bool, cells: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` (SimHashes, a row each, by rising set sizes ``n_x``, ``n_y``) of a spanning forest of the pairs within
    ``radius`` whose sizes allow a similarity of ``share``; a bounded strip at a time."""
    left, right, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    bits = lambda p, q, words: sum(np.bitwise_count(p[..., w] ^ q[..., w]).astype(np.int16) for w in words)
    while at < len(x):
        low = int(np.searchsorted(n_y, share * n_x[at] - EPS))
        low = max(low, at + 1) if same else low
        to = min(len(x), at + max(1, min(256, cells // max(1, len(y) - low))))
        high = int(np.searchsorted(n_y, n_x[to - 1] / share + EPS, "right"))
        p, q = np.nonzero(bits(x[at:to, None], y[None, low:high], (0, 1)) <= min(radius, FIRST_RADIUS))
        p, q = p + at, q + low
        keep = (np.minimum(n_x[p], n_y[q]) >= share * np.maximum(n_x[p], n_y[q]) - EPS) & (bits(x[p], y[q], range(PRINT)) <= radius)
        keep &= (p < q) | (not same)
        if keep.any():
            # places in y follow those in x, so that both are told apart
            left, right = forest(np.concatenate([left, p[keep]]), np.concatenate([right, q[keep] + (0 if same else len(x))]))
        at = to
    return left, right


def close_prints(sets: DataFrame, share: float, radius: int, tile: int = TILE) -> DataFrame:
    """Spanning forests (``a``, ``b``) of the pairs of ``sets`` (``node``, ``n``, ``print``) within ``radius`` bits, by exact comparison in tiles.

    A cell holds the sets of like size, so a set meets its own cell and the next ones only; a cell is cut by hash into tiles of
    about ``tile`` sets. Pairs of tiles whose population counts lie further apart than the radius are skipped too, and so are sizes
    that are too far apart within a pair of tiles.
    """
    cell = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(1 / share))).cast("int")
    ones = sum((F.bit_count(F.col("print")[i]) for i in range(PRINT)), F.lit(0))
    named = sets.withColumn("cell", cell).withColumn("ones", ones)
    counts = named.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_tiles"))
    named = named.join(F.broadcast(cut(counts)), "cell").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), "n_tiles").cast("int"))
    tiles = cut(named.groupBy("cell", "tile").agg(F.collect_list("node").alias("node"), F.collect_list("n").alias("n"), F.flatten(F.collect_list("print")).alias("print"), F.min("ones").alias("fewest"), F.max("ones").alias("most")))
    index = tiles.select("cell", "tile", "fewest", "most")
    other = index.select(*[F.col(c).alias(f"{c}_b") for c in index.columns])
    pairs = index.withColumn("cell_b", F.explode(F.array("cell", F.col("cell") + 1))).join(other, "cell_b").where("cell <> cell_b or tile <= tile_b")
    pairs = pairs.where((F.col("fewest_b") - F.col("most") <= radius) & (F.col("fewest") - F.col("most_b") <= radius)).select("cell", "tile", "cell_b", "tile_b")
    bodies = tiles.select("cell", "tile", "node", "n", "print")
    both = pairs.join(bodies, ["cell", "tile"]).join(bodies.select(*[F.col(c).alias(f"{c}_b") for c in bodies.columns]), ["cell_b", "tile_b"])
    both = both.select("node", "n", "print", "node_b", "n_b", "print_b", F.expr("cell = cell_b and tile = tile_b").alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def risen(node, n, prints):
            node, n, prints = np.asarray(node), np.asarray(n), np.asarray(prints).view(np.uint64).reshape(-1, PRINT)
            order = np.argsort(n, kind="stable")
            return node[order], n[order], prints[order]

        for b in batches:
            for *x, same in zip(*(b[c] for c in b.columns)):
                (u, m, p), (v, n, q) = risen(*x[:3]), risen(*x[3:])
                left, right = close(p, q, m, n, share, radius, same)
                names = u if same else np.concatenate([u, v])
                if len(left):
                    yield pd.DataFrame({"a": names[left], "b": names[right]})
        give_back()

    return both.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, "a long, b long")


def similar_sets(sets: list[np.ndarray], prints: np.ndarray, share: float, radius: int) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join all sets which pairs within ``radius`` and of similarity ``share`` join; those that are joined
    already are not verified."""
    sizes, label, out = np.fromiter(map(len, sets), np.int64, len(sets)), np.arange(len(sets)), []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts, mark = np.split(flat, np.cumsum(sizes)[:-1]), np.zeros(len(names), bool)
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= share * np.maximum(sizes[rest], sizes[i]) - EPS]
        rest = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(rest):
            continue
        mark[parts[i]] = True
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in rest])], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        mark[parts[i]] = False
        for j in rest[both >= share * (sizes[i] + sizes[rest] - both) - EPS].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def near_copies(docs: DataFrame, size: int = WORDS, share: float = SHARE, radius: int = RADIUS, sample: int = 10_000, often: int = 10, part: int = PART) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest doc_id reachable) of every row with a doc_id.

    Two texts link if the Jaccard similarity of their sets of ``size``-word shingles is ``share`` or more; texts without a word link
    to each other. Sets of ``FEW`` shingles or more are found by their SimHashes, compared in tiles, within ``radius`` bits. Sets that
    such pairs connect form a group; its sets are made anew, come together once and are verified there, and groups of over ``part`` sets
    go on as pairs of parts. Sets under ``FEW`` shingles meet by prefixes in an order that is common to all: similar ones share a
    shingle of these. The order puts shingles last that ``often`` or more of about ``sample`` small sets have; it changes no result.
    """
    spark, few = docs.sparkSession, int(FEW / share)

    def made(batches: Iterator[pa.RecordBatch], prints: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sets = [shingles(t, size) for t in b.column(1).to_pylist()]
                names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                kept = [s if len(s) <= few else s[:0] for s in sets] if prints else sets
                ends, flat = np.cumsum([0, *map(len, kept)], dtype=np.int32), np.concatenate([np.empty(0, np.uint64), *kept]).view(np.int64)
                columns = [b.column(0), pa.array(names), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if prints:
                    words = np.concatenate([np.empty(0, np.uint64), *map(simhash, sets)]).view(np.int64)
                    columns += [pa.array(list(map(len, sets)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PRINT), pa.array(words))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "hashes", "n", "print"][: len(columns)])
        give_back()

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(texts.mapInArrow(lambda batches: made(batches, True), "doc_id long, node long, hashes array<long>, n int, print array<long>"))
    firsts = cut(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "print", "hashes")]))

    # sets of FEW shingles or more: groups of close fingerprints, verified together
    groups = cut(connected_components(close_prints(firsts.where(F.col("n") >= FEW).select("node", "n", "print"), share, radius)))
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    wanted = cut(groups.join(sizes, "component").join(firsts.select("node", "rep", "print"), "node").select("node", F.col("rep").alias("doc_id"), "print", "component", "parts"))
    ids = wanted.select("doc_id").distinct()
    some = texts.join(F.broadcast(ids) if wanted.count() <= 1 << 20 else ids, "doc_id").select("doc_id", "text")
    # rows that share the id may have other texts; repeated rows only repeat links
    bodies = some.mapInArrow(lambda batches: made(batches, False), "doc_id long, node long, hashes array<long>").join(wanted, ["node", "doc_id"])
    own = F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int")
    bodies = bodies.withColumn("own", own).withColumn("other", F.explode(F.expr("if(parts = 1, array(0), filter(sequence(0, parts - 1), i -> i <> own))")))
    group = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    bodies = bodies.select("node", "hashes", "print", group.alias("group"), F.pmod(group, F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("bucket"))

    def verify(found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, b in found.groupby("group", sort=False):
            nodes = b["node"].to_numpy()
            prints = np.stack(b["print"].to_list()).view(np.uint64)
            out += [(nodes[i], nodes[j]) for i, j in similar_sets(b["hashes"].to_list(), prints, share, radius)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = cut(bodies.groupBy("bucket").applyInPandas(verify, "a long, b long"))

    # pairs with a smaller set: prefixes
    small = cut(firsts.where(F.col("n") <= few).select("node", "hashes"))
    rate = min(1.0, sample / max(1, small.count()))
    counts = small.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(1 << 20)) < rate * (1 << 20)).select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= often)
    common = spark.sparkContext.broadcast({r[0] & (1 << 64) - 1: r[1] for r in counts.collect()})

    def first_ones(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.array(x, np.int64).view(np.uint64) for x in b.column(1).to_pylist()]
            found = [prefix(x, common.value, share) for x in sets]
            n, lens = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, sets), np.int64, len(sets))
            if n.sum():
                yield packed(np.concatenate(found), np.repeat(b.column(0).to_numpy(), n), [np.repeat(lens, n), np.concatenate([np.arange(k) for k in n])], buckets)

    def fits(x: str, y: str):
        # the first shared shingle comes before all others that are shared
        least = share / (1 + share)
        return F.expr(f"least({x}.n, {y}.n) < {FEW} and least({x}.n, {y}.n) >= {share} * greatest({x}.n, {y}.n) - {EPS} and least({x}.n - {x}.at, {y}.n - {y}.at) >= {least} * ({x}.n + {y}.n) - {EPS}")

    def shared(pairs: DataFrame) -> DataFrame:
        x, y = small.select(F.col("node").alias("a"), F.col("hashes").alias("x")), small.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(x, "a").join(y, "b").where(both >= share * (F.size("x") + F.size("y") - both) - EPS).select("a", "b")

    few_links = linked(sharing(small, first_ones, ["n", "at"]), fits, shared)
    linked_sets = cut(connected_components(links.unionByName(few_links.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    named = firsts.select("node", "rep").join(linked_sets, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    return rows.select("doc_id", "node").join(cut(named.join(least, "component").select("node", "component_id")), "node").select("doc_id", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies only the document with the smallest doc_id stays; rows without an id stay, and
    rows that share an id are one document."""
    gone = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut(gone), "doc_id", "left_anti").select(*docs.columns)
