"""Phrase collocations by hierarchical pair naming: a phrase's id stands for the pair of its two shorter phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import Scratch, cut, give_back, table

LEAST, LONGEST, TOP = 30, 4, 2000
BATCH_BYTES = 1 << 23
#: A-Z to a-z, tabs to spaces, everything that ends a piece to a line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def stretches(raw: bytes, most: int) -> Iterator[bytes]:
    """A text in stretches of about ``most`` bytes, cut where a piece ends."""
    at = 0
    while len(raw) - at > most:
        end = raw.find(b"\n", at + most)
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def coded(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Codes of words in order (-1 between pieces), and the distinct words."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[b"\n"], numbers[b""] = 0, 1
    tokens = raw.replace(b"\n", b" \n ").split(b" ")
    codes = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    codes = codes[codes != 1] - 2
    codes[codes < 0] = -1
    return codes, list(numbers)[2:]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows as batches of one language: ``batch``, ``lang``, ``codes``, ``words`` (the distinct ones, by code)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def out(lang: str) -> pa.RecordBatch:
        nonlocal number
        number += 1
        codes, words = coded(b"\n".join(held.pop(lang)))
        size.pop(lang)
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), words], names=["batch", "lang", "codes", "words"])

    for b in rows:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for part in stretches((text.as_py() or "").encode().translate(_PLAIN), BATCH_BYTES):
                if size.get(lang, 0) + len(part) > BATCH_BYTES and lang in held:
                    yield out(lang)
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
    for lang in list(held):
        yield out(lang)
    give_back()


def paired(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place by place the number of the pair that starts there (-1: none); the pairs' left and right ids, and how often each occurs."""
    left, right = codes[:-1], codes[1:]
    both = np.flatnonzero((left >= 0) & (right >= 0))
    values, flat, n = np.unique(left[both].astype(np.int64) * max(1, len(ids)) + right[both], return_inverse=True, return_counts=True)
    pairs = np.full(len(codes), -1, np.int32)
    pairs[both] = flat
    return pairs, ids[values // max(1, len(ids))], ids[values % max(1, len(ids))], n


def compact(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Codes as indexes into ``places``, the codes that have a name; other places become -1, a run of these just one."""
    if not len(places):
        return np.empty(0, np.int32)
    new = np.full(int(max(places.max(), codes.max(initial=0))) + 2, -1, np.int32)
    new[places] = np.arange(len(places))
    out = new[codes]
    keep = out >= 0
    keep[1:] |= out[:-1] >= 0
    return out[keep]


def _words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the first level: each batch's distinct words."""
    for b in rows:
        for k in range(b.num_rows):
            words, codes = b.column(3)[k].values, np.frombuffer(b.column(2)[k].as_py(), np.int32)
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            yield from _entries(pa.RecordBatch.from_arrays([b.column(1).take(pa.array(np.full(len(n), k))), words, b.column(0).take(pa.array(np.full(len(n), k))), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["lang", "word", "batch", "place", "n"]))
    give_back()


def _pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a further level: each batch's distinct pairs of adjacent names."""
    for b in rows:
        for k in range(b.num_rows):
            _, left, right, n = paired(np.frombuffer(b.column(1)[k].as_py(), np.int32), b.column(2)[k].values.to_numpy())
            yield from _entries(pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), b.column(0).take(pa.array(np.full(len(n), k))), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["left", "right", "batch", "place", "n"]))
    give_back()


def _entries(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, 1 << 16):
        yield rows.slice(at, 1 << 16)


def _renamed(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(batch, codes, ids, names) rows to ``batch``, ``codes``, ``ids`` of the entries that have a name."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                codes, names = np.frombuffer(b.column(1)[k].as_py(), np.int32), b.column(3)[k].values
                if not first:
                    codes = paired(codes, b.column(2)[k].values.to_numpy())[0]
                ids = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.field("id"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([compact(codes, names.field("place").to_numpy()).tobytes()], pa.binary()), ids], names=["batch", "codes", "ids"])
        give_back()

    return run


def named(entries: DataFrame, by: list[str], least: int, keep: Scratch) -> DataFrame:
    """Entries that occur often enough over all batches, with ``f``, ``id``, and ``leads`` on one entry of each name.

    One exchange counts and names: an entry is a batch's, so the most frequent word or pair sends a row a batch.
    """
    mine = Window.partitionBy(*by)
    dealt = entries.repartition(*by).withColumn("uid", F.monotonically_increasing_id())
    counted = dealt.withColumn("f", F.sum("n").over(mine)).withColumn("id", F.min("uid").over(mine)).where(F.col("f") >= least)
    return keep(counted.select(*by, "batch", "place", "f", "id", (F.col("uid") == F.col("id")).alias("leads")))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases, and the number of words of each language (``lang``, ``n``).

    Phrases: ``lang``, ``id``, ``size``, ``words``, ``f``, ``left``, ``right`` (ids of the phrase without its last and its first
    word), ``l`` and ``r`` by number of words cut off (arrays: f of the first k words, and of the rest), ``longer`` (the greatest
    f of the candidates one word longer that hold it).

    Texts are cut into batches of one language, in which a phrase's occurrences are one entry: only entries are exchanged, so the
    most frequent word costs a row a batch. At each level batches hold codes of the named phrases in order; adjacent ones are
    counted over all batches, frequent pairs get ids, and the ids go back to the batches' entries. Ids are unique within a level.
    """
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    found: list[DataFrame] = []
    with Scratch(docs.sparkSession) as keep:
        state = keep(plain.mapInArrow(_batches, "batch long, lang string, codes binary, words array<string>"))
        words = state.mapInArrow(_words, "lang string, word string, batch long, place int, n long")
        totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
        names = named(words, ["lang", "word"], least, keep)
        whole = cut(names.where("leads").select("lang", "id", F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")))
        for size in range(2, longest + 1):
            ids = names.groupBy("batch").agg(F.collect_list(F.struct("place", "id")).alias("names"))
            old = state.select("batch", "codes", F.lit(None).cast("array<long>").alias("ids") if size == 2 else F.col("ids"))
            before, state = state, keep(old.join(ids, "batch").mapInArrow(_renamed(size == 2), "batch long, codes binary, ids array<long>"))
            keep.drop(before)
            keep.drop(names)
            names = named(state.mapInArrow(_pairs, "left long, right long, batch long, place int, n long"), ["left", "right"], least, keep)
            a, b = (whole.select(*(F.col(c).alias(f"{side}_{c}") for c in ("lang", "id", "words", "heads", "tails"))) for side in ("a", "b"))
            both = names.where("leads").select("id", "f", "left", "right").join(a, F.col("left") == F.col("a_id")).join(b, F.col("right") == F.col("b_id"))
            # heads: f of the first 1, 2, .. words; tails: f of the last 1, 2, .. words; both end with the phrase itself
            grown = {"words": F.concat("a_words", F.slice("b_words", size - 1, 1)), "heads": F.concat("a_heads", F.array("f")), "tails": F.concat("b_tails", F.array("f"))}
            whole = cut(both.select(F.col("a_lang").alias("lang"), "id", F.lit(size).alias("size"), "f", "left", "right", *(e.alias(c) for c, e in grown.items())))
            found.append(whole)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    parents = every.select(F.explode(F.array("left", "right")).alias("id"), "size", "f").groupBy("id", (F.col("size") - 1).alias("size")).agg(F.max("f").alias("longer"))
    cuts = {"l": F.slice("heads", 1, F.col("size") - 1), "r": F.reverse(F.slice("tails", 1, F.col("size") - 1))}
    return every.join(parents, ["id", "size"], "left").select("lang", "id", "size", "words", "f", "left", "right", *(e.alias(c) for c, e in cuts.items()), "longer"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, salts: int = 64) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` best phrases (None: all).

    Texts are lower-cased (A-Z only) and cut at ``.,;:!?`` and line ends; words are runs of bytes other than space and tab. A null
    lang is ``und``, null texts are empty, repeated rows count again, other columns are ignored, an empty table gives no rows.
    Phrases of 2 to ``longest`` words with f >= ``least`` are candidates; the cut with the lowest floor(2000000 f / (l + r)) counts,
    ties to the shortest first part. A candidate goes if a longer one holds it and has 0.8 of its occurrences or more; as no
    phrase occurs more often than a part of it, the candidates one word longer decide. Ranked by score, a, then bytes.
    """
    found, totals = phrases(docs, least, longest)
    wide = "decimal(25,0)"
    left = found.where(F.expr(f"longer is null or 100 * cast(longer as {wide}) < 80 * cast(f as {wide})"))
    score = f"transform(sequence(1, size - 1), k -> named_struct('score', (2000000 * cast(f as {wide})) div (cast(l[k - 1] as {wide}) + r[k - 1]), 'k', k))"
    best = left.withColumn("best", F.array_min(F.expr(score)))
    rows = best.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), F.expr("l[best.k - 1]").alias("l"), F.expr("r[best.k - 1]").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # a language may hold nearly all phrases: each share of them is ranked first, then the best of all shares
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
