"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import add_columns, cut, table

UNDETERMINED = "und"
_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    """Code point -> lower-cased letter, or 32 for anything that isn't a letter; built once a worker."""
    global _LOWER
    if _LOWER is None:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LOWER = out
    return _LOWER


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text's letters: words lie between single spaces, a lone space is no n-gram."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[32], _lower()[raw], [32]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate([one, two, three[c[1:-1] != 32]])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to the smaller code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:size]


def train(docs: DataFrame, size: int = 400, docs_per_lang: int = 3000) -> dict[str, list[int]]:
    """Profiles of the languages of ``lang``: n-grams by falling count.

    ``docs``: ``doc_id``, ``text``, ``lang`` of labelled rows; null languages and texts are left out. Of each language about
    ``docs_per_lang`` documents, chosen by a hash of doc_id, are counted; that bound is the sample's only limit. Profiles
    (languages x ``size`` numbers) come to the driver; there are as many languages as labels.
    """
    docs = docs.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, docs_per_lang / n))])
    sample = docs.where((F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) / float(1 << 20)) < rate[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                values, counts = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values, "n": counts})

    counts = cut(sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return {lang: [r[0] for r in counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(size).select("gram").collect()] for lang in sorted(sizes)}


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (or other ``names``) for its ``text``.

    The whole text's ``size`` most frequent n-grams are compared with each profile: an n-gram that both hold costs the
    difference of its ranks, one that the profile lacks costs ``size``. The least sum wins, ties to the language first in order.
    ``score`` is 1 - sum / most possible. Null texts and texts without a letter give ``und`` and 0, as do all texts if there is
    no profile.
    """
    langs = sorted(profiles)
    vocab = np.unique(np.array([g for x in langs for g in profiles[x]], np.int64))
    rank = np.full((len(langs), len(vocab) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        rank[i, np.searchsorted(vocab, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        top = ranked(grams(text), size)
        if not len(top) or not len(vocab):
            return UNDETERMINED, 0.0
        at = np.searchsorted(vocab, top)
        at[vocab[np.minimum(at, len(vocab) - 1)] != top] = len(vocab)
        there = rank[:, at]
        cost = np.where(there < 0, size, np.abs(there - np.arange(len(top)))).sum(axis=1)
        best = int(cost.argmin())
        return langs[best], 1.0 - float(cost[best]) / (size * len(top))

    def run(texts: list) -> tuple[pa.Array, pa.Array]:
        found = [one(t) for t in texts]
        return pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())

    return add_columns(docs, "text", run, f"{names[0]} string, {names[1]} double")


def held_out() -> F.Column:
    """True for documents that no profile may learn from; a null doc_id counts as one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, size: int = 400, docs_per_lang: int = 3000) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row, by profiles of the rows not held out.

    ``docs``: ``doc_id``, ``text``, ``lang``; other columns are ignored. Repeated rows come out repeated, an empty table gives
    no rows, and a null ``lang`` only keeps its row from the profiles.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    profiles = train(docs.where(~held_out()), size, docs_per_lang)
    return predict(docs.select("doc_id", "text"), profiles, size).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text is null or has no letter have no language and go; all others stay, whether or not there is
    a label to learn from."""
    profiles = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    if not any(profiles.values()):
        lettered = lambda texts: (pa.array([len(grams(t)) > 0 for t in texts], pa.bool_()),)
        return add_columns(docs, "text", lettered, "pairlens__lettered boolean").where("pairlens__lettered").select(*docs.columns)
    marked = predict(docs, profiles, names=("pairlens__lang", "pairlens__score"))
    return marked.where(F.col("pairlens__lang") != UNDETERMINED).select(*docs.columns)
