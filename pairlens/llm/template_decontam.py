"""Benchmark decontamination by template windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import add_columns, table

UNITS = frozenset("mm cm m km mg g kg t ml l ms s sec min h hr hrs kb mb gb tb hz khz mhz ghz w kw v a kwh j kj cal kcal pa kpa mph kph usd eur gbp percent meters metres miles feet inches pounds ounces grams litres liters seconds minutes hours days weeks months years dollars euros cents degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-zµ°]{0,4})")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…–—¿¡·"
_STOPS = frozenset(".!?")
CAPITAL, ENDS, EMPTY = 1, 2, 4
FLAGS = np.uint64(7)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _code(kind: str) -> int:
    return xxhash.xxh64_intdigest(kind) & ~7


NUMBER, NAME, UNIT, OTHER = _code("\0number"), _code("\0name"), _code("\0unit"), _code("\0other")


class Words(dict):
    """Word as it stands -> code of its template with flags in the low three bits. Words outside ``known`` share one code."""

    def __init__(self, known: frozenset[str] | None = None, limit: int = 200_000):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        low = bare.lower()
        if not bare:
            code = EMPTY
        elif not bare[0].isalpha() and _NUMBER.fullmatch(low):
            code = NUMBER
        elif low in UNITS:
            code = UNIT
        else:
            code = _code(low) if self.known is None or low in self.known else OTHER
            if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
                code |= CAPITAL
        if word[-1] in ".!?:;" or word[-2:-1] in _STOPS:
            code |= ENDS
        if len(self) < self.limit:
            self[word] = code
        return code

    def __reduce__(self):
        return Words, (self.known, self.limit)


def templates(texts: list[str | None], memory: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Codes of the texts' words as templates, which of them may be names too, where each text's codes start (and all end), which
    words they stand for, and the words.

    Numbers and units have one code each. So have names: capitalised words that don't start a text or a sentence. One that does
    start it may be a name or another word; its code is the word's. Other words count by their lower-cased form without
    punctuation around it; words of punctuation alone are passed over.
    """
    split = [t.split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = list(chain.from_iterable(split))
    if len(memory) >= memory.limit:
        memory.clear()
    raw = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    flags = (raw & FLAGS).astype(np.uint8)
    starts = np.concatenate([[True], (flags[:-1] & ENDS) > 0])[: len(raw)]
    starts[first[:-1][sizes > 0]] = True
    capital = (flags & CAPITAL) > 0
    code = np.where(capital & ~starts, np.uint64(NAME), raw & ~FLAGS)
    there = (flags & EMPTY) == 0
    at = np.flatnonzero(there)
    return code[at], (capital & starts)[at], np.concatenate([[0], np.cumsum(there)])[first], at, words


def template(text: str | None, memory: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """``templates`` of one text: codes, which may be names, which words they stand for, and the words."""
    codes, maybe, _, at, words = templates([text], memory)
    return codes, maybe, at, words


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].copy()
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * STEP + codes[i : i + n]
    return out ^ (out >> np.uint64(32))


def readings(codes: np.ndarray, maybe: np.ndarray, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at ``starts`` under every reading of the words that may be names: hashes and places."""
    seen = np.concatenate([[0], np.cumsum(maybe)])
    free = seen[starts + size] - seen[starts]

    def read(some: np.ndarray, subset: int) -> np.ndarray:
        """Hashes of windows whose n-th words that may be names are names where ``subset`` has bit n."""
        for i in range(size):
            code = codes[some + i]
            if subset:
                code = np.where(maybe[some + i] & ((subset >> (seen[some + i] - seen[some])) & 1 > 0), np.uint64(NAME), code)
            out = code if i == 0 else (out ^ (out >> np.uint64(29))) * STEP + code
        return out ^ (out >> np.uint64(32))

    hashes, places = [read(starts, 0)], [starts]
    for n in range(1, int(free.max(initial=0)) + 1):
        some = starts[free == n]
        for subset in range(1, 1 << n) if len(some) else ():
            hashes.append(read(some, subset))
            places.append(some)
    return np.concatenate(hashes), np.concatenate(places)


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges from ``low`` to before ``high``, one range after another."""
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Index:
    """Template windows of a block of benchmark texts; texts that share an item id are told apart and count together."""

    piece = 1 << 16

    def __init__(self, items: list[tuple[int, str | None]], size: int, share: float):
        self.size, self.share, self.texts, self.short = size, share, [], {}
        hashes, spots, memory, known = [], [], Words(), set()
        first = [0]
        for item, text in items:
            codes, maybe, at, words = template(text, memory)
            if not len(codes):
                continue
            bare = [words[i] for i in at]
            known.update(w.strip(_EDGE).lower() for w in bare)
            width = min(size, len(codes))
            found, where = readings(codes, maybe, width, np.arange(len(codes) - width + 1))
            k = len(self.texts)
            self.texts.append((item, codes, bare, found, where))
            if width < size:
                for h in found.tolist():
                    self.short.setdefault((width, h), []).append(k)
                first.append(first[-1])
            else:
                hashes.append(found)
                spots.append(first[-1] + where)
                first.append(first[-1] + len(codes) - size + 1)
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.spots, self.first = h[order], join(spots, np.int64)[order], np.array(first)
        self.bits = max(16, int(len(h)).bit_length() + 5)
        self.there = np.zeros(1 << self.bits, bool)
        self.there[self.hashes >> np.uint64(64 - self.bits)] = True
        self.words = Words(frozenset(known))

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """Items that the text holds, each with the share of its windows that are there in step and with consistent slots."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """``matches`` of each text.

        Only windows of words that the benchmark has are looked at. A text whose distinct windows cover too few of an item's places
        can't hold it; for the others, places are met with the text's windows item by item.
        """
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        codes, maybe, first, at, words = templates(texts, self.words)
        known = np.concatenate([[0], np.cumsum((codes != OTHER) | maybe)])
        n = first[1:] - first[:-1]
        for d in np.flatnonzero((n > 0) & (n < self.size)).tolist() if self.short else ():
            i, j = int(first[d]), int(first[d + 1])
            if known[j] - known[i] == j - i:
                out[d] = self.whole(codes[i:j], maybe[i:j], [words[k] for k in at[i:j]])
        starts = np.flatnonzero(known[self.size :] - known[: -self.size] == self.size) if len(codes) >= self.size else np.empty(0, np.int64)
        doc = np.searchsorted(first, starts, "right") - 1
        starts = starts[starts + self.size <= first[doc + 1]]
        if not len(starts):
            return out
        found, where = readings(codes, maybe, self.size, starts)
        near = self.there[found >> np.uint64(64 - self.bits)]
        found, where = found[near], where[near]
        doc = np.searchsorted(first, where, "right") - 1
        order = np.lexsort((found, doc))
        found, where, doc = found[order], where[order], doc[order]
        totals = np.diff(self.first)
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else [0]
        for i, j in zip(edges[:-1], edges[1:]):
            d = int(doc[i])
            low, high = np.searchsorted(self.hashes, own := np.unique(found[i:j]), "left"), np.searchsorted(self.hashes, own, "right")
            covered = np.unique(self.spots[runs(low, high)])
            if not len(covered):
                continue
            counts = np.bincount(np.searchsorted(self.first, covered, "right") - 1, minlength=len(totals))
            wanted = np.flatnonzero((totals > 0) & (counts >= self.share * totals)).tolist()
            if wanted:
                x, y = int(first[d]), int(first[d + 1])
                theirs, best = (codes[x:y], [words[k] for k in at[x:y]]), {}
                for k in wanted:
                    item, share = self.texts[k][0], self.in_step(k, found[i:j], where[i:j] - x, theirs)
                    if share >= self.share:
                        best[item] = max(share, best.get(item, 0.0))
                out[d] = sorted(best.items())
        return out

    def whole(self, codes: np.ndarray, maybe: np.ndarray, bare: list[str]) -> list[tuple[int, float]]:
        """Short items that a short text is the same as."""
        hashes, n = readings(codes, maybe, len(codes), np.zeros(1, np.int64))[0].tolist(), len(codes)
        texts = {k for h in hashes for k in self.short.get((n, h), ())}
        return sorted({(self.texts[k][0], 1.0) for k in texts if self.consistent({0: 0}, self.texts[k][1:3], (codes, bare), n)})

    def in_step(self, k: int, found: np.ndarray, where: np.ndarray, theirs: tuple) -> float:
        """The greatest share of a benchmark text's windows that stand in step; a long text is gone through in pieces that overlap by
        more than the item and its insertions, so what is expanded is bounded by a piece times the item."""
        _, codes, words, hashes, places = self.texts[k]
        total, best = len(codes) - self.size + 1, 0.0
        reach = max(self.size, total // 4)
        last = int(where.max())
        for start in range(0, last + 1, self.piece):
            if last >= self.piece:
                here = (where >= start) & (where < start + self.piece + 2 * (total + reach))
                some, at = found[here], where[here]
            else:
                some, at = found, where
            low, high = np.searchsorted(some, hashes, "left"), np.searchsorted(some, hashes, "right")
            place, pos = np.repeat(places, high - low), at[runs(low, high)]
            if not len(pos):
                continue
            pairs = np.unique((pos - place + total) * total + place)
            shift, place = pairs // total, pairs % total
            steps, begin, counts = np.unique(shift, return_index=True, return_counts=True)
            # an insertion shifts what follows; runs that lie within an item's length of each other belong together
            ends = np.searchsorted(steps, steps + reach, "right")
            upto = np.concatenate([[0], np.cumsum(counts)])
            most = np.minimum(upto[ends] - upto[np.arange(len(steps))], total) / total
            for i in np.argsort(-most, kind="stable").tolist():
                if most[i] < self.share or most[i] <= best or best == 1.0:
                    break
                near: dict[int, int] = {}
                for t in range(i, int(ends[i])):
                    own = place[begin[t] : begin[t] + counts[t]]
                    near = dict(zip(own.tolist(), (own + steps[t] - total).tolist())) | near
                best = max(best, self.consistent(near, (codes, words), theirs, self.size) / total)
        return best

    def consistent(self, found: dict[int, int], mine: tuple, theirs: tuple, size: int) -> int:
        """How many windows stay if every name or number of the item stands for one value of the text, and no two for the same.

        A word that may be a name is one where the texts differ, or where the other text has a name. Windows that need no such
        reading come first, so what they settle holds for the others.
        """
        (codes, words), (their_codes, their_words) = mine, theirs
        kinds = {NUMBER, NAME}
        to: dict[tuple[int, str], str] = {}
        back: dict[tuple[int, str], str] = {}
        kept, order = 0, []
        for q, p in sorted(found.items()):
            read = codes[q : q + size] != their_codes[p : p + size]
            slots = [
                (NAME if r else c, words[q + i].strip(_EDGE), their_words[p + i].strip(_EDGE))
                for i, (c, r) in enumerate(zip(codes[q : q + size].tolist(), read.tolist())) if r or c in kinds
            ]
            order.append((bool(read.any()), q, slots))
        for _, _, slots in sorted(order, key=lambda x: x[:2]):
            if all(to.get((k, x), y) == y and back.get((k, y), x) == x for k, x, y in slots):
                to |= {(k, x): y for k, x, y in slots}
                back |= {(k, y): x for k, x, y in slots}
                kept += 1
        return kept


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of at most ``most`` characters (one item at least)."""
    some, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").toLocalIterator():
        if some and size + len(text or "") > most:
            yield some
            some, size = [], 0
        some.append((item, text))
        size += len(text or "")
    if some:
        yield some


def mark(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, block_chars: int = 20_000_000, name: str = "hits") -> DataFrame:
    """``docs`` with ``hits`` (or another ``name``): the benchmark items (``item``, ``share``) that each row's whole text holds.

    A text holds an item if at least ``share`` of the item's windows of ``size`` template words occur in it in step, with slots
    that agree. The join's build side is a block of the benchmark, at most ``block_chars`` characters (some 40 bytes of index
    each); a larger benchmark takes one pass over the documents for each further block, in the same plan. An item with fewer than
    ``size`` template words is held by a text of the same template and consistent slots only. Null texts, and texts and items without
    a word, match nothing. An item id that is null is no item; one that repeats is held if any of its texts is, and counts once.
    """
    out, seen = docs, []
    for i, items in enumerate(blocks(benchmark, block_chars)):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, size, share))

        def run(texts: list, index=index) -> tuple[pa.Array]:
            some = [m for i in range(0, len(texts), 256) for m in index.value.matches_of(texts[i : i + 256])]
            found = [[{"item": x, "share": s} for x, s in m] for m in some]
            return (pa.array(found, pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64())]))),)

        out = add_columns(out, "text", run, f"{name}__{i} array<struct<item: bigint, share: double>>")
        seen.append(f"{name}__{i}")
    hits = F.concat(*seen) if seen else F.expr("cast(array() as array<struct<item: bigint, share: double>>)")
    out = out.withColumn(name, hits)
    if len(seen) > 1:
        once = f"transform(array_distinct({name}.item), i -> named_struct('item', i, 'share', array_max(transform(filter({name}, h -> h.item = i), h -> h.share))))"
        out = out.withColumn(name, F.expr(once))
    return out.drop(*seen)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_ids``, ``best_share`` of every row; repeated rows come out repeated."""
    marked = mark(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, size, share)
    return marked.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.array_sort("hits.item").alias("item_ids"),
        F.coalesce(F.array_max("hits.share"), F.lit(0.0)).alias("best_share"),
    )


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    marked = mark(docs, table(spark, sf_dir, "benchmark"), name="pairlens__hits")
    return marked.where(F.size("pairlens__hits") == 0).select(*docs.columns)
