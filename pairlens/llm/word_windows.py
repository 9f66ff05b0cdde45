"""Removal of word windows that documents with smaller ids hold, by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Scratch, cut, give_back, table

WINDOW = 13
#: Words of a gram. The least gram hash of a window is its anchor, so equal windows have equal anchors.
GRAM = 5
#: Words of a shard of reference text, whose automaton one task builds.
SHARD_WORDS = 1 << 16
#: Anchors with so many pieces are searched window by window, so that no shard outgrows SHARD_WORDS by more than these pieces.
HOT_PIECES = 4096
UNIT_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NO_OWNER = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Multipliers of hashes: odd, fixed by their place and the seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MIX + np.uint64(seed)) | np.uint64(1)


_GRAMS, _WINDOWS, _OTHERS, _PIECES = odd_numbers(GRAM, 1), odd_numbers(WINDOW, 2), odd_numbers(WINDOW, 3), odd_numbers(WINDOW, 4)


def bounds_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(solid))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, each by its bytes alone."""
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = np.frombuffer(raw, np.uint8)[np.repeat(begin, size) + within].astype(np.uint64) + np.uint64(1)
    power = np.multiply.accumulate(np.full(int(size.max()), np.uint64(0x5851F42D4C957F2D)))
    return mix(np.add.reduceat(letters * power[within], first) + size.astype(np.uint64))


def rolled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Hash of every run of len(by) values."""
    n = len(x) - len(by) + 1
    total = np.zeros(max(0, n), np.uint64)
    for i, k in enumerate(by):
        total += x[i : i + len(total)] * k
    return mix(total)


def units(text: str | None) -> Iterator[tuple[int, bytes]]:
    """A text in pieces of bounded size that share 12 words with the next, each with its first word's number: every window is in one."""
    raw = (text or "").encode()
    if len(raw) <= UNIT_BYTES:
        yield 0, raw
        return
    begin, end = bounds_of(raw)
    at = 0
    while at == 0 or at + WINDOW <= len(begin):
        last = max(at + WINDOW, int(np.searchsorted(begin, begin[at] + UNIT_BYTES)) if len(begin) else 0)
        last = min(last, len(begin))
        if last:
            yield at, raw[begin[at] : end[last - 1]]
        at = max(1, last - WINDOW + 1)
        if last == len(begin):
            return


def anchored(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per group of texts: row, anchor, piece hash, first word and number of windows of each piece.

    A piece is a run of windows of one text that have their anchor at the same place: at most 9 windows, 21 words.
    """
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for at, raw in units(text):
            if group and size + len(raw) > UNIT_BYTES:
                yield _anchored(group)
                group, size = [], 0
            group.append((row, at, raw))
            size += len(raw) + 1
    if group:
        yield _anchored(group)


def _anchored(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    raw = b"\n".join(x[2] for x in group)
    begin, end = bounds_of(raw)
    words = word_hashes(raw, begin, end)
    offsets = np.cumsum([0] + [len(x[2]) + 1 for x in group[:-1]])
    unit = np.searchsorted(offsets, begin, "right") - 1
    n = len(words) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    grams, windows = rolled(words, _GRAMS), rolled(words, _WINDOWS)
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for t in range(1, WINDOW - GRAM + 1):
        better = grams[t : t + n] < least
        least[better], place[better] = grams[t : t + n][better], t
    place += np.arange(n)
    valid = np.flatnonzero(unit[:n] == unit[WINDOW - 1 :])
    if not len(valid):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (place[valid[1:]] != place[valid[:-1]])
    starts = np.flatnonzero(new)
    many = np.diff(np.append(starts, len(valid)))
    within = np.arange(len(valid)) - np.repeat(starts, many)
    pieces = mix(np.add.reduceat(windows[valid] * _PIECES[within], starts))
    first = valid[starts]
    of = unit[first]
    word_of_unit = np.searchsorted(begin, offsets)
    numbers = first - word_of_unit[of] + np.array([x[1] for x in group])[of]
    return np.array([x[0] for x in group])[of], least[first].view(np.int64), pieces.view(np.int64), numbers, many


class Automaton:
    """Suffix automaton of several word sequences; each state knows the least owner of the strings that reach it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [_NO_OWNER]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(_NO_OWNER)
        return len(self.link) - 1

    def add(self, words: list[int], owner: int) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = moves[last].get(c)
            if q is None:
                now = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in moves[p]:
                    moves[p][c] = now
                    p = link[p]
                if p >= 0:
                    link[now] = self._split(p, c)
            else:
                now = self._split(last, c)
            if owner < self.owner[now]:
                self.owner[now] = owner
            last = now

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c, taken out of a state that holds longer ones too if need be."""
        moves, link, length = self.next, self.link, self.length
        q = moves[p][c]
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], moves[q].copy())
        link[q] = clone
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        return clone

    def settle(self) -> None:
        """Hands least owners down from longer strings to their suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.owner[v] < self.owner[p]:
                self.owner[p] = self.owner[v]

    def owners(self, words: list[int], window: int) -> list[int]:
        """The least owner of every window of ``words``, by matching statistics (none: 2**63 - 1)."""
        moves, link, length = self.next, self.link, self.length
        v = matched = 0
        out = []
        for t, c in enumerate(words):
            while v and c not in moves[v]:
                v = link[v]
                matched = length[v]
            if c in moves[v]:
                v = moves[v][c]
                matched += 1
            while v and length[link[v]] >= window:
                v = link[v]
                matched = length[v]
            if t >= window - 1:
                out.append(self.owner[v] if matched >= window else _NO_OWNER)
        return out


def _shard_owners(shard: pa.Table) -> pa.Table:
    """Builds the automaton of a shard's reference pieces and streams the pieces through it."""
    codes: dict[int, int] = {}
    pieces = [[codes.setdefault(w, len(codes)) for w in np.frombuffer(b, np.int64).tolist()] for b in shard.column("words").to_pylist()]
    built = Automaton()
    for words, owner in zip(pieces, shard.column("owner").to_pylist()):
        built.add(words, owner)
    built.settle()
    return shard.select(["key", "other", "single"]).append_column("first", pa.array([built.owners(p, WINDOW) for p in pieces], pa.list_(pa.int64())))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchored pieces of (doc_id, text_id, text) rows; ``at`` is 16 times the first word's number plus the number of windows."""
    for b in batches:
        for row, anchor, piece, first, many in anchored(b.column(2).to_pylist()):
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(piece), b.column(0).take(rows), b.column(1).take(rows), pa.array(first * 16 + many)], names=["anchor", "piece", "doc_id", "text_id", "at"])
    give_back()


_FETCHED = pa.schema([(c, pa.int64()) for c in ("key", "other", "anchor", "piece")] + [("place", pa.int32()), ("owner", pa.int64()), ("words", pa.binary())])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted pieces of (doc_id, text_id, text, wanted) rows; pieces of hot anchors window by window."""
    for b in batches:
        for k in range(b.num_rows):
            mine, wanted = b.column(1)[k].as_py(), b.column(3)[k].as_py()
            wanted = [w for w in wanted if w["text_id"] == mine]
            if wanted:
                raw = (b.column(2)[k].as_py() or "").encode()
                begin, end = bounds_of(raw)
                for at in range(0, len(wanted), 8192):
                    out = _words_of(wanted[at : at + 8192], raw, begin, end, b.column(0)[k].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FETCHED)], schema=_FETCHED)
    give_back()


def _words_of(wanted: list[dict], raw: bytes, begin: np.ndarray, end: np.ndarray, doc: int) -> list[tuple]:
    places = [np.arange(w["at"] // 16, w["at"] // 16 + w["at"] % 16 + WINDOW - 1) for w in wanted]
    flat = np.concatenate(places)
    hashes = word_hashes(raw, begin[flat], end[flat])
    out: list[tuple] = []
    for w, words in zip(wanted, np.split(hashes, np.cumsum([len(p) for p in places])[:-1])):
        if w["hot"]:
            keys, others = rolled(words, _WINDOWS).view(np.int64).tolist(), rolled(words, _OTHERS).view(np.int64).tolist()
            out += [(keys[i], others[i], w["anchor"], w["piece"], i, doc, words[i : i + WINDOW].tobytes()) for i in range(len(keys))]
        else:
            out.append((w["anchor"], w["piece"], w["anchor"], w["piece"], -1, doc, words.tobytes()))
    return out


def strip_windows(docs: DataFrame, shard_words: int = SHARD_WORDS, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``doc_id``, ``kept`` (words that stay, joined by one space), ``n_words``, ``n_removed`` of every row.

    Words are runs of bytes other than space and \\t to \\r. A word goes if a window of 13 words that covers it also starts in a
    document with a smaller doc_id, by the input as it is. Null texts have no words. Rows with a null doc_id lose nothing and
    repeat nothing; rows that share a doc_id are one document's. An empty table gives no rows; other columns are ignored.

    Windows whose anchor (least hash of their 5-grams) only one document has cannot repeat. The others are joined to pieces, and
    of equal pieces one goes on, with its least doc_id: these are the reference. It is dealt by anchor to shards of bounded size; a
    task builds a shard's suffix automaton and streams the shard's pieces for matching statistics, whose states tell each window's
    least owner. Anchors that many pieces share are dealt window by window instead. Words are told by 64 bits of hash.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("text_id"), F.col("text").cast("string"))
    named = docs.where("doc_id is not null")
    with Scratch(docs.sparkSession) as keep:
        pieces = keep(named.mapInArrow(_pieces, "anchor long, piece long, doc_id long, text_id int, at long"))
        shared = pieces.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        # kept by itself, so that the join reads both sides through exchanges and may split an anchor's pieces
        shared = keep(shared.select("anchor", (F.col("n") > hot_pieces).alias("hot")))
        met = keep(pieces.join(shared, "anchor"))
        keep.drop(pieces)
        least = met.groupBy("anchor", "piece", "hot").agg(F.min(F.struct("doc_id", "text_id", "at")).alias("r")).select("anchor", "piece", "hot", "r.*")
        wanted = least.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "at", "anchor", "piece", "hot")).alias("wanted"))
        words = named.join(wanted, "doc_id").select("doc_id", "text_id", "text", "wanted")
        words = keep(words.mapInArrow(_fetched, "key long, other long, anchor long, piece long, place int, owner long, words binary"))
        reference = keep(words.groupBy("key", "other", (F.col("place") >= 0).alias("single"), "words").agg(F.min("owner").alias("owner")))
        total = reference.agg(F.sum(F.length("words"))).first()[0] or 0
        dealt = reference.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // (8 * shard_words))))))
        first = keep(dealt.groupBy("shard").applyInArrow(_shard_owners, "key long, other long, single boolean, first array<long>"))
        parts = words.where("place >= 0").join(first.where("single"), ["key", "other"]).groupBy("anchor", "piece")
        parts = parts.agg(F.array_sort(F.collect_set(F.struct("place", F.col("first")[0].alias("owner")))).alias("p")).select("anchor", "piece", F.col("p.owner").alias("first"))
        every = first.where("not single").select(F.col("key").alias("anchor"), F.col("other").alias("piece"), "first").unionByName(parts)
        gone = F.expr("aggregate(zip_with(first, sequence(0, size(first) - 1), (f, i) -> if(f < doc_id, shiftleft(1, i), 0)), 0, (a, b) -> a + b)")
        marks = met.join(every, ["anchor", "piece"]).select("doc_id", "text_id", F.shiftright("at", 4).alias("at"), gone.alias("gone")).where("gone > 0")
        marks = cut(marks.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("at", "gone")).alias("marks")))
    stripped = docs.join(marks, ["doc_id", "text_id"], "left").select("doc_id", "text", "marks")
    return stripped.mapInArrow(_stripped, "doc_id long, kept binary, n_words long, n_removed long")


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            some = b.slice(at, 512)
            out = []
            for text, marks in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for m in marks or []:
                    for i in range(WINDOW):
                        if m["gone"] >> i & 1:
                            edge[m["at"] + i] += 1
                            edge[m["at"] + i + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n = int(gone.sum())
                out.append((b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n else b" ".join(words), len(words), n))
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64())))], names=["doc_id", "kept", "n_words", "n_removed"])


def op11_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
