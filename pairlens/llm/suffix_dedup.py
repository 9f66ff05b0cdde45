"""Removal of repeated 50-byte strings with suffix arrays built by linear grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Scratch, cut, give_back, table

LENGTH = 50
GRAM = 20
LEAST_BUCKETS, BUCKET_BYTES, FLUSH_BYTES = 256, 32 << 20, 4 << 20
#: Passes over the texts, each of which exchanges the contexts of a share of the grams.
ROUNDS = 2
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array by grouping suffixes by their Lyndon prefix, then emitting each group's order; no renaming, no recursion.

    Groups begin as the suffixes of one first symbol and are taken from the greatest down. Each member's previous-smaller pointer
    leads to the closest suffix before it in a group not yet taken. That suffix's prefix grows by the member's, so it moves to a new
    group right above its own; suffixes that several members of the group lead to move above those that fewer lead to. Taken groups
    are final: they hold the suffixes of one Lyndon prefix. The second pass reads the array as it fills: each suffix places the one
    before it, and that one's chain of previous-smaller suffixes, at the next free place of their groups.
    """
    n = len(s)
    members: list[list[int]] = []
    lower: list[int] = []
    upper: list[int] = []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    of = [0] * n
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        lower.append(g - 1)
        upper.append(g + 1)
        for i in by_symbol[c]:
            of[i] = g
    prev, done = [-1] * n, bytearray(n)
    g, taken = len(members) - 1, []
    while g >= 0:
        mine = [i for i in members[g] if of[i] == g]
        hits: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            done[i] = 1
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if mine:
            taken.append(mine)
        if hits:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in hits.items():
                moved.setdefault((of[p], k), []).append(p)
            below: dict[int, int] = {}
            for home, k in sorted(moved) if len(moved) > 1 else moved:
                some, at, new = moved[home, k], below.get(home, home), len(members)
                if len(some) > 1:
                    some.sort()
                above = upper[at]
                members.append(some)
                lower.append(at)
                upper.append(above)
                upper[at] = new
                lower[above] = new
                below[home] = new
                for p in some:
                    of[p] = new
        g = lower[g]
    out, start, at = [0] * n, {}, 0
    for mine in reversed(taken):
        start[of[mine[0]]] = at
        at += len(mine)
    free = done  # all ones by now: not placed yet

    def place(p: int) -> None:
        while p >= 0 and free[p]:
            k = of[p]
            q = start[k]
            out[q] = p
            start[k] = q + 1
            free[p] = 0
            p = prev[p]

    place(n - 1)
    for i in range(n):
        p = out[i] - 1
        if p >= 0 and free[p]:
            place(p)
    return out


def gram_hashes(a: np.ndarray, k: int = GRAM) -> np.ndarray:
    n, w = len(a) - k + 1, np.ndarray(len(a) - 7, "<u8", a, 0, (1,)).copy()
    h = w[:n] * _MIX
    for o in [*range(8, k - 8, 8), k - 8]:
        h = (h ^ (h >> np.uint64(31))) * _MIX + w[o : o + n]
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of 50-byte strings with the same least gram hash: the hash, first start, and one past the last.

    Least hashes are small numbers; they are mixed anew, so that their leading bits name buckets and places of the bitmap evenly.
    """
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m, size, w = gram_hashes(np.frombuffer(raw, np.uint8)), 1, LENGTH - GRAM + 1
    n = len(m) - w + 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[:n], m[w - size : w - size + n])
    s = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[s] * _MIX2, s, np.append(s[1:], n)


def shared_strings(contexts: list[tuple[bytes, int]], chunk: int = 1 << 16) -> list[tuple[int, int, int]]:
    """(context, start in it, least doc that holds the string): for each 50-byte string that several contexts hold.

    ``contexts``: bytes and the least doc that holds them, equal grams next to each other, so strings shared by contexts of one gram
    lie in one array unless a gram has more than ``chunk`` bytes: then its array is as long as need be.
    """
    data, owner, places = bytearray(), [], []
    for c, (body, _) in enumerate(contexts):
        places.append((len(data), len(body)))
        owner += [c] * len(body) + [-1]
        data += body + b"\0"
    # the separator is below every byte; bytes move up by one
    symbols, whole = [x + 1 for x in data], bytes(data)
    for at, n in places:
        symbols[at + n] = 0
    valid = bytearray(len(data))
    for at, n in places:
        valid[at : at + n - LENGTH + 1] = b"\1" * (n - LENGTH + 1)
    order = [i for i in suffix_array(symbols) if valid[i]]
    out, i = [], 0
    while i < len(order):
        first = whole[order[i] : order[i] + LENGTH]
        j = i + 1
        while j < len(order) and whole[order[j] : order[j] + LENGTH] == first:
            j += 1
        if j - i > 1:
            least = min(contexts[owner[x]][1] for x in order[i:j])
            out += [(owner[x], x - places[owner[x]][0], least) for x in order[i:j]]
        i = j
    return out


def common_pieces(contexts: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(context, start in it, piece): pieces that cover every 50-byte string whose hash another context has too.

    Equal strings have equal hashes, so no shared string is lost; others with equal hashes only make pieces longer.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    counts = sizes - LENGTH + 1
    own = np.repeat(np.arange(len(contexts)), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = gram_hashes(np.frombuffer(b"".join(contexts), np.uint8), LENGTH)[at + np.repeat(np.cumsum(sizes) - sizes, counts)]
    order = np.lexsort((own, h))
    h, by = h[order], own[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = by[new] != by[np.append(new[1:], len(by)) - 1]
    hit = np.zeros(len(own), bool)
    hit[order] = np.repeat(several, np.diff(np.append(new, len(by))))
    edge = np.concatenate([[True], own[1:] != own[:-1]])
    low = np.flatnonzero(hit & (edge | np.concatenate([[True], ~hit[:-1]])))
    high = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]]))
    return [(c, i, contexts[c][i : j + LENGTH]) for c, i, j in zip(own[low].tolist(), at[low].tolist(), at[high].tolist())]


def resolve(grams: np.ndarray, bodies: list[bytes], docs: np.ndarray, texts: np.ndarray, starts: np.ndarray, chunk: int = 1 << 16) -> list[tuple[int, int, int, int]]:
    """Starts (doc, text, low, high) of strings that a smaller doc holds, among occurrences of contexts with their grams."""
    least: dict[tuple[int, bytes], int] = {}
    for g, b, d in zip(grams.tolist(), bodies, docs.tolist()):
        if (x := least.get((g, b))) is None or d < x:
            least[g, b] = d
    by_gram: dict[int, list[bytes]] = {}
    for g, b in least:
        by_gram.setdefault(g, []).append(b)
    known: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal waiting, size
        # equal pieces of a gram are one piece of the least document that has it; suffix arrays compare those that differ
        by_piece: dict[int, dict[bytes, list[tuple[tuple[int, bytes], int]]]] = {}
        for c, i, piece in common_pieces([b for _, b in waiting]):
            by_piece.setdefault(waiting[c][0], {}).setdefault(piece, []).append((waiting[c], i))
        some: list[tuple[bytes, list[tuple[tuple[int, bytes], int]], int]] = []
        held, left = 0, len(by_piece)
        for own in by_piece.values():
            left -= 1
            for piece, places in own.items():
                first = min(least[name] for name, _ in places)
                if len(places) > 1:
                    for name, i in places:
                        known.setdefault(name, []).extend((i + r, first) for r in range(len(piece) - LENGTH + 1))
                if len(own) > 1:
                    some.append((piece, places, first))
                    held += len(piece)
            if some and (held > chunk or not left):
                for x, r, d in shared_strings([(piece, first) for piece, _, first in some]):
                    for name, i in some[x][1]:
                        known.setdefault(name, []).append((i + r, d))
                some, held = [], 0
        waiting, size = [], 0

    for g, own in by_gram.items():
        if len(own) > 1:
            waiting += [(g, b) for b in own]
            size += sum(map(len, own))
            if size > 4 * chunk:
                flush()
    if waiting:
        flush()
    out = []
    for g, b, d, t, s in zip(grams.tolist(), bodies, docs.tolist(), texts.tolist(), starts.tolist()):
        if d > least[g, b]:
            out.append((d, t, s, s + len(b) - LENGTH + 1))
        else:
            low = None
            for r, _ in [*sorted(x for x in known.get((g, b), ()) if x[1] < d), (1 << 60, 0)]:
                if low is not None and r != high:
                    out.append((d, t, s + low, s + high))
                    low = None
                if low is None:
                    low = r
                high = r + 1
    return out


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_id(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def repeated_grams(docs: DataFrame, buckets: int, bits: int) -> bytes:
    """Bitmap of 2 ** bits over the leading bits of gram hashes that lie in two different texts; always the same size."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                hs, ts = [], []
                for t in b.column(1).to_pylist():
                    raw = raw_of(t)
                    h = np.unique(anchors(raw)[0])
                    hs.append(h)
                    ts.append(np.full(len(h), text_id(raw) & ((1 << 48) - 1), np.uint64))
                h, t = np.concatenate(hs), np.concatenate(ts)
                order = np.argsort(h, kind="stable")
                h, t = h[order], t[order]
                ends = np.searchsorted(h, (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)))
                blobs = [a.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() + c.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, c in zip(np.split(h, ends), np.split(t, ends))]
                yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def find(part: pd.DataFrame) -> pd.DataFrame:
        hs, ts = [], []
        for x in part["blob"]:
            n = len(x) // 12
            wide = np.zeros((2 * n, 8), np.uint8)
            wide[:n, 2:] = np.frombuffer(x[: 6 * n], np.uint8).reshape(n, 6)
            wide[n:, :6] = np.frombuffer(x[6 * n :], np.uint8).reshape(n, 6)
            hs.append(wide[:n].view("<u8").ravel())
            ts.append(wide[n:].view("<u8").ravel())
        h, t = np.concatenate(hs), np.concatenate(ts)
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        again = (h[1:] == h[:-1]) & (t[1:] != t[:-1])
        marks = np.unique(h[1:][again] >> np.uint64(64 - bits)).astype(np.int64)
        return pd.DataFrame({"marks": [marks]})

    found = docs.mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInPandas(find, "marks array<long>")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Marks as bytes of the bitmap's words: at most its size in all."""
        for b in batches:
            out = []
            for m in b["marks"]:
                word, place = np.asarray(m, np.int64) >> 3, np.asarray(m, np.int64) & 7
                names, at = np.unique(word, return_inverse=True)
                value = np.zeros(len(names), np.uint8)
                np.bitwise_or.at(value, at, (1 << place).astype(np.uint8))
                out.append(zstandard.compress(names.tobytes() + value.tobytes()))
            yield pd.DataFrame({"words": out})

    packed = np.zeros(1 << (bits - 3), np.uint8)
    for (blob,) in cut(found.mapInPandas(pack, "words binary")).toLocalIterator():
        raw = zstandard.decompress(blob)
        n = len(raw) // 9
        names, value = np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n :], np.uint8)
        packed[names] |= value
    return packed.tobytes()


def repeated_starts(docs: DataFrame, buckets: int, bits: int = 27, remembered: int = 100_000, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``text_id``, ``ranges`` (pairs of longs: starts of 50-byte strings that a smaller doc_id holds), several rows a document.

    Every 50-byte string contains the gram of least hash among its grams; equal strings choose equal grams. Only strings whose gram
    lies in two different texts can repeat, so a first pass marks such grams in a bitmap of fixed size (a false mark costs time only),
    and a second one cuts out the bytes around each marked gram (a context: all 50-byte strings that chose it). A context that the
    same task has seen in a smaller document is marked at once; the others are dealt by gram, cut to the pieces whose hashes several
    contexts have, and suffix arrays over the pieces of each gram find which of their strings agree. A gram that a third of the rows hold sends one context a task for each distinct one.
    Contexts overlap, so all of them are about four times the text. Each of ``rounds`` passes exchanges those of its share of the grams
    and keeps only the ranges, so the exchange is that part of them on disk even where every gram is shared.
    """
    seen_twice = docs.sparkSession.sparkContext.broadcast(repeated_grams(docs, buckets, bits))

    def contexts(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        marks, known, whole_texts = np.frombuffer(seen_twice.value, np.uint8), {}, {}
        packer = zstandard.ZstdCompressor(3)
        docs_, texts_, grams, owners, starts, bodies, here, held = [], [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [(k, None, None, packer.compress(x)) for k, x in dealt_contexts(buckets, docs_, texts_, grams, owners, starts, bodies)] + here
            for x in (docs_, texts_, grams, owners, starts, bodies, here):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.binary()))], names=["bucket", "doc_id", "text_id", "blob"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = raw_of(text)
                    if len(raw) < LENGTH:
                        continue
                    digest = xxhash.xxh3_128_digest(raw)
                    first = whole_texts.get(digest)
                    if first is not None and first <= doc:
                        continue  # what it holds, this task has sent for a smaller document; the copy itself goes whole
                    whole_texts[digest] = doc
                    h, s, e = anchors(raw)
                    top = (h >> np.uint64(64 - bits)).astype(np.int64)
                    keep = ((marks[top >> 3] >> (top & 7)) & 1 > 0) & (h % np.uint64(rounds) == turn)
                    if not keep.any():
                        continue
                    tid, own, n = text_id(raw), [], len(bodies)
                    for g, i, j in zip(h[keep].tolist(), s[keep].tolist(), e[keep].tolist()):
                        body = raw[i : j + LENGTH - 1]
                        name = xxhash.xxh3_128_digest(body)
                        first = known.get(name)
                        if first is not None and first < doc:
                            own += (i, j)
                            continue
                        known[name] = doc
                        grams.append(g)
                        starts.append(i)
                        bodies.append(body)
                        held += len(body)
                    if len(bodies) > n:
                        owners.extend([len(docs_)] * (len(bodies) - n))
                        docs_.append(doc)
                        texts_.append(tid)
                    if own:
                        here.append((tid % buckets, str(doc), str(tid), np.array(own, np.int64).tobytes()))
                    if len(known) > remembered:
                        known.clear()
                    if len(whole_texts) > remembered:
                        whole_texts.clear()
                    if held > FLUSH_BYTES or len(docs_) == 1 << 16:
                        yield flush()
                        held = 0
        yield flush()
        known.clear()
        whole_texts.clear()
        give_back()

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        grams, docs_, texts, starts, bodies = [], [], [], [], []
        ready = part["doc_id"].notna()
        if ready.all():
            return part[["doc_id", "text_id", "blob"]]
        for blob in part["blob"][~ready]:
            g, d, t, s, b = unpack_contexts(zstandard.decompress(blob))
            grams.append(g)
            docs_.append(d)
            texts.append(t)
            starts.append(s)
            bodies += b
        give_back()
        per: dict[tuple[int, int], list[int]] = {}
        for d, t, low, high in resolve(np.concatenate(grams), bodies, np.concatenate(docs_), np.concatenate(texts), np.concatenate(starts)):
            per.setdefault((d, t), []).extend((low, high))
        new = pd.DataFrame({"doc_id": [str(k[0]) for k in per], "text_id": [str(k[1]) for k in per], "blob": [np.array(v, np.int64).tobytes() for v in per.values()]})
        return pd.concat([part.loc[ready, ["doc_id", "text_id", "blob"]], new])

    settled = None
    for turn in range(rounds):
        found = docs.mapInArrow(lambda batches, turn=turn: contexts(batches, turn), "bucket int, doc_id string, text_id string, blob binary")
        some = cut(found.groupBy("bucket").applyInPandas(settle, "doc_id string, text_id string, blob binary"))
        settled = some if settled is None else settled.unionByName(some)
    return settled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_id").cast("long").alias("text_id"), F.col("blob").alias("ranges"))


def dealt_contexts(buckets: int, docs: list[int], texts: list[int], grams: list[int], owners: list[int], starts: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Contexts by bucket of their gram, packed: names of the documents once, then grams, owners (places in that list), starts, sizes,
    bodies; small numbers take two or four bytes."""
    if not bodies:
        return
    g, o = np.array(grams, np.uint64), np.array(owners, np.int64)
    names = np.array([docs, texts], np.int64)
    at, sizes = np.array(starts, np.uint32), np.fromiter(map(len, bodies), np.uint32, len(bodies))
    bucket = ((g >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        used, place = np.unique(o[own], return_inverse=True)
        head = np.array([len(used), len(own)], np.int64).tobytes()
        parts = [names[:, used].tobytes(), g[own].tobytes(), place.astype(np.uint16).tobytes(), at[own].tobytes(), sizes[own].tobytes()]
        yield int(bucket[own[0]]), b"".join([head, *parts, *(bodies[i] for i in own.tolist())])


def unpack_contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Grams, documents, text ids, starts and bodies of a blob of ``dealt_contexts``."""
    k, n = np.frombuffer(raw, np.int64, 2).tolist()
    names = np.frombuffer(raw, np.int64, 2 * k, 16).reshape(2, k)
    at = 16 + 16 * k
    g, place = np.frombuffer(raw, np.uint64, n, at), np.frombuffer(raw, np.uint16, n, at + 8 * n)
    starts, sizes = np.frombuffer(raw, np.uint32, n, at + 10 * n).astype(np.int64), np.frombuffer(raw, np.uint32, n, at + 14 * n).astype(np.int64)
    ends = (at + 18 * n + np.cumsum(sizes)).tolist()
    return g, names[0, place], names[1, place], starts, [raw[e - z : e] for e, z in zip(ends, sizes.tolist())]


def strip_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``kept`` (bytes that stay), ``n_bytes``, ``n_removed``, ``n_spans`` of every row.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id, by the input as it is. Texts are
    UTF-8 bytes (null: empty); a document of which another with a smaller doc_id holds the same text loses all of it (if it has 50
    bytes). Rows with a null doc_id lose nothing and repeat nothing; rows that share a doc_id are one document's. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.where("doc_id is not null")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [raw_of(t) for t in b.column(1).to_pylist()]
            digests = [hashlib.md5(r, usedforsecurity=False).digest() for r in raws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_id(r) for r in raws], pa.int64()), pa.array(digests, pa.binary()), pa.array(list(map(len, raws)), pa.int64())], names=["doc_id", "text_id", "digest", "size"])

    texts = cut(named.mapInArrow(names, "doc_id long, text_id long, digest binary, size long"))
    if buckets is None:
        held = texts.agg(F.sum("size")).first()[0] or 0
        buckets = max(LEAST_BUCKETS, held // BUCKET_BYTES)
    owners = cut(texts.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    every = F.lit(np.array([0, 1 << 60], np.int64).tobytes())
    copies = texts.join(owners, "digest").where("doc_id > owner").select("doc_id", "text_id", every.alias("ranges"))
    # what a copy holds, the owner of its text holds too: copies need not be searched
    copy = (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("digest")) & (F.col("doc_id") > F.col("owner"))
    with Scratch(spark) as keep:
        searched = keep(named.join(owners.select("digest", "owner"), copy, "left_anti"))
        marks = cut(copies.unionByName(repeated_starts(searched, buckets)).groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "ranges")).alias("marks")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                out = [cut_out(raw_of(t), m) for t, m in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(strip, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def cut_out(raw: bytes, marks: list[dict] | None) -> tuple[bytes, int, int, int]:
    n, mine = len(raw), text_id(raw) if marks else 0
    ranges = [np.frombuffer(m["ranges"], np.int64).reshape(-1, 2) for m in marks or [] if m["text_id"] == mine]
    if not ranges or n < LENGTH:
        return raw, n, 0, 0
    r = np.minimum(np.concatenate(ranges), n - LENGTH + 1)
    r = r[r[:, 0] < r[:, 1]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 1] + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), n, int(gone.sum()), spans


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
