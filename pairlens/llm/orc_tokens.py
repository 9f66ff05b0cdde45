"""Token ids in ORC files: encode, write in id order, read back."""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import cut, give_back, shared_dir, table

END_ID = 2
WORDS = 480_000
#: White space other than a lone blank or line feed: such texts go to the library whole.
_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", "\n\n", " \n", "\n ", "<|")
#: The byte-level alphabet: bytes that are no printable Latin-1 character stand as the code points from 256 on, in order.
_ALPHABET = {x: 256 + i for i, x in enumerate(x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or 174 <= x))}
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder(dict):
    """Ids of whole texts, little-endian unsigned 32-bit, by the tokenizers library with a memory of words.

    The byte-level pattern always starts a new piece before a blank or line feed that stands between other characters, so a text
    whose white space is all of that kind is the sequence of its words, each encoded with its blank; other texts go through the
    library whole. This is the memory itself: words as they stand behind a blank (or, if they begin with a line feed, behind that)
    -> ids. A word of Latin letters, with at most one mark of punctuation behind it, is one piece (and one for the mark) that the
    library's model takes directly; other words go through the library. Words are remembered from their second time on, which a
    filter of fixed size tells, as most new words never come again. At ``limit`` words the memory becomes the older one, from which
    words that come again are taken over, and the one before it goes.
    """

    def __init__(self, path: str, limit: int = WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.tokenize = self.library.model.tokenize
        self.seen, self.older = bytearray(1 << 22), {}
        self.feed = self.whole("\n")
        self.marks = {c: self.whole(c) for c in ",.;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        mark = self.marks.get(word[-1:])
        bare = word if mark is None else word[:-1]
        line = bare[:1] == "\n"
        if line:
            bare = bare[1:]
        if bare.isalpha() and (bare.isascii() or max(bare) < "\u0250"):
            piece = bare if bare.isascii() else bare.encode().decode("latin-1").translate(_ALPHABET)
            ids = array("I", [t.id for t in self.tokenize(piece if line else "\u0120" + piece)]).tobytes()
            ids = (self.feed + ids if line else ids) + (mark or b"")
        else:
            ids = self.whole(word if word[:1] == "\n" else " " + word)
        at = hash(word) & 0x3FFFFF
        if self.seen[at]:
            self[word] = ids
        else:
            self.seen[at] = 1
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.__getitem__
        for t in texts:
            if odd(t) or t[:1] == " ":
                out.append(self.whole(t))
            else:
                # the text's first word has neither blank nor line feed before it: it is looked up as a line's first, less that feed
                out.append(b"".join(map(get, ("\n" + t.replace("\n", " \n")).split(" ")))[len(self.feed) :])
            if len(self) > self.limit:
                self.older = dict(self)
                self.clear()
                self.seen = bytearray(len(self.seen))
        return out


def odd(text: str) -> bool:
    return any(x in text for x in _RUNS) or any(x in text for x in _BLANKS)


def encoder(path: str, limit: int) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, vocab: str, end_id: int = END_ID, words: int = WORDS) -> None:
    """Encodes every row's text (null: empty), appends ``end_id``, and writes ORC in ascending order of doc_id.

    Columns: ``part`` (the range of ids that a file holds; ascending), ``doc_id``, ``ids``, ``before`` (ids of earlier rows of the
    part), ``n_ids``. Null doc_ids come first; rows that share one are ordered by text. Integers are run-length encoded, every 1,000 rows have
    an index entry with least and greatest doc_id and a Bloom filter, and stripes are small enough to be read in parallel. Rows are
    dealt by ranges of doc_id, so no task holds more than its range. A worker remembers the ids of up to twice ``words`` words (some
    170 bytes each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, before = encoder(vocab, words), np.array([end_id], "<u4").tobytes(), 0
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                found = [x + end for x in enc.encode([t or "" for t in some.column(2).to_pylist()])]
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), ids, pa.array(before + ends[:-1]), pa.array(sizes)], names=["part", "doc_id", "ids", "before", "n_ids"])
                before += int(ends[-1])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    (
        rows.mapInArrow(run, "part int, doc_id long, ids array<int>, before long, n_ids long").write
        .option("compression", "zstd").option("orc.stripe.size", str(16 << 20)).option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` from files of ``write_ids``.

    Only a row per part (as many as files) is gathered to add up where each part starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            ends, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crcs = [zlib.crc32(flat[4 * int(i) : 4 * int(j)]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.orc(path)
    rows = files.select("part", "doc_id", "ids", "before").mapInArrow(run, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sizes = cut(files.groupBy("part").agg(F.sum("n_ids").alias("total")))
    first = sizes.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id``, ``ids`` of the named documents; indexes and Bloom filters let readers skip most stripes."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def encode_documents(spark: SparkSession, docs: DataFrame, vocab: str | None = None, words: int = WORDS) -> DataFrame:
    """Writes the documents' ids to a new folder in the shared one and returns what ``read_ids`` finds there.

    Every row comes out once: null and empty texts hold the end id alone, repeated rows come out repeated, an empty table gives no
    rows. Other columns are ignored.
    """
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocab or vocabulary(), words=words)
    return read_ids(spark, path)


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents' ids; workers of earlier stages leave less room for words."""
    return encode_documents(spark, docs, words=WORDS // 2)
