"""Token counts that follow edits: segment trees over pre-tokens."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import add_columns, table
from pairlens.llm.orc_tokens import vocabulary

LEAF = 64
#: What the query's edits replace: addresses of mail and network, telephone numbers.
_BEFORE = regex.compile(r"(?r)[\w.+-]+")
_AFTER = regex.compile(r"[\w-]+(?:\.[\w-]+)+")
_DIGITS = regex.compile(r"\d")
_NUMBERS = regex.compile(r"(?P<ip>(?<!\w)\d{1,3}(?:\.\d{1,3}){3}(?!\w))|(?P<phone>\+?\d[\d ()./-]{6,}\d)")


class Counter:
    """Tokens of a pre-token by the tokenizers library, with a memory of ``limit`` pre-tokens that is emptied when full."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        new = [p for p in set(pieces) if p not in self.known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.known.update(zip(part, [len(e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]))

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        if None in found:
            self.learn([p for p, n in zip(pieces, found) if n is None])
            found = [self.known[p] for p in pieces]
        return found


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class TokenTree:
    """A document's pre-tokens in leaves of up to about ``LEAF``, with sums of characters and tokens in every node above them.

    ``replace`` re-encodes only what an edit touches: from the last pre-token boundary at least two characters before it (a
    boundary depends on up to two characters that follow) to the first boundary behind it that the old text has too; pre-tokens
    after that are the same, as the pattern looks only ahead. The leaves touched are joined in the first of them and the sums on
    their paths are renewed.
    """

    def __init__(self, text: str, counts: Counter):
        self.counter, self.reencoded = counts, 0
        pieces = counts.pattern.findall(text)
        tokens = counts.counts(pieces)
        self.leaves = [(pieces[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, t) in enumerate(self.leaves):
            self.chars[self.size + i], self.sums[self.size + i] = sum(map(len, p)), sum(t)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def __len__(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join("".join(p) for p, _ in self.leaves)

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """Leaf that holds a character (the last one that isn't empty if there is none), and where the leaf begins."""
        i, start = 1, 0
        pos = max(0, min(pos, self.chars[1] - 1))
        while i < self.size:
            i *= 2
            if pos - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def replace(self, start: int, end: int, new: str) -> None:
        first, at = self.leaf_at(max(0, start - 2))
        pieces, tokens = self.leaves[first]
        ends, pos = [], at
        for p in pieces:
            pos += len(p)
            ends.append(pos)
        kept = bisect_right(ends, start - 2)
        begin = ends[kept - 1] if kept else at
        # a boundary at the leaf's begin depends on the leaf's own characters up to two later
        while not kept and begin > max(0, start - 2) and first:
            first, at = self.leaf_at(begin - 1)
            pieces, tokens = self.leaves[first]
            ends, pos = [], at
            for p in pieces:
                pos += len(p)
                ends.append(pos)
            kept = bisect_right(ends, start - 2)
            begin = ends[kept - 1] if kept else at
        old, old_tokens, last, pos = list(pieces[kept:]), list(tokens[kept:]), first, ends[-1] if ends else at
        while True:
            while pos < end + 2 and last + 1 < len(self.leaves):
                last += 1
                old += self.leaves[last][0]
                old_tokens += self.leaves[last][1]
                pos += self.chars[self.size + last]
            body = "".join(old)
            changed = body[: start - begin] + new + body[end - begin :]
            shift = len(new) - (end - start)
            borders, x = {}, begin
            for i, p in enumerate(old):
                if x >= end:
                    borders[x + shift] = i
                x += len(p)
            fresh, x, rest = [], begin, None
            for m in self.counter.pattern.finditer(changed):
                if x >= start + len(new) and x in borders:
                    rest = borders[x]
                    break
                fresh.append(m[0])
                x += len(m[0])
            if rest is not None or last + 1 >= len(self.leaves):
                break
            end_was = pos
            last += 1
            old += self.leaves[last][0]
            old_tokens += self.leaves[last][1]
            pos = end_was + self.chars[self.size + last]
        rest = len(old) if rest is None else rest
        self.reencoded += len(fresh)
        self.leaves[first] = (pieces[:kept] + fresh + old[rest:], tokens[:kept] + self.counter.counts(fresh) + old_tokens[rest:])
        for i in range(first, last + 1):
            if i > first:
                self.leaves[i] = ([], [])
            p, t = self.leaves[i]
            self.chars[self.size + i], self.sums[self.size + i] = sum(map(len, p)), sum(t)
        nodes = {(self.size + i) // 2 for i in range(first, last + 1)} - {0}
        while nodes:
            for i in nodes:
                self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]
            nodes = {i // 2 for i in nodes} - {0}


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits, by rising place in the text: personal data become typed placeholders."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        before, after = _BEFORE.match(text, done, at), _AFTER.match(text, at + 1)  # the former from the sign backwards
        if before and after:
            done = after.end()
            found.append((before.start(), done, "[mail]"))
        at = text.find("@", after.end() if after else at + 1)
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), f"[{m.lastgroup}]") for m in _NUMBERS.finditer(text)]
    out, end = [], 0
    for edit in sorted(found):
        if edit[0] >= end:
            out.append(edit)
            end = edit[1]
    return out


def edited_counts(docs: DataFrame, edits=redactions, vocab: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_edits``, ``n_tokens_after``, ``n_reencoded`` of every row.

    ``edits``: whole text -> edits (start, end, new text) that don't overlap, by rising start, in places of the unedited text. The
    counts are those of the whole texts before and after; ``n_reencoded`` counts the pre-tokens that the edits made anew. Strings
    of special tokens count as ordinary text. Null and empty texts have no tokens; repeated rows come out repeated; other columns
    are ignored.
    """
    vocab = vocab or vocabulary()

    def run(texts: list) -> tuple[pa.Array, ...]:
        count, out = counter(vocab), []
        for text in texts:
            tree = TokenTree(text or "", count)
            before, shift, todo = len(tree), 0, edits(text or "")
            for start, end, new in todo:
                tree.replace(start + shift, end + shift, new)
                shift += len(new) - (end - start)
            out.append((before, len(todo), len(tree), tree.reencoded))
        return tuple(pa.array([x[i] for x in out], pa.int64()) for i in range(4))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return add_columns(rows, "text", run, "n_tokens long, n_edits long, n_tokens_after long, n_reencoded long").drop("text")


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))
