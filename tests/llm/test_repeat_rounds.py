"""Repeated strings: even use of the bitmap and of the buckets, and rounds over shares of the grams."""

import random

import numpy as np
import pytest

from pairlens.llm import suffix_dedup


def test_gram_names_spread_over_all_leading_bits():
    rng = random.Random(4)
    names = suffix_dedup.anchors(rng.randbytes(60_000))[0]
    parts = np.bincount((names >> np.uint64(61)).astype(np.int64), minlength=8) / len(names)
    assert len(names) > 3000 and parts.min() > 0.1 and parts.max() < 0.15


@pytest.mark.parametrize("rounds", [1, 3, suffix_dedup.ROUNDS])
def test_rounds_find_the_same_strings(spark, rounds):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 160))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(6))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {i: set() for i, _ in rows}
    for r in suffix_dedup.repeated_starts(docs, 8, rounds=rounds).collect():
        for low, high in np.frombuffer(r.ranges, np.int64).reshape(-1, 2).tolist():
            got[r.doc_id].update(range(low, high))
    seen = set()
    for i, t in rows:
        own = [t[k : k + suffix_dedup.LENGTH] for k in range(len(t) - suffix_dedup.LENGTH + 1)]
        assert got[i] == {k for k, x in enumerate(own) if x in seen}
        seen.update(own)
