"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from pairlens.llm import near_copies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows_of(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(14))
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 30, 60, 90, 150]))]
        rows.append((len(rows), " ".join(base) + (" " + line if i % 3 else "")))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (" " + line if i % 3 else "")))
    return [*rows, (900, None), (901, ""), (902, " \n"), (None, rows[0][1]), rows[1]]


@pytest.mark.parametrize("often", [2, 10**9])
def test_near_copies_match_brute_force(spark, often):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node long").repartition(3)
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            same, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if comp[a] != comp[b] and same >= 0.8 * every - 1e-9:
                comp = {i: min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for i, c in comp.items()}
    assert len(set(comp.values())) < 0.7 * len(comp)
    got = near_copies.near_copies(docs, often=often).collect()
    assert len(got) == len(rows) - 1 and {r.doc_id: r.component_id for r in got} == comp


def test_pipeline_stage_drops_near_copies(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120)]
    rows = [(1, " ".join(base))]
    for i in range(2, 6):
        copy = list(base)
        copy[20 * i], copy[20 * i - 7] = "new", "other"
        rows.append((i, " ".join(copy)))
    rows.append((9, " ".join(reversed(base))))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 9, None}
    assert stage(spark, docs.limit(0), "").count() == 0
