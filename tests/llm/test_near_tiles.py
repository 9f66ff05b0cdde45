"""Near copies by tiles of SimHashes: every pair of tiles, groups in parts, and links that chain."""

import random

import numpy as np
import pytest

from pairlens.llm import near_copies


def fingerprints(seed, n):
    rng = random.Random(seed)
    bases = [rng.getrandbits(256) for _ in range(8)]
    out = []
    for _ in range(n):
        p = rng.choice(bases)
        for _ in range(rng.randint(0, 60)):
            p ^= 1 << rng.randrange(256)
        out.append((rng.randint(20, 60), [int(x) for x in np.frombuffer(p.to_bytes(32, "little"), np.int64)]))
    return out


def joined(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("tile", [3, 1000])
def test_tiles_join_all_close_fingerprints(spark, tile):
    rows = fingerprints(3, 150)
    bits = [int.from_bytes(np.array(p, np.int64).tobytes(), "little") for _, p in rows]
    first = (1 << 128) - 1
    want = [(i, j) for i in range(150) for j in range(i) if min(rows[i][0], rows[j][0]) >= 0.8 * max(rows[i][0], rows[j][0]) - 1e-9 and (bits[i] ^ bits[j]).bit_count() <= 40 and ((bits[i] ^ bits[j]) & first).bit_count() <= 40]
    sets = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rows)], "node long, n int, print array<long>")
    got = [(r.a, r.b) for r in near_copies.close_prints(sets, 0.8, 40, tile).collect()]
    assert joined(150, got) == joined(150, want) and 20 < len(set(joined(150, want))) < 140


def test_strips_do_not_change_the_links():
    rows = sorted(fingerprints(5, 120), key=lambda r: r[0])
    n, prints = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).view(np.uint64)
    label = lambda cells: joined(120, zip(*(x.tolist() for x in near_copies.close(prints, prints, n, n, 0.8, 50, True, cells))))
    assert label(1) == label(700) == label(1 << 17)
    both = lambda cells: joined(120, zip(*(x.tolist() for x in near_copies.close(prints[:50], prints[50:], n[:50], n[50:], 0.8, 50, False, cells))))
    assert both(1) == both(700) == both(1 << 17)


@pytest.mark.parametrize("part", [3, 1000])
def test_a_large_group_links_as_brute_force_does(spark, part):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(60):  # some pairs reach 0.8, others only come close
        copy = list(base)
        for k in range(rng.randint(0, 5)):
            copy[rng.randrange(90)] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(86)} for _, t in rows]
    want = joined(60, [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, part=part).collect()}
    assert [got[i] for i in range(60)] == want and len(set(want)) > 3
