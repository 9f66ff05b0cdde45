"""Word windows, phrases and centroids against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import centroids, phrases, registry, word_windows

DOCS = "doc_id long, text string, lang string, n long, id long, key string, anchor long, place int, marks string, batch long"
MORE = (7, 7, "k", 7, 7, "m", 7)


def corpus():
    rng = random.Random(5)
    words = ["ka", "Lo", "mi", "tu", "ré", "x1", "--"]
    rows = []
    for i in range(40):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "\t", ". ", "\n", "\x0b"]) for x in w), rng.choice(["xx", "yy", None])))
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(100 + i, f"a{i} b{i} {passage} c{i} {passage[i:]}", "xx") for i in range(30)]
    rows += [(200, None, "xx"), (201, "", None), (202, rows[3][1], "yy"), (203, passage * 300, "xx"), (204, " ".join(rows[k][1] for k in range(30)) * 4, "yy")]
    rows += [(None, passage, "xx"), (None, None, None), rows[50], (100, passage + " other text of the same id", "xx"), (205, " ".join(["same"] * 3) + " ß" * 14, "xx")]
    return [(*r, *MORE) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def stripped(rows):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - 12):
            if i is not None:
                key = tuple(w[j : j + 13])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out.append((i, b" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"hot_pieces": 5}, {"hot_pieces": 0, "shard_words": 100}])
def test_windows_against_brute_force(docs, how):
    got = word_windows.strip_windows(docs, **how).collect()
    assert Counter((r.doc_id, bytes(r.kept), r.n_words, r.n_removed) for r in got) == stripped(corpus())
    assert sum(r.n_removed for r in got) > 500


def test_windows_of_an_empty_table(none):
    assert word_windows.strip_windows(none).count() == 0


def test_long_texts_are_cut_without_losing_a_window(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(900))
    whole = next(word_windows.anchored([text]))
    monkeypatch.setattr(word_windows, "UNIT_BYTES", 200)
    parts = list(zip(*word_windows.anchored([text])))
    first, many = np.concatenate(parts[3]), np.concatenate(parts[4])
    assert np.array_equal(np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(first, many)])), np.arange(888))
    assert {(a, p) for a, p in zip(whole[1], whole[2])} & {(a, p) for a, p in zip(np.concatenate(parts[1]), np.concatenate(parts[2]))}
    assert not any(len(x[0]) for x in word_windows.anchored([None, "", " \t ", "one two"]))


def test_automaton_tells_least_owners_of_any_text():
    rng = random.Random(2)
    for _ in range(30):
        pieces = [([rng.randint(0, 2) for _ in range(rng.randint(1, 25))], rng.randint(0, 9)) for _ in range(12)]
        built = word_windows.Automaton()
        for words, owner in pieces:
            built.add(words, owner)
        built.settle()
        asked = [rng.randint(0, 3) for _ in range(60)]
        for width in (2, 5, 13):
            want = [min((o for w, o in pieces if any(w[k : k + width] == asked[j : j + width] for k in range(len(w) - width + 1))), default=(1 << 63) - 1) for j in range(60 - width + 1)]
            assert built.owners(asked, width) == want


def mined(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        totals[lang] += 0
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang in totals:
        mine = {p: n for (x, p), n in counts.items() if x == lang and n >= least}
        rows = []
        for p, a in mine.items():
            inside = [n for q, n in mine.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * n >= 80 * a for n in inside):
                score, k = min((Fraction(2000000 * a, mine[p[:k]] + mine[p[k:]]).__floor__(), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "size"), [(2, 2000, 1 << 23), (3, 7, 1 << 23), (30, 5, 1 << 23)])
def test_phrases_against_brute_force(docs, least, top, size):
    got = phrases.collocations(docs, least=least, top=top, salts=3).collect()
    want = mined(corpus(), least, top)
    assert sorted(map(tuple, got)) == want and want


def test_phrases_of_tables_with_nothing_to_find(spark, docs, none):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_texts_are_cut_where_pieces_end():
    raw = b"ab cd\nef\n\ngh ij kl mn\nop"
    assert b"\n".join(phrases.stretches(raw, 4)) == raw and len(list(phrases.stretches(raw, 4))) == 3
    assert list(phrases.stretches(b"x" * 50, 4)) == [b"x" * 50]


def test_score_is_exact_beyond_64_bits(spark):
    sql = "(2000000 * cast(f as decimal(25,0))) div (cast(l as decimal(25,0)) + r)"
    a, left, right = 9 * 10**15, 9 * 10**17 + 1, 8 * 10**17
    assert spark.sql(f"select {sql} as x from values ({a}L, {left}L, {right}L) t(f, l, r)").first().x == 2000000 * a // (left + right)


VECTORS = "vec_id long, embedding array<double>, v string, n long, cluster int, inertia double, h string"


def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 8) for i in range(80)]
    rows += [(300, None), (301, []), (302, [0.1] * 7), (303, [0.1] * 7 + [None]), (304, [float("nan")] + [0.0] * 7), (305, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), rows[4], rows[4], (4, [-0.2] * 8)]
    return rows


def lloyd(rows, k, rounds):
    kept = [(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centres)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    by = Counter()
    for _, j, d in out:
        by[j] += d
    return sorted((i, j, d, by[j], sum(by.values()), list(centres[j])) for i, j, d in out)


@pytest.mark.parametrize("clusters", [1, 5, 16, 500])
def test_clusters_against_brute_force(spark, clusters):
    table = spark.createDataFrame([(*r, "v", 9, 9, 9.0, "h") for r in vectors()], VECTORS).repartition(4)
    got = centroids.clusters_of(table, clusters=clusters, dim=8).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in got) == lloyd(vectors(), clusters, 3)


def test_clusters_of_no_vectors(spark):
    assert centroids.clusters_of(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.clusters_of(spark.createDataFrame([(1, None, "v", 9, 9, 9.0, "h"), (2, [0.5], "v", 9, 9, 9.0, "h")], VECTORS)).count() == 0


@pytest.mark.parametrize("name", ["op11_word_windows", "op12_phrases", "op13_centroids"])
def test_queries_match_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
