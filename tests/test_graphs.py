"""Huber lines, Laplacian spectra and signed paths against plain versions."""

from collections import deque

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import graphs, robust


def huber(x, y, rounds=4000):
    z = (x - x.mean()) / x.std()
    w, b, s = 0.0, np.median(y), y.std()
    for _ in range(rounds):
        r = y - w * z - b
        out = np.abs(r) > 1.35 * s
        k = np.where(out, 1.35 * s / np.maximum(np.abs(r), 1e-300), 1.0)
        w, b = np.linalg.solve([[(k * z * z).sum() + 1e-4 * s, (k * z).sum()], [(k * z).sum(), k.sum()]], [(k * z * y).sum(), (k * y).sum()])
        r = y - w * z - b
        left = len(y) - 1.35**2 * out.sum()
        s = np.sqrt((r[~out] ** 2).sum() / left) if left > 0 else 2 * s
    return w, b


def test_huber_lines_equal_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for g in range(6):
        x = rng.normal(5, 2, 40 + 30 * g)
        y = 3 * x + rng.normal(0, 1, len(x))
        y[: 4 + g] += 60
        groups[f"g{g}"] = (x, y)
    groups["line"] = (np.arange(10.0), 2 * np.arange(10.0) + 1)
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    rows += [("few", float(i), float(i)) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(9)] + [("same", float(i), 2.0) for i in range(9)] + [("g0", None, 1.0), ("g0", 2.0, float("nan"))]
    got = robust.huber_slopes(spark.createDataFrame(rows, "who string, x double, y double").repartition(4), ["who"], "x", "y").toPandas().set_index("who")
    assert set(got.index[got.status != "ok"]) == {"few", "flat", "same"} and got.n["few"] == 5
    for g in range(6):
        assert np.allclose([got.slope[f"g{g}"], got.intercept[f"g{g}"]], huber(*groups[f"g{g}"]), rtol=1e-7)
    assert np.allclose([got.slope["line"], got.intercept["line"]], [2 * np.arange(10.0).std(), 10.0])
    assert robust.huber_slopes(spark.createDataFrame([], "who string, x double, y double"), ["who"], "x", "y").count() == 0


def test_laplacian_spectra_and_their_distance(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(4):
        a = np.triu(rng.integers(0, 4, (6, 6)), 1)
        want[g] = np.linalg.eigvalsh(np.diag((a + a.T).sum(axis=1)) - a - a.T)
        rows += [(g, f"n{i}" if rng.random() < 0.5 else f"n{j}", None, float(a[i, j]) / 2, i, j) for i in range(6) for j in range(i + 1, 6) for _ in range(2) if a[i, j]]
    edges = spark.createDataFrame([(g, f"n{i}", f"n{j}", w) if k % 2 else (g, f"n{j}", f"n{i}", w) for k, (g, _, _, w, i, j) in enumerate(rows)] + [(0, "n1", "n1", 5.0), (0, None, "n1", 5.0)], "g int, a string, b string, weight double").repartition(3)
    got = graphs.laplacian_spectra(edges, "g")
    by = {g: d.sort_values("i").eigenvalue.to_numpy() for g, d in got.toPandas().groupby("g")}
    for g in want:
        assert np.allclose(by[g], want[g][-len(by[g]) :], atol=1e-9)
    few = graphs.laplacian_spectra(edges, "g", 3)
    gap = graphs.spectral_deviation(few, few, "g").toPandas().set_index(["left", "right"]).deviation
    assert len(gap) == 16 and np.isclose(gap[0, 1], np.sqrt(((by[0][:3] - by[1][:3]) ** 2).mean())) and gap[2, 2] == 0


def shortest(edges, a, b):
    near = {}
    for lo, hi in edges:
        near.setdefault(lo, []).append((hi, (lo, hi, 1)))
        near.setdefault(hi, []).append((lo, (lo, hi, -1)))
    queue, seen = deque([(a, [])]), {a}
    while queue:
        node, path = queue.popleft()
        if node == b:
            return path
        for nxt, edge in near.get(node, []):
            if nxt not in seen:
                seen.add(nxt)
                queue.append((nxt, [*path, edge]))
    return None


def test_paths_and_signals_along_them(spark):
    rng = np.random.default_rng(7)
    edges, targets, signals, rows = {}, [], [], {}
    for r in range(8):
        mine = sorted({tuple(sorted(rng.choice(7, 2, replace=False).tolist())) for _ in range(7)}, key=lambda _: rng.random())
        edges[r] = mine
        targets += [(r, a, b) for a in range(7) for b in range(a + 1, 7)]
        contacts = rng.normal(0, 1, (7, 200))
        rows[r] = contacts
        for lo, hi in mine:
            n = 200 if (lo + hi) % 3 else 150 if r else 40
            signals += [(r, lo, hi, i, float(contacts[lo, i] - contacts[hi, i])) for i in range(n)]
    e = spark.createDataFrame([(r, lo, hi, k) for r, m in edges.items() for k, (lo, hi) in enumerate(m)], "recording int, lo int, hi int, at int")
    paths = graphs.edge_paths(e, spark.createDataFrame(targets, "recording int, a int, b int"))
    found = {(p.recording, p.a, p.b): [tuple(x) for x in p.path] for p in paths.collect()}
    want = {t: shortest(edges[t[0]], t[1], t[2]) for t in targets}
    assert found == {t: p for t, p in want.items() if p}
    values, source = graphs.reconstructed(spark.createDataFrame(signals, "recording int, lo int, hi int, n int, value double"), paths)
    source = {(s.recording, s.a, s.b): s for s in source.collect()}
    assert set(source) == set(found) and all(s.path_length == len(found[k]) for k, s in source.items())
    got = values.toPandas()
    assert set(map(tuple, got[["recording", "a", "b"]].drop_duplicates().values.tolist())) == {k for k, s in source.items() if s.mode == "bipolar_path_sum"}
    for (r, a, b), g in got.groupby(["recording", "a", "b"]):
        assert np.allclose(g.value, (rows[r][a] - rows[r][b])[g.n]) and len(g) >= 128
    assert any(s.mode == "bipolar_path_too_short" for s in source.values())
