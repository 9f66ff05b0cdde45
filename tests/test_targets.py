"""Target rankings and reliability scores against plain versions that write every context and every missing rank out."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import targets as T

SCHEMA = "subject string, task string, medication string, quality string, feature string, value double"


def cohort(seed=2):
    rng = np.random.default_rng(seed)
    features, rows = [f"f{i:02d}" for i in range(13)], []
    for s in range(6):
        for task in ("HoldL", "HoldR", "MoveL", "MoveR", "Rest"):
            quality = ["good", "caution", "low_quality", None][int(rng.integers(4))]
            for m in ("off", "on"):
                if rng.random() < 0.85:
                    rows += [(f"s{s}", task, m, quality, f, float(np.round(rng.normal(i % 4, 1), 3))) for i, f in enumerate(features) if rng.random() < 0.8]
    rows += [("s0", "HoldL", "off", "good", "f01", None), ("s1", "HoldL", "on", "good", "f01", float("nan")), ("s2", "MoveR", "unknown", "good", "f02", 900.0), ("s3", "Rest", "off", "good", "f03", float("inf"))]
    return rows


NODES = {f"f{i:02d}": ("STN" if i % 5 == 0 else "M1", T.EDGE if i % 3 == 0 else "node_band_modulation") for i in range(12)}


def plain_rank(states):
    """(feature, objective, gain, effect, uncertainty, stability) in order, of a frame of states."""
    kept = states[np.isfinite(states.value.astype(float)) & states.medication.isin(["off", "on"])]
    off, on = (kept[kept.medication == m] for m in ("off", "on"))
    off, reference = (kept if off.empty else off), (kept if on.empty else on)
    scale_rows = on if len(on) and on.groupby("feature").size().max() > 1 else kept
    cur, tgt, sd = off.groupby("feature").value.mean(), reference.groupby("feature").value.mean(), scale_rows.groupby("feature").value.std()
    names = sorted(set(cur.index) & set(tgt.index))
    scale = np.array([max(0.1, 0 if f not in sd or np.isnan(sd[f]) else sd[f]) for f in names])
    a, b = np.array([cur[f] for f in names]), np.array([tgt[f] for f in names])
    out = []
    for i, f in enumerate(names):
        node, kind = NODES.get(f, ("", ""))
        moved = a.copy()
        moved[i] += 0.6 * (b[i] - a[i])
        before, post = (np.sqrt(np.mean(((x - b) / scale) ** 2)) for x in (a, moved))
        e = 0.6 * (b[i] - a[i])
        risk = 0.25 + 0.35 * (node == "STN") + 0.1 * (kind == T.EDGE)
        stable = 1 / (1 + abs(e))
        objective = post + 0.15 * e * e + 0.25 * risk + 0.1 * (0.45 if kind == T.EDGE else 0.25) - 0.2 * stable
        out.append((round(objective, 9), -round(before - post, 9), f, e, 0.05 + 0.05 * abs(e) + 0.1 * risk, stable))
    return [(f, o, -g, e, u, s) for o, g, f, e, u, s in sorted(out)]


def contexts(df):
    for context, rows in {"overall:all_recordings": df, "quality:exclude_low_quality": df[df.quality.ne("low_quality")], "quality:good_only": df[df.quality.eq("good")], "sideaware:left_side": df[df.task.isin(["HoldL", "MoveL"])],
                          "sideaware:right_side": df[df.task.isin(["HoldR", "MoveR"])], "sideaware:hold_family": df[df.task.str.startswith("Hold")], "sideaware:move_family": df[df.task.str.startswith("Move")]}.items():
        yield context, rows
    for t, rows in df.groupby("task"):
        if t in T.TASKS:
            yield f"task:{t}", rows
        if t != "Rest":
            yield f"sideaware:{t}", rows
        for s, own in rows.groupby("subject"):
            yield f"subject_task:{t}:{s}", own


@pytest.fixture(scope="module")
def study(spark):
    rows = cohort()
    states = spark.createDataFrame(rows, SCHEMA).repartition(5)
    descriptors = spark.createDataFrame([(f, n, k) for f, (n, k) in NODES.items()], "feature string, node string, target_type string")
    return pd.DataFrame(rows, columns=["subject", "task", "medication", "quality", "feature", "value"]), states, descriptors


def test_rankings_of_contexts_equal_plain_ones(study):
    df, states, descriptors = study
    got = T.rank_targets(states, descriptors).toPandas()
    want = {c: w for c, rows in contexts(df) if (w := plain_rank(rows))}
    mine = {c: rows.sort_values("rank") for c, rows in got.groupby("rank_context")}
    assert set(mine) == set(want)
    for c, rows in mine.items():
        assert list(rows.feature) == [w[0] for w in want[c]], c
        assert np.allclose(rows[["objective", "expected_delta_deviation", "effect_size", "uncertainty", "stability_estimate"]], [w[1:] for w in want[c]], atol=1e-7)
    one = got[got.rank_context == "sideaware:HoldR"].iloc[0]
    assert (one.side_context, one.family_context, one.task_context, one.subject_context) == ("R", "Hold", "Hold", "")


def test_rankings_without_subjects_are_refits(study):
    df, states, descriptors = study
    got = T.rank_without_subjects(states, descriptors)
    frame = got.toPandas()
    full = plain_rank(df)
    stability = T.left_out_stability(got).toPandas().set_index("removed_subject")
    assert len(stability) == 6
    for s, rows in frame.groupby(frame.removed_subject.fillna("nobody")):
        want = plain_rank(df[df.subject != s])
        rows = rows.sort_values("rank")
        assert list(rows.feature) == [w[0] for w in want] and np.allclose(rows.objective, [w[1] for w in want], atol=1e-7)
        if s != "nobody":
            names = [w[0] for w in want]
            assert stability.top10_overlap[s] == len({w[0] for w in full[:10]} & set(names[:10])) and stability.full_top1_shift[s] == names.index(full[0][0])
            assert stability.top1_feature[s] == names[0] and stability.full_top1_stays[s] == (names.index(full[0][0]) < 10)


def plain_scores(ranks, sources, features, only=None, base=None, n_subjects=6):
    every = ranks[ranks.rank_source.isin(sources)]
    seen = every if only is None else every[only(every)]
    gone = max(int(every["rank"].max()), len(features)) + 1
    whole = [(c, f) for c in seen.rank_context.unique() for f in features]
    data = pd.DataFrame(whole, columns=["rank_context", "feature"]).merge(seen, on=["rank_context", "feature"], how="left")
    data["rank_source"] = data.rank_context.str.split(":").str[0]
    data["rank"] = data["rank"].fillna(gone)
    most = max(int(data["rank"].max()), len(features))
    out = {}
    for f, t in data.groupby("feature"):
        top = t[t["rank"] <= 10]
        quality = top[top.rank_source == "quality"].rank_context
        has = lambda c, v: float((top[c] == v).any())
        out[f] = {
            "top10_frequency": len(top) / len(t), "mean_rank": t["rank"].mean(), "median_rank": t["rank"].median(), "rank_sd": t["rank"].std(ddof=0), "rank_score": min(max(1 - (t["rank"].mean() - 1) / max(1, most - 1), 0), 1),
            "n_subjects": top[top.rank_source == "subject_task"].subject_context.nunique(), "n_tasks": len(set(top.task_context) & {"HoldL", "MoveL"}), "quality_survival": 0.5 * quality.str.contains("exclude_").any() + 0.5 * quality.str.contains("good_only").any(),
            "mean_uncertainty": t.uncertainty.mean(), "stability": t.stability_estimate.mean(), "side_coverage": (has("side_context", "L") + has("side_context", "R")) / 2, "family_coverage": (has("family_context", "Hold") + has("family_context", "Move")) / 2,
        }
    low, high = min(v["mean_uncertainty"] for v in out.values() if v["mean_uncertainty"] == v["mean_uncertainty"]), max(v["mean_uncertainty"] for v in out.values() if v["mean_uncertainty"] == v["mean_uncertainty"])
    for f, v in out.items():
        u = v["mean_uncertainty"]
        v["uncertainty_score"] = 0.5 if u != u or np.isclose(high, low) else 1 - (u - low) / (high - low)
        v["stability"] = 0.5 if v["stability"] != v["stability"] else min(max(v["stability"], 0), 1)
        common = 0.15 * v["rank_score"] + 0.15 * v["quality_survival"] + 0.1 * v["uncertainty_score"] + 0.1 * v["stability"]
        if base is None:
            v["score"] = 0.25 * v["top10_frequency"] + 0.15 * v["n_subjects"] / n_subjects + 0.1 * v["n_tasks"] / 2 + common
        else:
            v["score"] = 0.2 * v["top10_frequency"] + 0.1 * base[f]["n_subjects"] / n_subjects + 0.1 * v["side_coverage"] + 0.1 * v["family_coverage"] + common
    return out


def same(got, want, score, columns):
    got = got.toPandas().set_index("feature")
    assert set(got.index) == set(want)
    for f, v in want.items():
        assert np.allclose([got[c][f] for c in columns], [v[c] for c in columns]), f
        assert np.isclose(got[score][f], v["score"]), f


def test_reliability_scores_equal_written_out_ones(study):
    _, states, descriptors = study
    from pairlens.sources.cache import checkpointed

    ranks = checkpointed(T.rank_targets(states, descriptors))
    frame = ranks.toPandas()
    known = descriptors.select("feature").union(descriptors.sparkSession.createDataFrame([("never",)], "feature string"))
    features = sorted({*NODES, "never", *frame.feature})
    shared = ["top10_frequency", "mean_rank", "median_rank", "rank_sd", "rank_score", "quality_survival", "uncertainty_score", "stability"]
    base = T.reliability(ranks, 6, known=known)
    want = plain_scores(frame, T.BASE_SOURCES, features)
    same(base, want, "reliability_score", [*shared, "n_subjects", "n_tasks"])
    same(T.reliability(ranks, 6, known=known, task="HoldL"), plain_scores(frame, T.BASE_SOURCES, features, lambda r: (r.task_context == "HoldL") | (r.rank_source == "quality")), "reliability_score", [*shared, "n_subjects", "n_tasks"])
    side = T.sideaware_reliability(ranks, base, known)
    same(side, plain_scores(frame, T.SIDE_SOURCES, features, base=want), "sideaware_reliability_score", [*shared, "side_coverage", "family_coverage"])
    left = frame[(frame.side_context == "L") | (frame.rank_source == "quality")]
    same(T.sideaware_reliability(ranks, base, known, side="L"), plain_scores(left, T.SIDE_SOURCES, features, base=want), "sideaware_reliability_score", shared)
    weights = {r["feature"]: r["weight"] for r in T.reliability_weights(base, side).collect()}
    mine = {f: (want[f]["score"] + v["score"]) / 2 for f, v in plain_scores(frame, T.SIDE_SOURCES, features, base=want).items()}
    assert all(np.isclose(weights[f], min(max(m / max(mine.values()), 0.05), 1)) for f, m in mine.items())


def test_targets_of_nothing(spark, study):
    none, descriptors = spark.createDataFrame([], SCHEMA), study[2]
    ranks = T.rank_targets(none, descriptors)
    base = T.reliability(ranks, 0)
    assert ranks.count() == 0 and base.count() == 0 and T.sideaware_reliability(ranks, base).count() == 0
    assert T.left_out_stability(T.rank_without_subjects(none, descriptors)).count() == 0
