"""Windows of recordings against a plain version, and the join of samples against comparing all."""

import random

import pytest

from pairlens.operators import windows


def plain(events, recordings, most, clip, fixed):
    out = []
    for rec, end, usual in recordings:
        mine = sorted(((o or 0.0, d or 0.0, c or "nan", i) for r, o, d, c, i in events if r == rec), key=lambda e: (e[0], e[3]))
        mine = [e for e in mine if e[1] > 0 and 0 <= e[0] < end]
        good = [e for e in mine if not e[2].lower().startswith("bad")]
        hinted = [e for e in good if usual and usual != "unknown" and usual.lower() in e[2].lower()]
        for o, d, c, _ in (hinted or good or mine)[:most]:
            out.append((rec, o, d if clip is None else min(d, clip), c, "events"))
        length = max(0.0, end if clip is None else min(end, clip))
        if not mine and length > 0:
            n = max(1, int(length // max(1.0, fixed)))
            for k in range(n if most is None else min(n, most)):
                at = k * max(1.0, fixed)
                if at < length:
                    out.append((rec, at, min(max(1.0, fixed), length - at), "unknown" if usual is None else usual, windows.FALLBACK))
    return sorted(out)


@pytest.mark.parametrize(("most", "clip", "fixed"), [(None, None, 10.0), (3, 4.0, 0.2), (2, None, 7.0)])
def test_windows_against_a_plain_version(spark, most, clip, fixed):
    rng = random.Random(1)
    recordings = [(i, rng.choice([0.0, 5.0, 33.0, 100.0, -2.0]), rng.choice([None, "unknown", "move", "", "Rest"])) for i in range(60)]
    events = [(rng.randint(0, 40), rng.choice([None, -1.0, 0.0, 2.5, 8.0, 50.0]), rng.choice([None, 0.0, 1.0, 9.0]), rng.choice(["BAD seg", "move_left", "MOVE", "rest", None, "bad"]), k) for k in range(150)]
    e = spark.createDataFrame([(*x, "extra") for x in events], "recording long, onset double, duration double, condition string, event_id long, default_condition string").repartition(3)
    r = spark.createDataFrame([(*x, "extra") for x in recordings], "recording long, duration double, default_condition string, condition string")
    got = windows.event_windows(e, r, max_windows=most, max_duration=clip, fixed=fixed, order=("onset", "event_id"))
    assert sorted(map(tuple, got.collect())) == plain(events, recordings, most, clip, fixed)
    assert windows.event_windows(e.limit(0), r.limit(0)).count() == 0


def test_samples_meet_the_windows_that_hold_them(spark):
    rng = random.Random(2)
    held = [(rng.randint(0, 3), rng.uniform(0, 50), rng.choice([0.5, 3.0, 25.0])) for _ in range(40)]
    samples = [(rng.randint(0, 4), rng.uniform(-5, 90)) for _ in range(300)] + [(held[0][0], held[0][1]), (held[1][0], held[1][1] + held[1][2])]
    got = windows.in_windows(spark.createDataFrame(samples, "recording long, at double").repartition(3), spark.createDataFrame(held, "recording long, onset double, duration double"), 4.0)
    want = sorted((r, t, o, d) for r, t in samples for w, o, d in held if r == w and o <= t < o + d)
    assert sorted((x.recording, x["at"], x.onset, x.duration) for x in got.collect()) == want and want
