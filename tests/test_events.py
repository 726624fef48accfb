"""Track events against plain restatements on random tracks."""

import random

import pytest

from kerbline.operators import events as E
from kerbline.operators import metrics as G

SCHEMA = "video_id string, start_time int, row_idx long, yolo_id int, x double, y double, height double, unique_id long"
SEGMENTS = "video_id string, start_time int, country string, time_of_day int, fps double, avg_height double, duration int, id long"


def tracks(seed, n=60, longest=150):
    rng = random.Random(seed)
    rows, k = [], 0
    for t in range(n):
        x = rng.choice([0.1, 0.3, 0.49, 0.5, 0.8])
        for _ in range(rng.randint(1, longest)):
            x = x if rng.random() < 0.85 else rng.randint(0, 100) / 100
            rows.append((f"v{t % 3}", 0, k, 0 if rng.random() < 0.9 else 9, x, 0.5, rng.choice([0.0, 0.25, 0.5]) if t % 7 == 0 else 0.25, t if rng.random() < 0.97 else None))
            k += 1
    return rows


def frames(spark, rows):
    segs = [(f"v{i}", 0, f"c{i % 2}", i % 2, 30.0 if i else 25.0, 170.0, 60 + i, i) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(segs, SEGMENTS)


def by_track(rows, person=False):
    out = {}
    for r in rows:
        if r[7] is not None and (not person or r[3] == 0):
            out.setdefault((r[0], r[7]), []).append(r)
    return out


def test_crossings_and_their_time(spark):
    rows = tracks(1)
    det, seg = frames(spark, rows)
    fps = {"v0": 25.0, "v1": 30.0, "v2": 30.0}
    crossed = {k for k, t in by_track(rows, True).items() if min(r[4] for r in t) <= 0.3 and max(r[4] for r in t) >= 0.6}
    got = E.crossings(det, 0.3, 0.6)
    assert {(r["video_id"], r["unique_id"]) for r in got.collect()} == crossed
    want = {}
    for k, t in by_track(rows).items():
        if k in crossed:
            xs = [r[4] for r in t]
            want[k] = (abs(xs.index(min(xs)) - xs.index(max(xs))) + 1) / fps[k[0]]
    assert {(r["video_id"], r["unique_id"]): r["crossing_time_s"] for r in E.crossing_times(E.track_shapes(det, 0.3, 0.6), seg).collect()} == pytest.approx(want)
    speeds = {}
    for k, t in by_track(rows).items():
        h = sum(r[6] for r in t) / len(t)
        if k in crossed and h:
            v = (max(r[4] for r in t) - min(r[4] for r in t)) / (h / 170) / want[k] / 100
            if v <= 1.42:
                speeds[k] = v
    assert {(r["video_id"], r["unique_id"]): r["speed"] for r in E.crossing_speeds(E.crossing_times(E.track_shapes(det, 0.3, 0.6), seg)).collect()} == pytest.approx(speeds)


def hesitation(xs, hs, fps):
    """First run of three or more still steps that a move ends."""
    margin, run = 0.1 * (sum(hs) / len(hs)), 0
    for i in range(0, len(xs) - 10, 10):
        a, b = xs[i], xs[i + 10]
        still = a - margin <= b <= a + margin if xs[0] < 0.5 else a - margin >= b >= a + margin
        if still:
            run += 1
        elif run >= 3:
            break
        else:
            run = 0
    else:
        return None
    return run / (fps / 10) if run <= 0.9 * fps else None


def test_hesitation(spark):
    for seed in (2, 3):
        rows = tracks(seed, 80, 400)
        det, seg = frames(spark, rows)
        want = {}
        for k, t in by_track(rows, True).items():
            v = hesitation([r[4] for r in t], [r[6] for r in t], 25.0 if k[0] == "v0" else 30.0)
            if v is not None:
                want[k] = v
        got = {(r["video_id"], r["unique_id"]): r["hesitation_s"] for r in E.hesitation_times(det, seg).collect()}
        assert want and got == pytest.approx(want)


def test_equipment_between_first_and_last_row(spark):
    rows = [r[:3] + (0 if r[3] == 9 and r[2] % 5 else r[3],) + r[4:] for r in tracks(4, 40, 30)]
    random.Random(4).shuffle(rows)
    det, _ = frames(spark, rows)
    crossed = E.track_shapes(det, 1.0, 0.0)
    got = {(r["video_id"], r["unique_id"]): r["equipped"] for r in E.crossings_with_equipment(det, crossed, (9,)).collect()}
    reduced = G.class_tracks(det)
    assert got == {(r["video_id"], r["unique_id"]): r["equipped"] for r in E.crossings_with_equipment(reduced, crossed, (9,)).collect()}
    assert sorted(map(str, G.object_counts(det).collect())) == sorted(map(str, G.object_counts(reduced).collect()))
    for k, t in by_track(rows).items():
        if k in got:
            a, b = min(r[2] for r in t), max(r[2] for r in t)
            assert got[k] == any(r[3] == 9 and r[0] == k[0] and a <= r[2] <= b for r in rows)
    assert set(got.values()) == {True, False}


def test_halving_mean_and_signs(spark):
    rng = random.Random(6)
    rows = [("a" if k < 1 else "b", 0, rng.random() * 9) for k in range(7)]
    rates = spark.createDataFrame([(c, d, v, f"v{k}", 0) for k, (c, d, v) in enumerate(rows)], "country string, condition int, rate double, video_id string, start_time int")
    want = {}
    for c, _, v in rows:
        want[c] = (want[c] + v) / 2 if c in want else v
    assert {r["country"]: r["traffic"] for r in G.halving_mean(rates).collect()} == pytest.approx(want)


def test_traffic_class_flags():
    assert G.traffic_classes(motorcycle=True, car=True, bus=True, truck=True) == (2, 3, 5, 7)
    assert G.traffic_classes(car=True) == (3,) and G.traffic_classes(motorcycle=True) == (2,)
    assert G.traffic_classes(car=True, fix_known_defects=True) == (2,) and G.traffic_classes(bicycle=True) == (1,)


def test_null_ids_and_empty_input(spark):
    det, seg = frames(spark, [("v0", 0, 1, 0, 0.1, 0.5, 0.2, None), ("v0", 0, 2, 2, 0.9, 0.5, 0.2, None), ("v0", 0, 3, 2, 0.9, 0.5, 0.2, 5)])
    assert E.crossings(det).collect() == []
    counts = G.object_counts(det).collect()[0]
    assert counts["person"] == 0 and counts["car"] == 1
    assert G.segment_rates(det, seg, (2,)).collect()[0]["n"] == 2  # no id counts as one
    assert G.segment_rates(det, seg, (2,), fix_known_defects=True).collect()[0]["n"] == 1
    empty = det.where("false")
    assert E.crossing_times(E.track_shapes(empty), seg).collect() == []
    assert E.hesitation_times(empty, seg).collect() == []


def scans(df):
    """How often the optimised plan reads a file source."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_one_pass_over_the_detections(spark, tmp_path):
    rows = tracks(7, 30, 40)
    det, seg = frames(spark, rows)
    det.write.parquet(str(tmp_path / "det"))
    stored = spark.read.parquet(str(tmp_path / "det"))
    times = E.crossing_times(E.track_shapes(stored), seg)
    assert scans(E.mean_by_condition(E.crossing_speeds(times), "speed", "speed")) == 1
    assert scans(G.object_counts(stored)) == 1
    plan = G.object_counts(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
