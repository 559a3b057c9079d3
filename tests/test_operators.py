"""Scenarios on small tables, and folds against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import geometry as g
from pitchlake.functions import labels as lab
from pitchlake.operators import detect, harvest, identity, matching, metrics, review, sequence, tracklets

BALL = "match_id long, frame long, ts_ms long, visible boolean, px double, py double, fx double, fy double, conf double"


def balls(spark, points, step=330, shift=0.5, first=0):
    return spark.createDataFrame([(1, first + i, (first + i) * step, True, 500.0 + i * shift, 300.0, x, y, 0.9) for i, (x, y) in enumerate(points)], BALL)


def test_zones(spark):
    pts = [(2.0, 18.0), (52.0, 18.0), (27.5, 18.0), (0.5, 0.5), (5.5, 36.0), (5.5, 36.1), (20.0, 1.0), (20.0, 35.5), (20.0, 18.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    x, y = F.col("x"), F.col("y")
    out = df.select(g.goal_zone(x, y).alias("z"), g.in_corner(x, y).alias("c"), g.on_touchline(x, y).alias("t")).collect()
    assert [r.z for r in out] == ["left", "right", None, "left", "left", None, None, None, None]
    assert [r.c for r in out] == [False, False, False, True, False, False, False, False, False]
    assert [r.t for r in out] == [False, False, False, True, True, True, True, True, False]


def test_detectors(spark):
    key = ["match_id"]
    assert detect.goal_kicks(balls(spark, [(3.0, 18.0)] * 10), key).count() >= 1
    corner = balls(spark, [(0.5, 0.5)] * 5)
    assert detect.corner_kicks(corner, key).count() == 1 and detect.goal_kicks(corner, key).count() == 1 and detect.throw_ins(corner, key).count() == 0
    side = balls(spark, [(25.0, 0.5)] * 5)
    assert detect.throw_ins(side, key).count() == 1 and detect.corner_kicks(side, key).count() == 0
    both = balls(spark, [(2.0, 18.0)] * 4).unionByName(balls(spark, [(54.5, 35.5)] * 4, first=60))
    rows = detect.set_pieces(both, key).orderBy("ts_ms").collect()
    assert len(rows) >= 2 and {r.phase for r in rows} == {"dead_ball"} and {r.source for r in rows} == {"rules"}
    assert detect.goal_kicks(balls(spark, [(3.0, 18.0)] * 10, shift=50), key).count() == 0


def test_registry(spark):
    r = detect.default_registry()
    assert [e.name for e in r.resolve()] == ["rules"] and [e.name for e in r.resolve(["set_piece", "heuristic", "nothing", "learned"])] == ["rules"]
    r.add("fake", lambda: detect.Learned(lambda c: c.balls.select("match_id", "frame", F.lit("shot").alias("label"))), opt_in=True)
    assert len(r.resolve()) == 1
    out = r.run(detect.Context(balls(spark, [(3.0, 18.0)] * 4)), ["rules", "fake"])
    assert {x.source for x in out.select("source").distinct().collect()} == {"rules", "learned"}
    assert isinstance(detect.Rules(), detect.Engine)


def greedy(ts, gap):
    out = []
    for t in sorted(ts):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def test_greedy_dedup_isnt_lag(spark):
    rng = random.Random(1)
    rows = [(k, t, i) for k in range(4) for i, t in enumerate(sorted(rng.sample(range(60_000), 60)))]
    got = sequence.greedy_dedup(spark.createDataFrame(rows, "k long, ts_ms long, frame long").repartition(3), ["k"], gap_ms=5000).collect()
    for k in range(4):
        assert sorted(r.ts_ms for r in got if r.k == k) == greedy([t for x, t, _ in rows if x == k], 5000)


def track(spark, spans, step=200):
    """spans: (until_ms, visible, moving)"""
    rows, t, x = [], 0, 0.0
    for until, visible, moving in spans:
        while t <= until:
            x += 60 if moving else 0
            rows.append((1, t // step, t, visible, x if visible else None, 5.0, None, None, 0.5))
            t += step
    return spark.createDataFrame(rows, BALL)


def test_dead_time(spark):
    gone = track(spark, [(3000, True, True), (11000, False, False), (14000, True, True)])
    plan = detect.trim_plan(gone, ["match_id"])
    (cut,) = plan.removed.collect()
    assert cut.reason == "offscreen" and 3000 <= cut.start_ms < cut.end_ms <= 11000 and cut.end_ms - cut.start_ms > 5000
    kept = sorted((r.start_ms, r.end_ms) for r in plan.kept.collect())
    assert kept == [(0, cut.start_ms), (cut.end_ms, 14000)]
    t = plan.totals.first()
    assert t.kept_ms + t.removed_ms == 14000 == sum(b - a for a, b in kept) + cut.end_ms - cut.start_ms
    assert detect.trim_plan(track(spark, [(3000, True, True), (5000, False, False), (8000, True, True)]), ["match_id"]).removed.count() == 0
    parked = detect.trim_plan(track(spark, [(1000, True, True), (9400, True, False), (12000, True, True)]), ["match_id"]).removed.collect()
    assert [r.reason for r in parked] == ["stationary"]


def test_complement_of_overlaps(spark):
    s = spark.createDataFrame([(1, 10, 30), (1, 20, 40), (1, 35, 38), (1, 90, 120), (2, 0, 5)], "k long, start_ms long, end_ms long")
    totals = spark.createDataFrame([(1, 100), (2, 9), (3, 7)], "k long, total_ms long")
    got = sorted(map(tuple, sequence.complement(s, totals, ["k"]).collect()))
    assert got == [(1, 0, 10), (1, 40, 90), (2, 5, 9), (3, 0, 7)]


def kalman_loop(rows, noise=8.0, accel=300.0, gate=9.21, relock=3, gap=1000, speed=1000.0):
    """The whole 4 x 4 filter, written out with matrices."""
    import numpy as np

    h, r = np.eye(2, 4), noise**2 * np.eye(2)
    x = p = prev = last = None
    rejects, out = 0, []

    def fresh(z):
        return np.array([*z, 0, 0]), np.diag([noise**2, noise**2, speed**2, speed**2])

    for t, seen, mx, my in rows:
        dt = 0 if prev is None else (t - prev) / 1000
        prev = t
        if not seen:
            continue
        z = np.array([mx, my])
        if last is not None and t - last > gap:
            (x, p), rejects = fresh(z), 0
        last = t
        outlier = False
        if x is None:
            x, p = fresh(z)
        else:
            f = np.eye(4)
            f[0, 2] = f[1, 3] = dt
            gamma = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
            x, p = f @ x, f @ p @ f.T + accel**2 * gamma @ gamma.T
            e, s = z - h @ x, h @ p @ h.T + r
            if e @ np.linalg.solve(s, e) > gate:
                rejects += 1
                if rejects >= relock:
                    (x, p), rejects = fresh(z), 0
                else:
                    outlier = True
            else:
                k = p @ h.T @ np.linalg.inv(s)
                x, p, rejects = x + k @ e, (np.eye(4) - k @ h) @ p, 0
        out.append((t, x[0], x[1], outlier))
    return out


def test_kalman_fold(spark):
    rng = random.Random(9)
    data, want = [], []
    for k in range(3):
        x, rows = 500.0, []
        for i in range(60):
            x += 40 + (1500 if i == 30 else 0)
            jump = 900 if i in (12, 45) else 0
            t = i * 200 + (1900 if i > 50 else 0)
            rows.append((t, rng.random() > 0.1, x + rng.gauss(0, 6) + jump, 300 + rng.gauss(0, 6)))
        data += [(k, i, t, s, a, b, None, None, 0.5) for i, (t, s, a, b) in enumerate(rows)]
        want += [(k, *r) for r in kalman_loop(rows)]
    every = sorted(sequence.kalman(spark.createDataFrame(data, BALL).repartition(4), ["match_id"]).collect(), key=lambda r: (r.match_id, r.ts_ms))
    got = [r for r in every if r.smoothed]
    assert len(every) == len(data) and len(got) == len(want) and any(r.outlier for r in got)
    for a, b in zip(got, want, strict=True):
        assert (a.match_id, a.ts_ms, a.outlier) == (b[0], b[1], b[4])
        assert a.px == pytest.approx(b[2], abs=1e-6) and a.py == pytest.approx(b[3], abs=1e-6)


def test_unseen_samples_pass_through_untouched(spark):
    rows = [(1, 0, 0, True, 500.0, 1.0, None, None, 0.5), (1, 1, 200, False, None, None, 3.0, 4.0, 0.1), (1, 2, 400, False, 7.0, 8.0, None, None, 0.2), (1, 3, 600, True, 505.0, 1.0, None, None, 0.9)]
    out = sorted(sequence.kalman(spark.createDataFrame(rows, BALL), ["match_id"]).collect(), key=lambda r: r.frame)
    assert [tuple(r)[:9] for r in out[1:3]] == rows[1:3]  # all columns as they were
    assert [(r.raw_x, r.smoothed, r.outlier) for r in out[1:3]] == [(None, False, False)] * 2
    assert out[3].raw_x == 505.0 and out[3].smoothed and out[3].conf == 0.9


def test_filters_on_many_samples(spark, tmp_path):
    """Ten thousand samples of one match, in small batches, against loops that hold them all."""
    rng = random.Random(4)
    n, x = 10_000, 500.0
    rows = []
    for i in range(n):
        x = min(1900.0, max(0.0, x + rng.gauss(0, 20)))
        rows.append((1, i, i * 200, rng.random() > 0.2, x + (800 if rng.random() < 0.01 else 0), 300.0 + rng.gauss(0, 5), None, None, 0.5))
    df = spark.createDataFrame(rows, BALL).repartition(7)
    want = kalman_loop([(r[2], r[3], r[4], r[5]) for r in rows])
    got = [r for r in sequence.kalman(df, ["match_id"]).orderBy("ts_ms").collect() if r.smoothed]
    assert [(r.ts_ms, r.outlier) for r in got] == [(w[0], w[3]) for w in want]
    assert max(abs(r.px - w[1]) for r, w in zip(got, want, strict=True)) < 1e-5
    now, smooth = 250.0, []
    for r in rows:
        now += 0.3 * (r[4] - now) if r[3] else 0.0
        smooth.append(now)
    seen = df.withColumn("t", F.when(F.col("visible"), F.col("px")))
    got = [r.smooth for r in sequence.ema(seen, ["match_id"], "frame", "t", 250.0, 0.3).orderBy("frame").collect()]
    assert got == pytest.approx(smooth, abs=1e-6)


def test_attempts_and_halves(spark):
    rows = spark.createDataFrame([(1, f, float(f) if f not in (0, 310) else None) for f in range(0, 1000, 10)], "m long, f long, v double")
    out = sequence.registered(rows, ["m"], "f", "v", 300).orderBy("f").collect()
    assert [r.f for r in out if r.attempt] == [0, 300, 600, 900]
    assert [out[i].current for i in (0, 29, 30, 31, 60, 99)] == [None, None, 300.0, 300.0, 600.0, 900.0]
    t = F.lit(1000)
    assert [sequence.half(rows, "f", w, t, h).count() for w in ("first", "second", "both") for h in (None, F.lit(0), F.lit(200))] == [50, 50, 20, 50, 50, 80, 100, 100, 100]


def test_association(spark):
    box = lambda f, x, c: (1, f, float(x), 0.0, x + 10.0, 10.0, c)
    rows = [box(f, 5 * f, 0.9 if f != 3 else 0.15) for f in range(8) if f != 5] + [box(f, 200 - f, 0.8) for f in range(8)] + [box(2, 500, 0.15), box(50, 36, 0.9)]
    got = tracklets.associate(spark.createDataFrame(rows, "m long, frame long, x1 double, y1 double, x2 double, y2 double, conf double").repartition(3), ["m"], overlap=0.01, lost=30).collect()
    of = {(r.frame, r.x1): r.track for r in got}
    first = {of[f, 5.0 * f] for f in range(5)}
    assert len(got) == len(rows) and len(first) == 1 and {of[f, 200.0 - f] for f in range(8)} == {3 - first.pop()}
    assert of[2, 500.0] is None and of[50, 36.0] not in (1, 2)  # weak alone; after a long gap a new one


def test_rects_and_hull_against_plain_code(spark):
    rng = random.Random(8)
    boxes = [(x, y, x + rng.choice([3.9, 4, 12, 30.5, 80]), y + rng.choice([7.5, 8, 23, 24, 90.25])) for x, y in ((rng.uniform(-40, 1930), rng.uniform(-40, 1090)) for _ in range(300))]
    hull = [(100.0, 100.0), (1800.0, 150.0), (1700.0, 950.0), (200.0, 900.0)]

    def part(box, least, side, top, bottom, result):
        x1, y1, x2, y2 = box
        w, h = x2 - x1, y2 - y1
        a, c = max(0, round(x1 + w * side)), min(1920, round(x2 - w * side))
        b, d = max(0, round(y1 + h * top)), min(1080, round(y1 + h * bottom))
        return (a, b, c, d) if w >= least[0] and h >= least[1] and c - a >= result and d - b >= result else (None,) * 4

    def away(x, y):
        best, inside = 1e9, True
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            inside &= (bx - ax) * (y - ay) >= (by - ay) * (x - ax)
            best = min(best, min(((x - ax - (bx - ax) * t / 2000) ** 2 + (y - ay - (by - ay) * t / 2000) ** 2) ** 0.5 for t in range(2001)))
        return best if inside else -best

    df = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double")
    b = [F.col(c) for c in df.columns]
    rows = df.select(*g.torso_rect(*b), *g.number_rect(*b), g.hull_distance(b[0], b[1], hull)).collect()
    for box, r in zip(boxes, rows, strict=True):
        assert tuple(r[:4]) == part(box, (4, 8), 0.2, 0.2, 0.55, 2) and tuple(r[4:8]) == part(box, (12, 24), 0.1, 0.0, 0.55, 8)
        assert r[8] == pytest.approx(away(box[0], box[1]), abs=1.0)
    corner = spark.createDataFrame([(81.0, 81.0)], "x double, y double").select(g.hull_distance(F.col("x"), F.col("y"), hull)).first()[0]
    assert corner == pytest.approx(-((19**2 * 2) ** 0.5))


def test_pairing_against_a_search_of_all_clips(spark):
    rng = random.Random(21)
    e = [("r", i, rng.randrange(0, 300) / 2) for i in range(150)]
    c = [("r", 1000 + i, rng.randrange(0, 300) / 2, f"n{rng.randrange(10**6)}") for i in range(120)]
    left, want = sorted((t, n) for _, _, t, n in c), {}
    for _, i, t in e:
        best = min(left, key=lambda x: (abs(x[0] - t), x[1]), default=None)
        want[i] = None
        if best is not None and abs(best[0] - t) <= 2:
            left.remove(best)
            want[i] = best[1]
    events, clips = spark.createDataFrame(e, "run string, idx int, ts double"), spark.createDataFrame(c, "run string, idx int, ts double, name string")
    assert {r.idx: r.clip for r in review.pair_clips(events, clips, "run").collect()} == want


def test_admission_with_equal_order(spark):
    cc = "Creative Commons Attribution"
    rows = [(i, "a", None, f"c{i}", cc, 900.0, 5) for i in (1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "id long, title string, description string, channel string, license string, duration double, seq int")
    seen = spark.createDataFrame([], "id long, channel string")
    got = sorted((r.id, r.reason) for r in harvest.admission(df, seen, "seq", target=2).collect())
    assert got == [(1, "kept"), (2, "kept"), (3, "seen"), (3, "target")]


def test_sql_functions(spark):
    from pitchlake.functions import sql

    assert "goal_zone" in sql.register(spark)
    r = spark.sql("SELECT goal_zone(2D, 18D), in_corner(0.5D, 0.5D), on_touchline(1D), clip_start(2D, 5D), box_overlap(array(0D,0D,2D,2D), array(1D,0D,3D,2D))").first()
    assert tuple(r) == ("left", True, True, 0.0, pytest.approx(1 / 3))


def test_nearest_in_frames(spark):
    e = spark.createDataFrame([("a", 10, 5.0, 5.0, None, None), ("b", 20, 5.0, 5.0, None, None), ("c", 30, 5.0, 5.0, None, None), ("d", 40, None, None, 100.0, 100.0)], "id string, frame long, fx double, fy double, px double, py double")
    p = spark.createDataFrame([(10, 1, 6.0, 5.0, None, None), (10, 2, 5.5, 5.0, None, None), (22, 3, 5.0, 6.0, None, None), (30, 4, 55.0, 5.0, None, None), (40, 5, None, None, 150.0, 100.0)], "frame long, track long, fx double, fy double, px double, py double")
    out = {r.id: r.track for r in matching.nearest_in_frames(e, p, [], "id").collect()}
    assert out == {"a": 2, "b": 3, "c": None, "d": 5}


def test_event_filter(spark):
    e = spark.createDataFrame([("shot", "Red", 3), ("goal", None, 11), ("shot", "blue", None), ("foul", "red", 4)], "label string, team string, track long")
    assert matching.event_filter(e, team="RED").count() == 2
    assert matching.event_filter(e, label="shot", team="red").count() == 1
    lanes = spark.createDataFrame([(3,), (11,)], "track long")
    assert matching.event_filter(e, lanes=lanes).count() == 2
    assert matching.event_filter(e, lanes=lanes.limit(0)).count() == 0 and matching.event_filter(e, lanes=lanes.limit(0), track=4).count() == 1


def test_votes(spark):
    reads = [(1, 7, 0.9)] * 6 + [(2, 7, 0.2)] * 3 + [(2, 9, 0.9)] * 2 + [(3, 7, 0.9)] * 2 + [(4, 7, 0.5), (4, 9, 0.5)] * 2 + [(5, n, 0.4) for n in (1, 2, 3)] + [(6, 7, 0.8)] * 4 + [(6, None, 0.0)] * 6
    out = {r.track: r for r in identity.weighted_vote(spark.createDataFrame(reads, "track long, number int, conf double"), ["track"]).collect()}
    assert out[1].jersey == 7 and out[1].confidence == 1.0
    assert out[2].jersey == 9 and out[3].jersey is None and out[3].confidence == 0.0
    assert out[4].jersey is None and out[4].confidence == 0.5 and out[5].jersey is None
    assert out[6].jersey == 7 and out[6].legible_frac == pytest.approx(0.4) and out[6].n_obs == 10


def test_lanes(spark):
    votes = spark.createDataFrame([(3, 7, "x"), (11, 7, None), (5, None, "Bryce "), (6, 9, "Z")], "track long, jersey int, name string")
    roster = spark.createDataFrame([(7, "Ada"), (9, "zed")], "jersey int, name string")
    ids = lambda d: sorted(r.track for r in d.collect())
    assert ids(matching.lanes_for(votes, roster, number=7)) == [3, 11]
    assert ids(matching.lanes_for(votes, roster, name=" ADA")) == [3, 11]
    assert ids(matching.lanes_for(votes, roster, name="bryce")) == [5] and ids(matching.lanes_for(votes, roster, name="no one")) == []


def test_movement(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 6.0), (2, 0, 1.0, 1.0)] + [(3, i, 6.0 * i, 0.0) for i in range(12)], "track long, idx long, x double, y double")
    d = {r.track: r.distance for r in metrics.distance(t, ["track"], "idx", "x", "y").collect()}
    assert d == {1: 7.0, 2: 0.0, 3: 66.0}
    assert [(r.track, r.start, r.end) for r in metrics.sprints(t, ["track"], "idx", "x", "y").collect()] == [(3, 0, 11)]


def test_possession(spark):
    near = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(4)] + [(9, 5)], "frame long, track long")
    teams = spark.createDataFrame([(1, "a"), (2, "b"), (5, None)], "track long, team string")
    assert {r.team: r.pct for r in metrics.possession(near, teams).collect()} == {"a": 75.0, "b": 25.0}
    assert metrics.possession(near.limit(0), teams).collect() == []


def test_interpolation_and_veto(spark):
    s = spark.createDataFrame([(1, 0, 100.0), (1, 5, 110.0), (1, 30, 0.0)], "track long, frame long, x1 double")
    want = spark.createDataFrame([(1, f) for f in (0, 2, 5, 17, 30, 31)], "track long, frame long")
    out = {r.frame: r.x1 for r in matching.interpolated_boxes(s, want, ["track"], sides=("x1",)).collect()}
    assert out == {0: 100.0, 2: 104.0, 5: 110.0, 17: None, 30: 0.0, 31: None}
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 50.0, 0.0, 60.0, 10.0)], "frame long, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([(1, 1.0, 0.0, 11.0, 10.0)], b.schema)
    assert [x.x1 for x in matching.veto(b, r, ["frame"]).collect()] == [50.0]


def test_clip_pairing(spark):
    e = spark.createDataFrame([("r", 1, 10.0), ("r", 2, 20.0), ("r", 3, 30.0), ("r", 4, 99.0)], "run string, idx int, ts double")
    c = spark.createDataFrame([("r", 1, 10.4, "a"), ("r", 9, 19.0, "b"), ("r", 8, 21.5, "c"), ("r", 3, 35.0, "d")], "run string, idx int, ts double, name string")
    assert {r.idx: r.clip for r in review.pair_clips(e, c, "run").collect()} == {1: "a", 2: "b", 3: None, 4: None}


def test_texts(spark):
    df = spark.createDataFrame([("Kick-off.",), ("this looks like an indirect free-kick",), ("corner",), ("nothing",)], "t string")
    cls, sure = lab.normalise_class(F.col("t"))
    assert [tuple(r) for r in df.select(cls, sure).collect()] == [("Kick-off", 0.9), ("Direct free-kick", 0.6), ("Corner", 0.9), (None, 0.0)]
    n = spark.createDataFrame([("6", [0.9]), ("23", [0.8, 0.7]), ("", []), ("ABC", [0.9] * 3), ("123", [0.9] * 3), ("A7", [0.1, 0.6])], "t string, c array<double>")
    num, conf = lab.parse_number(F.col("t"), F.col("c"))
    assert [tuple(r) for r in n.select(num, conf).collect()] == [(6, 0.9), (23, 0.7), (None, 0.0), (None, 0.0), (None, 0.0), (7, 0.6)]
    names = spark.createDataFrame([("m_1_007_corner_kick_12s.mp4",), ("other.mp4",)], "n string")
    assert [tuple(r) for r in names.select(*lab.parse_clip_name(F.col("n"))).collect()] == [("m_1", 7, "corner_kick", 12), (None, None, None, None)]
    w = spark.createDataFrame([(600.0, 0.6), (600.0, 0.5), (6.0, 0.6)], "d double, f double")
    a = [tuple(r) for f in (0.6, 0.5) for r in w.select(*g.harvest_window(F.col("d"), 10.0, f)).collect()]
    assert a[0] == (355.0, 365.0) and a[3] == (295.0, 305.0) and a[2] == (0.0, 6.0)
    colours = spark.createDataFrame([(255, 0, 0), (0, 0, 255), (255, 255, 255), (5, 5, 5)], "b int, g int, r int")
    assert [r[0] for r in colours.select(lab.colour_name(F.col("b"), F.col("g"), F.col("r"))).collect()] == ["blue", "red", "white", "black"]


def test_admission(spark):
    schema = "id long, title string, description string, channel string, license string, duration double"
    cc = "Creative Commons Attribution"
    rows = [(1, "a", None, "x", cc, 900.0), (2, "NFL game", None, "x", cc, 900.0), (3, "b", None, "x", "Standard", 900.0), (4, "c", None, "x", cc, 20.0), (5, "d", None, "x", cc, 900.0), (6, "e", None, "x", cc, 900.0), (7, "f", None, "y", cc, None), (8, "g", None, None, cc, 900.0), (9, "h", None, "z", cc, 900.0)]
    seen = spark.createDataFrame([(9, "z"), (50, "q")], "id long, channel string")
    out = {r.id: r.reason for r in harvest.admission(spark.createDataFrame(rows, schema), seen, "id", per_channel=2, target=4).collect()}
    assert out == {1: "kept", 2: "off_topic", 3: "license", 4: "too_short", 5: "kept", 6: "channel_cap", 7: "unresolvable", 8: "target", 9: "seen"}


def test_tracks(spark):
    rows = spark.createDataFrame([(1, f) for f in range(0, 40, 2)] + [(2, f) for f in range(0, 400, 20)] + [(3, 1)], "track long, frame long")
    assert {r.track for r in tracklets.continuous(rows, ["track"], stride=2).collect()} == {1}
    held = spark.createDataFrame([(1, f, "go" if f == 3 else None) for f in range(0, 20)], "t long, f long, a string")
    assert [r.f for r in tracklets.held_action(held, ["t"], "f", "a", 12).where("held = 'go'").collect()] == list(range(3, 15))


def test_two_teams(spark):
    m = spark.createDataFrame([(i, 250.0, 10.0, 10.0) for i in range(4)] + [(i, 10.0, 10.0, 250.0) for i in range(4, 8)], "track long, b double, g double, r double")
    out = {r.track: r.team for r in identity.two_teams(m, ["track"]).collect()}
    assert len(set(out.values())) == 2 and len({out[i] for i in range(4)}) == 1
    assert {r.track: r.cluster for r in identity.two_teams(m, ["track"]).collect()} == {i: "team_a" if i < 4 else "team_b" for i in range(8)}
    assert [(r.cluster, r.team) for r in identity.two_teams(m.where("track = 0"), ["track"]).collect()] == [("team_a", "blue")]
    assert identity.two_teams(m.limit(0), ["track"]).collect() == []


def test_lab_clusters_against_plain_two_means(spark):
    rng = random.Random(13)
    rows = [(i, *(float(rng.randrange(256)) for _ in range(3))) for i in range(60)]
    m = spark.createDataFrame(rows, "track long, b double, g double, r double")
    lab_of = {r.track: tuple(r)[1:] for r in m.select("track", *g.lab_colour(F.col("b"), F.col("g"), F.col("r"))).collect()}
    assert spark.range(1).select(*g.lab_colour(F.lit(255.0), F.lit(255.0), F.lit(255.0))).first()[0] == pytest.approx(100, abs=0.01)
    centres = [min(lab_of.values()), max(lab_of.values())]
    for _ in range(20):
        side = {t: sum((a - b) ** 2 for a, b in zip(v, centres[1], strict=True)) < sum((a - b) ** 2 for a, b in zip(v, centres[0], strict=True)) for t, v in lab_of.items()}
        centres = [tuple(sum(c) / len(c) for c in zip(*[v for t, v in lab_of.items() if side[t] == s], strict=True)) for s in (False, True)]
    got = {r.track: r.cluster == "team_b" for r in identity.two_teams(m, ["track"]).collect()}
    assert got == {t: sum((a - b) ** 2 for a, b in zip(v, centres[1], strict=True)) < sum((a - b) ** 2 for a, b in zip(v, centres[0], strict=True)) for t, v in lab_of.items()}


def test_lane_grid_covers_all_frames_and_ranked_lanes(spark):
    seen = [("a", 900, f, float(f)) for f in (3, 250, 999)] + [("a", 7, 3, 1.0), ("a", 7, 4, None), ("a", 500, 5, 6.0), ("b", 40, 300, 2.0)]
    rows = spark.createDataFrame(seen, "team string, track long, frame long, x double")
    got = {(r.team, r.slot, r.frame): (r.x, r.mask) for r in tracklets.lane_grid(rows, "team", "track", "frame", {"x": 50.0}, 2).collect()}
    assert set(got) == {(t, s, f) for t in "ab" for s in (1, 2) for f in range(3, 1000)}
    assert {k: x for k, (x, m) in got.items() if m} == {("a", 1, 3): 3.0, ("a", 1, 250): 250.0, ("a", 1, 999): 999.0, ("a", 2, 3): 1.0, ("b", 1, 300): 2.0}
    assert {x for x, m in got.values() if not m} == {50.0}
    assert tracklets.lane_grid(rows.limit(0), "team", "track", "frame", {"x": 50.0}).collect() == []


def test_lane_grid_is_not_shuffled_and_fills_each_stretch(spark, monkeypatch):
    """Rows on the edges of stretches, repeated, null and NaN ones; below zero too."""
    rng = random.Random(3)
    seen = [(rng.choice(["a", "b", "c", None]), rng.randrange(4), rng.randrange(-37, 90), rng.choice([1.0, 2.0, None, float("nan")])) for _ in range(300)]
    seen += [("a", 1, f, 5.0) for f in (-16, -9, -8, -1, 0, 7, 8, 15, 16)] + [("a", 1, None, 9.0), ("b", None, 3, 9.0)]
    rows = spark.createDataFrame(seen, "team string, track long, frame long, x double")
    n = Counter((t, k) for t, k, _, _ in seen if t)
    slot = {(t, k): i + 1 for t in "abc" for i, (_, _, k) in enumerate(sorted((-c, k is not None, k) for (o, k), c in n.items() if o == t)[:3])}
    low, high = (f(r[2] for r in seen if r[2] is not None) for f in (min, max))
    want = {(t, s, f): (50.0, 0) for t in "abc" for s in (1, 2, 3) for f in range(low, high + 1)}
    for t, k, f, x in sorted((r for r in seen if None not in r and r[3] == r[3] and r[:2] in slot), key=lambda r: -r[3]):
        want[t, slot[t, k], f] = (x, 1)
    for bits in (3, 12):
        monkeypatch.setattr(tracklets, "STRETCH_BITS", bits)
        grid = tracklets.lane_grid(rows, "team", "track", "frame", {"x": 50.0}, 3)
        got = grid.collect()
        assert len(got) == len(want) and {(r.team, r.slot, r.frame): (r.x, r.mask) for r in got} == want
    # nothing that moves or sorts rows stands above the step that makes the grid
    above = grid._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    assert not any(x in above for x in ("Exchange", "Join", "Sort"))


def test_nearest_valid_takes_each_row_up_once(spark):
    rng = random.Random(8)
    seen = [(rng.randrange(3), rng.randrange(-20, 60), rng.choice([None, None, 1.0, 2.0, 3.0])) for _ in range(120)] + [(4, 1, None), (5, None, 7.0), (5, 3, None)]
    rows = spark.createDataFrame(seen, "k long, o long, v double")

    def near(k, o):
        found = [(abs(p - o), p, v) for j, p, v in seen if j == k and v is not None and p is not None] if o is not None else []
        return min(found)[2] if found else None

    df = matching.nearest_valid(rows, ["k"], "o", "v")
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=order) == sorted(((k, o, v, near(k, o)) for k, o, v in seen), key=order)
    # a frame up to the last row is added up anew for each row
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
