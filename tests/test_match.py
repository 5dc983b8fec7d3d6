"""Smoothing, matching and tracking scores against plain versions on small inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from touchline.operators import edits, joins, match_events, motion, possession, scoring


def _posterior(t, z, noise, acceleration):
    """Posterior mean of the constant-velocity model, solved densely."""
    n = len(t)
    a, b = np.zeros((2 * n, 2 * n)), np.zeros((2 * n, z.shape[1]))
    a[:2, :2] += np.diag([1 / noise**2, 1 / 4.0])
    b[0] += z[0] / noise**2
    for i in range(1, n):
        dt = t[i] - t[i - 1]
        f, q = np.array([[1, dt], [0, 1]]), acceleration**2 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt * dt]]) + 1e-9 * np.eye(2)
        w, p, c = np.linalg.inv(q), slice(2 * i - 2, 2 * i), slice(2 * i, 2 * i + 2)
        a[p, p] += f.T @ w @ f
        a[c, c] += w
        a[p, c] -= f.T @ w
        a[c, p] -= w @ f
        a[2 * i, 2 * i] += 1 / noise**2
        b[2 * i] += z[i] / noise**2
    found = np.linalg.solve(a, b)
    return found[::2], found[1::2]


def test_smoother_is_the_posterior_mean():
    rng = np.random.default_rng(1)
    for n in (3, 5, 12):
        t, z = np.cumsum(rng.random(n) * 0.3 + 0.02), rng.normal(size=(n, 2)) * 5
        for got, want in zip(motion.constant_velocity_smoother(t, z, 0.5, 3.0), _posterior(t, z, 0.5, 3.0), strict=True):
            assert np.abs(got - want).max() < 1e-4
    place, speed = motion.constant_velocity_smoother(np.arange(2.0), np.ones((2, 2)), 0.5, 3.0)
    assert (place == 1).all() and (speed == 0).all()


def test_smoothing_finds_a_constant_speed(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i / 25, 3 * i / 25 + rng.normal() * 0.5, rng.normal() * 0.5) for i in range(60)] + [(2, 0.0, 1.0, 1.0)]
    out = motion.smooth_tracks(spark.createDataFrame(rows, "track long, t double, x double, y double"), ["track"], "t", "x", "y").collect()
    assert 2 < np.median([r.speed for r in out if r.track == 1]) < 4.5 and len(out) == 61


def test_profiles_of_a_sprint_and_of_a_track_without_intervals(spark):
    rows = [(1, 0, i, i * 0.2, 1.6 * i, 0.0, 8.0) for i in range(6)] + [(1, 1, 9, 1.8, 0.0, 0.0, 8.0), (1, 1, 10, 2.0, 1.6, 0.0, 8.0)]
    steps = motion.intervals(spark.createDataFrame(rows, "track long, seg long, f long, t double, x double, y double, v double"), ["track", "seg"], ["f"], "t", "x", "y", "v")
    tracks = spark.createDataFrame([(1, 10, 8, 2.0), (2, 4, 0, 0.0)], "track long, n_rows long, n_usable long, duration double")
    out = {r.track: r for r in motion.profiles(tracks, steps, ["track"], ["track", "seg"]).collect()}
    assert (out[1].n_sprints, round(out[1].sprint_distance, 6), round(out[1].distance, 6)) == (1, 8.0, 9.6)
    assert (out[1].coverage, round(out[1].confidence, 6)) == (0.8, 0.32) and (out[2].distance, out[2].confidence) == (0.0, 0.0)


@pytest.mark.parametrize("seed", range(5))
def test_matching_on_a_line_is_the_cheapest_assignment(seed):
    rng = random.Random(seed)
    for _ in range(300):
        x, y = (sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in "ab")
        tolerance = rng.choice([0, 1, 3, 5])
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        best = min((sum(abs(p - q) if abs(p - q) <= tolerance else 1e6 for p, q in zip(small, pick, strict=True)) for pick in itertools.permutations(large, len(small))), default=0)
        got = joins.match_sorted(np.array(x, float), np.array(y, float), float(tolerance))
        assert len(got) == len(small) - best // 1e6 == len({i for i, _ in got}) == len({j for _, j in got})
        assert sum(abs(x[i] - y[j]) for i, j in got) == best % 1e6


SEQUENCE = "s long, f long, id long, x1 double, y1 double, x2 double, y2 double"


def _boxes(spark, frames):
    """frames: {f: [(id, slot)]}, a slot being 100 wide."""
    return spark.createDataFrame([(0, f, i, s * 100.0, 0.0, s * 100.0 + 40, 80.0) for f, row in frames.items() for i, s in row], SEQUENCE)


def test_clear_and_identity_scores_on_scripted_sequences(spark):
    truth = {f: [(1, 0), (2, 2)] for f in range(10)}
    found = {
        "perfect": {f: [(7, 0), (8, 2)] for f in range(10)},
        "miss": {f: [(7, 0)] + [(8, 2)] * (f not in (4, 5)) for f in range(10)},
        "false_positive": {f: [(7, 0), (8, 2), (9, 5)] for f in range(10)},
        "switch": {f: [(7 if f < 5 else 9, 0), (8, 2)] for f in range(10)},
        "swap": {f: [(7, 0 if f < 5 else 2), (8, 2 if f < 5 else 0)] for f in range(10)},
    }
    want = {  # fp, fn, switches, fragments, idtp
        "perfect": (0, 0, 0, 0, 20), "miss": (0, 2, 0, 1, 18), "false_positive": (10, 0, 0, 0, 20), "switch": (0, 0, 1, 0, 15), "swap": (0, 0, 2, 0, 10),
    }
    g = _boxes(spark, truth)
    for name, frames in found.items():
        p = _boxes(spark, frames)
        c, i = scoring.clear_scores(g, p, ["s"], "f").first(), scoring.identity_f1(g, p, ["s"], "f").first()
        assert (c.fp, c.fn, c.switches, c.fragments, i.idtp) == want[name], name
        assert abs(c.mota - (1 - sum(want[name][:3]) / 20)) < 1e-12 and c.motp == 1.0
    none = _boxes(spark, {}).where("f < 0") if found else None
    assert scoring.clear_scores(g, none, ["s"], "f").first().fn == 20 and scoring.identity_f1(g, none, ["s"], "f").first().idf1 == 0


def _iou(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / (area(a) + area(b) - w * h)


def test_hota_is_that_of_all_assignments(spark):
    rng = random.Random(4)
    rows = {"g": [], "p": []}
    for f in range(8):
        for i in range(3):
            x = 50.0 * i + rng.random() * 10
            if rng.random() < 0.9:
                rows["g"].append((0, f, i, x, 0.0, x + 40, 40.0))
            if rng.random() < 0.8:
                d = rng.random() * 20
                rows["p"].append((0, f, (i + (f > 4)) % 3 + 10, x + d, 0.0, x + d + 40, 40.0))
    got = scoring.hota(*(spark.createDataFrame(rows[k], SEQUENCE) for k in "gp"), ["s"], "f").first()
    g, p = ({f: {r[2]: r[3:] for r in rows[k] if r[1] == f} for f in range(8)} for k in "gp")
    n_g, n_p = ({i: sum(i in x for x in side.values()) for i in {r[2] for r in rows[k]}} for k, side in (("g", g), ("p", p)))
    shared = {(i, j): sum(_iou(g[f][i], p[f][j]) for f in range(8) if i in g[f] and j in p[f]) for i in n_g for j in n_p}
    align = {(i, j): v / (n_g[i] + n_p[j] - v) for (i, j), v in shared.items()}
    picks = []
    for f in range(8):
        a, b = (list(g[f]), list(p[f]))
        options = [list(zip(a, c)) for c in itertools.permutations(b, len(a))] if len(a) <= len(b) else [list(zip(c, b)) for c in itertools.permutations(a, len(b))]
        best = max(options, key=lambda o: sum(align[i, j] * _iou(g[f][i], p[f][j]) for i, j in o))
        picks += [(i, j, _iou(g[f][i], p[f][j])) for i, j in best]
    scores = []
    for k in range(1, 20):
        hit = [(i, j) for i, j, v in picks if v >= round(0.05 * k, 2)]
        det = len(hit) / (sum(n_g.values()) + sum(n_p.values()) - len(hit))
        m = {x: hit.count(x) for x in set(hit)}
        ass = sum(c * c / (n_g[i] + n_p[j] - c) for (i, j), c in m.items()) / len(hit) if hit else 0.0
        scores.append((np.sqrt(det * ass), det, ass))
    assert np.abs(np.mean(scores, axis=0) - (got.hota, got.det_a, got.ass_a)).max() < 1e-9


def test_greedy_matches_take_the_best_free_box_by_score(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 0.9), (0, 2, 10, 0.6), (0, 1, 11, 0.8), (0, 2, 11, 0.55), (0, 2, 12, 0.4)], "f long, g long, p long, iou double")
    scores = spark.createDataFrame([(0, 10, 0.3), (0, 11, 0.7), (0, 12, 0.9)], "f long, p long, score double")
    assert sorted((r.g, r.p) for r in scoring.greedy_matches(pairs, scores, ["f"], 0.5).collect()) == [(1, 11), (2, 10)]


def test_event_scores(spark):
    truth = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("b", 3, 0.0)], "kind string, id long, t double")
    found = spark.createDataFrame([("a", 4, 0.5), ("a", 5, 12.0), ("a", 6, 30.0), ("c", 7, 1.0)], "kind string, id long, t double")
    out = {(r.kind, r.tolerance): r for r in scoring.event_scores(truth, found, ["kind"], "t", [1.0, 3.0]).collect()}
    assert len(out) == 6 and (out["a", 1.0].tp, out["a", 3.0].tp) == (1, 2)
    assert out["a", 3.0].precision == 2 / 3 and out["a", 3.0].recall == 1.0 and out["a", 3.0].mean_error == 1.25
    assert out["b", 1.0].precision is None and out["b", 1.0].recall == 0 and out["c", 1.0].recall is None and out["c", 1.0].f1 == 0


def test_two_nearest_and_ladder_on_one_frame(spark):
    people = spark.createDataFrame([(0, 1, "A", 0.0, 0.0, 10.0), (0, 2, "B", 3.0, 0.0, 10.0), (0, None, "A", 1.0, 0.0, 10.0), (0, 4, "A", 1.0, 0.0, 0.5)], "f long, track_id long, team_id string, x double, y double, height double")
    ball = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0)], "f long, x double, y double")
    two = possession.two_nearest(people, ball, ["f"])
    rows = {r.f: r for r in two.collect()}
    assert (rows[0].track_id, rows[0].contest_team, rows[0].nearest, rows[0].contest) == (1, "B", 0.1, 0.2) and rows[1].nearest is None
    more = "'observed' ball_state, false sustained_out, true plausible, 1D calibration, cast(null as double) speed, cast(null as long) previous_owner, 0D held_for"
    assert {r.f: r.state for r in possession.decide(two.selectExpr("*", *more.split(", "))).collect()} == {0: "contested", 1: "loose_ball"}


def test_event_ids_repeat_and_empty_tables_stay_empty(spark):
    spans = spark.createDataFrame(
        [(0, 0, "controlled", "A", 1, 1, 2, 0.0, 1.0, 1.0, 0.9, 10.0, 10.0, 30.0, 10.0), (0, 1, "controlled", "A", 2, 3, 4, 1.5, 2.0, 0.5, 0.8, 50.0, 10.0, 50.0, 10.0), (0, 2, "controlled", "B", 3, 5, 6, 2.5, 3.0, 0.5, 0.8, 53.0, 10.0, None, None)],
        "video long, span long, state string, team_id string, track_id long, start_frame long, end_frame long, start_t double, end_t double, duration double, confidence double, start_x double, start_y double, end_x double, end_y double",
    )
    ball = spark.createDataFrame([(0, f, "observed" if f < 4 else "unknown") for f in range(1, 7)], "video long, frame_idx long, state string")
    directions = spark.createDataFrame([(0, "A", 1), (0, "B", -1)], "video long, team_id string, direction int")
    out = match_events.detect(spans, ball, directions).collect()
    kinds = {(r.event_type, r.frame_idx): r for r in out}
    assert {("pass", 2), ("pass_progressive", 2), ("carry", 1), ("dribble_candidate", 1), ("turnover", 4), ("pass_failed", 4), ("interception", 5)} <= set(kinds)
    assert abs(kinds["turnover", 4].confidence - 0.8 * 0.2) < 1e-12 and kinds["pass", 2].confidence == 0.8
    assert {r.event_id for r in out} == {r.event_id for r in match_events.detect(spans.repartition(3), ball, directions).collect()} and len({r.event_id for r in out}) == len(out)
    assert match_events.detect(spans.where("video > 0"), ball, directions).count() == 0
    assert edits.broken_rules(spans.where("video > 0"), {"x": spans["span"] > 0}).collect()[0].n_rows == 0
