"""Profiles and heatmaps against plain counts: tracks without events, nulls, ties, empty tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.operators import profiles
from touchline.operators.match_events import EVENT

PHYS = "video_id string, track_id long, n_rows long, n_usable long, duration double, distance double, walking_m double, jogging_m double, running_m double, high_speed_m double, sprinting_m double, mean_speed double, top_speed double, n_accelerations long, n_decelerations long, n_rejected long, n_sprints long, sprint_distance double, coverage double, confidence double"
TYPES = ["ball_touch", "pass", "pass_successful", "pass_failed", "carry", "shot", "goal_candidate", "clearance", "turnover", "interception", "recovery"]
FRAMES = 40


@pytest.fixture(scope="module")
def match(spark):
    rng = random.Random(3)
    state, labels, phys = [], [], []
    for t in range(6):
        team = "AB"[t % 2] if t < 5 else "unknown"
        labels.append(("v", t, team, 0.1 * t, "goalkeeper" if t in (0, 1) else "outfield"))
        for f in range(FRAMES):
            if rng.random() < 0.8:
                ok = rng.random() < 0.7
                state.append(("v", f, f * 0.04, "player", t, team, rng.uniform(-5, 110) if ok else None, rng.uniform(0, 68) if ok else None, "valid" if ok else "no_calibration"))
        phys.append(("v", t, 30, 20, 1.0, 10.0 * t, 1.0, 2.0, 3.0, 4.0, 0.0, 1.5, 3.0, t, 0, 0, t, 0.0, 0.66, 0.5))
    ball = [("v", f, f * 0.04, rng.uniform(0, 105) if f % 3 else None, rng.uniform(0, 68) if f % 3 else None, "observed" if f % 3 else "unknown") for f in range(FRAMES)]
    events = [("v", rng.choice(TYPES), rng.randrange(FRAMES), None, rng.choice([None, *range(5)]), rng.choice([None, *range(5)]), 0.5, rng.choice([None, rng.uniform(0, 105)]), rng.uniform(0, 68), rng.uniform(0, 105), rng.uniform(0, 68), rng.choice([5.0, 30.0, None]), None) for _ in range(200)]
    events = [(*e[:3], None if e[4] is None else "AB"[e[4] % 2], *e[4:]) for e in events]
    spans = [("v", i, "controlled" if i % 3 else "loose_ball", "AB"[i % 2] if i % 3 else "unknown", i % 5 if i % 3 else None, 4 * i, 4 * i + 3, 0.12) for i in range(10)]
    make = spark.createDataFrame
    types = {"video": "string", "event_type": "string", "frame_idx": "long", "team_id": "string", "track_id": "long", "related_track_id": "long"}
    return {
        "rows": (state, labels, phys, ball, events, spans),
        "state": make(state, "video_id string, frame_idx long, timestamp_s double, object_class string, track_id long, team_id string, pitch_x double, pitch_y double, validation_status string").repartition(3),
        "labels": make(labels, "video_id string, track_id long, team_id string, team_confidence double, role string"), "phys": make(phys, PHYS),
        "ball": make(ball, "video_id string, frame_idx long, timestamp_s double, x double, y double, ball_state string"), "events": make(events, ", ".join(f"{c} {types.get(c, 'double')}" for c in EVENT)),
        "spans": make(spans, "video string, span long, state string, team_id string, track_id long, start_frame long, end_frame long, duration double"), "frames": make([("v", f, f * 0.04) for f in range(FRAMES)], "video_id string, frame_idx long, timestamp_s double"),
    }


def test_metrics(spark, match):
    state, labels, phys, ball, events, spans = match["rows"]
    cover = profiles.track_coverage(match["state"], match["ball"], match["phys"], match["labels"])
    c = {r.track_id: r for r in cover.collect()}
    known = {b[1] for b in ball if b[5] != "unknown"}
    for t in range(6):
        mine = [r for r in state if r[4] == t]
        assert c[t].tracking == len(mine) / FRAMES and c[t].ball == pytest.approx(sum(r[1] in known for r in mine) / len(mine)) and c[t].identity == pytest.approx(0.1 * t)
    players = profiles.player_metrics(cover, match["phys"], match["events"], match["spans"])
    got = {(r.track_id, r.metric): r for r in players.collect()}
    assert len(got) == players.count() == 6 * (len(profiles.PHYSICAL) + len(profiles.COUNTS) + len(profiles.RELATED) + 3)
    for t in range(6):
        own = Counter(e[1] for e in events if e[4] == t)
        related = [e for e in events if e[5] == t]
        for name, kind in profiles.COUNTS.items():
            r = got[t, name]
            assert (r.value, r.n_samples) == (own[kind], sum(own.values()) + len(related)) and r.confidence == pytest.approx(c[t].ball * max(0.2, 0.1 * t))
        assert got[t, "passes_received"].value == sum(e[1] == "pass_successful" for e in related)
        assert got[t, "possession_time_s"].value == pytest.approx(sum(s[7] for s in spans if s[4] == t and s[2] == "controlled"))
        r = got[t, "pass_accuracy_pct"]
        assert (r.value, r.coverage) == ((pytest.approx(100 * own["pass_successful"] / own["pass"]), c[t].ball) if own["pass"] else (None, 0.0))
        assert got[t, "distance_m"].value == 10.0 * t
    team = {(r.team_id, r.metric): r for r in profiles.team_metrics(players, match["labels"], cover).collect()}
    assert {k[0] for k in team} == {"A", "B"} and team["A", "distance_m"].value == 60.0 and team["A", "distance_m"].n_players == 3
    keep = {(r.track_id, r.metric): r.value for r in profiles.keeper_metrics(players, match["labels"], match["events"]).collect()}
    assert keep[0, "shots_faced"] == sum(e[1] == "shot" and e[3] == "B" for e in events) and keep[1, "goal_candidates_conceded"] == sum(e[1] == "goal_candidate" and e[3] == "A" for e in events)
    mine = [e for e in events if e[4] == 0 and e[1] in ("pass", "clearance")]
    assert keep[0, "long_distributions"] == sum((e[11] or 0) >= 25 for e in mine) and keep[0, "distance_m"] == 0.0 and (2, "shots_faced") not in keep
    none = {k: v.where("false") for k, v in match.items() if k != "rows"}
    empty = profiles.track_coverage(none["state"], none["ball"], none["phys"], none["labels"])
    assert profiles.player_metrics(empty, none["phys"], none["events"], none["spans"]).count() == profiles.keeper_metrics(players, none["labels"], match["events"]).count() == 0


@pytest.mark.parametrize("phase", ["all", "in_possession", "defending"])
@pytest.mark.parametrize("half", [None, 1, 2])
def test_heatmaps(spark, match, phase, half):
    state, labels, _, ball, events, spans = match["rows"]
    speed = {(t, f): (t * 7 + f) % 9 * 1.0 for t in range(6) for f in range(FRAMES) if f % 5}
    speeds = spark.createDataFrame([("v", t, f, s) for (t, f), s in speed.items()], "video_id string, track_id long, frame_idx long, speed double")
    switches = spark.createDataFrame([("v", 0.8)], "video_id string, switch_s double")
    points = profiles.heatmap_points(match["state"], match["frames"], match["ball"], match["events"], match["spans"], speeds, phase, (0.0, 1.4), half, switches)
    grids = {(r.kind, r.team_id, r.gx, r.gy): (r.share, r.n) for r in profiles.heatmap_grids(points, ["video_id", "kind", "team_id"]).collect()}
    owner = {f: (s[3], s[4]) for s in spans if s[2] == "controlled" for f in range(s[5], s[6] + 1)}
    fits = lambda f: f * 0.04 <= 1.4 and half in (None, 2 if f * 0.04 >= 0.8 else 1)
    want = defaultdict(float)
    count = Counter()

    def put(kind, team, x, y, w=1.0):
        if x is not None and y is not None and team is not None:
            key = (kind, team, max(0, min(25, int(x / 105 * 26 // 1))), max(0, min(16, int(y / 68 * 17 // 1))))
            want[key] += w
            count[key] += 1

    for _, f, _, _, t, team, x, y, status in state:
        if status != "valid" or not fits(f):
            continue
        mine = owner.get(f, (None,))[0] == team
        if team in ("A", "B") and (phase == "in_possession" and not mine or phase == "defending" and mine):
            continue
        s = speed.get((t, f), 0.0)
        put("position", team, x, y)
        put("influence", team, x, y, 1 + s / 5)
        if s >= 5.5:
            put("sprints", team, x, y)
    for f, (team, _) in owner.items():
        if f < FRAMES and fits(f):
            put("possession", team, *ball[f][3:5])
    for kind, (types, end) in profiles.EVENT_KINDS.items():
        for e in events:
            if e[1] in types and fits(e[2]):
                put(kind, e[3], *(e[7:9] if end == "start" else e[9:11]))
    totals = defaultdict(float)
    for k, w in want.items():
        totals[k[:2]] += w
    assert {k: n for k, (_, n) in grids.items()} == dict(count)
    for k, (share, _) in grids.items():
        assert share == pytest.approx(want[k] / totals[k[:2]])
    with pytest.raises(ValueError, match="phase"):
        profiles.heatmap_points(match["state"], match["frames"], match["ball"], match["events"], match["spans"], speeds, "resting")
