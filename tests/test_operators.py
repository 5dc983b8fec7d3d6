"""Window forms and matchers against plain folds over random short sequences."""

from __future__ import annotations

import itertools
import json
import random

import pytest

from touchline.operators import joins, sequence
from touchline.sources import tables


def _owner_fold(rows):
    owner = since = None
    out = {}
    for t, state, who in rows:
        out[t] = (owner, since)
        if state == "held":
            if who != owner:
                owner, since = who, t
        elif state in ("loose", "out"):
            owner = since = None
    return out


def test_owner_carry(spark):
    rng, rows, want = random.Random(3), [], {}
    for u in range(200):
        seq = [(t, rng.choice(["held", "held", "loose", "unknown", "contested", "out"]), rng.randrange(2)) for t in range(rng.randrange(1, 12))]
        want |= {(u, t): v for t, v in _owner_fold(seq).items()}
        rows += [(u, *x) for x in seq]
    df = spark.createDataFrame(rows, "u long, t long, state string, who long")
    out = sequence.owner_carry(df, ["u"], ["t"], "state", "who", "t", "held", ("loose", "out"))
    assert {(r.u, r.t): (r.previous_owner, r.held_since) for r in out.collect()} == want


def test_absorb_short(spark):
    rng, rows, want = random.Random(4), [], []
    for u in range(200):
        kept, t = [], 0
        for run in range(rng.randrange(1, 10)):
            state, d = rng.choice(["a", "b", "unknown"]), rng.choice([1, 5, 20])
            rows.append((u, run, state, t, t + d, d, 1.0))
            if kept and d < 10 and state != "unknown" and kept[-1][1] != "unknown":
                kept[-1][3] = t + d
            else:
                kept.append([u, state, t, t + d])
            t += d
        want += [tuple(k) for k in kept]
    df = spark.createDataFrame(rows, "u long, run long, state string, start_t long, end_t long, duration long, mean_value double")
    out = sequence.absorb_short(df, ["u"], "state", 10, "unknown").collect()
    assert sorted((r.u, r.state, r.start_t, r.end_t) for r in out) == sorted(want)


def test_assign_within_is_cheapest(spark):
    rng, a, b, want = random.Random(5), [], [], {}
    for u in range(60):
        x = [rng.randrange(30) for _ in range(rng.randrange(0, 5))]
        y = [rng.randrange(30) for _ in range(rng.randrange(0, 5))]
        a += [(u, i, t) for i, t in enumerate(x)]
        b += [(u, i, t) for i, t in enumerate(y)]
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        costs = [sum(abs(p - q) if abs(p - q) <= 4 else 1e6 for p, q in zip(small, pick)) for pick in itertools.permutations(large, len(small))]
        best = min(costs, default=0)
        want[u] = (len(small) - int(best // 1e6), best % 1e6)
    schema = "u long, id long, t long"
    out = joins.assign_within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["u"], "t", 4).collect()
    for u, (n, cost) in want.items():
        mine = [r for r in out if r.u == u]
        assert len(mine) == n and sum(r.error for r in mine) == cost
        assert len({r.truth_id for r in mine}) == len({r.found_id for r in mine}) == n


def test_keep_apart(spark):
    rows = [(0, 1, 0.0, 0.0, 0.9), (0, 2, 5.0, 0.0, 0.8), (0, 3, 11.0, 0.0, 0.7), (1, 1, 0.0, 0.0, 0.1)]
    out = joins.keep_apart(spark.createDataFrame(rows, "frame long, id long, x double, y double, s double"), ["frame"], "x", "y", "s", 10.0)
    assert sorted((r.frame, r.id) for r in out.collect()) == [(0, 1), (0, 3), (1, 1)]


def test_conform_names_the_null_column(spark):
    df = spark.createDataFrame([("v", None)], "video_id string, frame_idx int")
    with pytest.raises(Exception, match="detections.frame_idx is null"):
        tables.conform(df, "detections").collect()


def test_box_labels(spark):
    lines = spark.createDataFrame([("0 0.5 0.5 0.2 0.4",), ("1 0.5 0.5 0 0.1",), ("broken",)], "value string")
    assert [tuple(r) for r in tables.read_box_labels(lines, 100, 50).collect()] == [(0, 40.0, 15.0, 60.0, 35.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "u long, id long, t long, state string, v double")
    found = sequence.spans(none, ["u"], ["t"], ["state"], "t", "v")
    assert sequence.absorb_short(found, ["u"], "state", 1, "x").count() == 0
    assert sequence.segments(none, ["u"], ["t"], "t", 1).count() == 0
    assert joins.assign_within(none, none, ["u"], "t", 1).count() == 0


def test_annotation_files_round_trip(spark, tmp_path):
    from touchline.sources import labels

    doc = {"video_id": "v", "fps": 25.0, "frames": {"0": [{"object_class": "player", "track_id": 1, "bbox": [1, 2, 3, 4]}, {"object_class": "ball", "bbox": [5, 6, 7, 8]}], "7": []}}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    rows = labels.read_annotations(spark, str(tmp_path / "v.json"))
    want = {("v", 25.0, 0, "player", 1, 1.0, 2.0, 3.0, 4.0), ("v", 25.0, 0, "ball", None, 5.0, 6.0, 7.0, 8.0), ("v", 25.0, 7, None, None, None, None, None, None)}
    assert set(map(tuple, rows.collect())) == want
    labels.write_annotations(rows, str(tmp_path / "out"))
    assert set(map(tuple, labels.read_annotations(spark, str(tmp_path / "out")).collect())) == want
    s = labels.summary(rows).first()
    assert (s.n_frames, s.n_objects, s.n_tracks, s.by_class) == (2, 2, 1, {"ball": 1, "player": 1})


def test_sequence_and_action_files(spark, tmp_path):
    from touchline.sources import labels

    (tmp_path / "SEQ-1").mkdir()
    box = {"x": 1, "y": 2, "w": 3, "h": 4, "x_center": 2.5}
    doc = {
        "info": {"frame_rate": 25}, "images": [{"image_id": "i1", "file_name": "img/000012.jpg"}],
        "annotations": [{"image_id": "i1", "track_id": 3, "attributes": {"role": "player", "team": None}, "bbox_image": box, "bbox_pitch": {"x_bottom_middle": 0.5, "y_bottom_middle": 1.5}}, {"image_id": "none", "track_id": 4}],
    }
    (tmp_path / "SEQ-1" / "Labels.json").write_text(json.dumps(doc))
    assert [r.asDict() for r in labels.read_sequence_labels(spark, str(tmp_path / "SEQ-1" / "Labels.json")).collect()] == [
        {"sequence": "SEQ-1", "fps": 25.0, "track_id": 3, "role": "player", "team": "unknown", "x1": 1.0, "y1": 2.0, "x2": 4.0, "y2": 6.0, "pitch_x": 0.5, "pitch_y": 1.5, "frame_idx": 12}
    ]
    notes = [{"gameTime": "2 - 00:01", "position": "1500", "label": "Pass", "team": "Left", "visibility": "visible"}, {"gameTime": "x", "position": "?", "label": "odd", "team": None}]
    (tmp_path / "a.json").write_text(json.dumps({"annotations": notes}))
    assert [tuple(r)[1:] for r in labels.read_actions(spark, str(tmp_path / "a.json")).collect()] == [("Pass", "pass_start", 2, 1.5, "left", "visible"), ("odd", "unknown", None, None, None, None)]


def test_hysteresis_stream_is_the_fold(spark):
    from touchline.plans import registry
    from touchline.sources.tables import states

    out, want = registry.queries()["streamed_hysteresis"](spark, "/root/testdata/sf0.001").collect(), set()
    rows = {}
    for r in states(spark, "/root/testdata/sf0.001").collect():
        rows.setdefault(r.u, []).append((r.id, r.state != "error"))
    for u, seq in rows.items():
        on, run = False, 0
        for at, proposed in sorted(seq):
            run = run + 1 if proposed != on else 0
            if run >= (8 if on else 3):
                on, run = not on, 0
                want.add((u, at, on))
    assert {(r.u, r.at, r.is_on) for r in out} == want and len(want) > 10
