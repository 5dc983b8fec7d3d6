"""Steps that many small groups or few large ones slowed down: the whole job, without a task or a call for each group."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators import association, ball, detection, game_state, graph, joins, match_events, motion, neighbours, scoring, tracker, tracklets
from touchline.streaming import tracking as streamed


def test_segments_are_smoothed_together_as_they_are_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(t), float(rng.normal()), float(rng.normal())) for s in range(300) for t in np.cumsum(rng.random(s % 9 + 1))]
    df = spark.createDataFrame(rows, "s long, t double, x double, y double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # segments go on over batches
    try:
        found = motion.smooth_tracks(df, ["s"], "t", "x", "y").collect()
        plan = motion.smooth_tracks(df, ["s"], "t", "x", "y")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.s, r.t): (r.smooth_x, r.smooth_y, r.speed) for r in found}
    assert len(got) == len(rows) and "FlatMapGroupsInPandas" not in plan
    for s in range(300):
        mine = np.array([r[1:] for r in rows if r[0] == s])
        place, speed = motion.constant_velocity_smoother(mine[:, 0], mine[:, 1:], 0.5, 3.0)
        want = np.column_stack([place, np.hypot(*speed.T)])
        assert np.allclose([got[s, t] for t in mine[:, 0]], want, atol=1e-9)


def test_groups_share_the_weights_of_their_units(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), c, float(rng.random())) for i in range(300) for c in "ab" for _ in range(int(rng.integers(0, 3)))]
    df = spark.createDataFrame(rows, "frame long, cls string, value double")
    found = {r.cls: r for r in detection.bootstrap_means(df.coalesce(1), ["frame"], ["cls"], "value", replicates=200).collect()}
    units = {r.frame: r.h for r in df.selectExpr("frame", "xxhash64(frame) as h").distinct().collect()}
    for c in "ab":
        mine = [r for r in rows if r[1] == c]
        w = detection.poisson_weights(np.array([units[r[0]] for r in mine]), 200, 0)
        means = (np.array([r[2] for r in mine]) @ w) / w.sum(0)
        assert np.allclose([found[c].lower, found[c].upper], np.quantile(means, [0.025, 0.975]))


def test_average_precision_sorts_rows_once_for_all_thresholds(spark, monkeypatch):
    counted = []
    real = detection.running_sums
    monkeypatch.setattr(detection, "running_sums", lambda rows, *a: counted.append(rows.count()) or real(rows, *a))
    box = "frame long, object_class string, id long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(f, "ball", 1, 0.0, 0.0, 10.0, 10.0) for f in range(20)], box)
    found = spark.createDataFrame([(f, "ball", 1, 0.0, 0.0, 10.0, 10.0 - f % 5, 0.5) for f in range(20)], box + ", score double")
    r = detection.evaluate_detection(truth, found, ["frame"]).first()
    assert counted == [20] and r.tp == 20 and r.ap50 == 1.0


def test_nearest_in_class_is_the_brute_force_whatever_copies_nulls_and_lengths(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(40)]
    rows = [(i, int(rng.integers(0, 3)), vectors[int(rng.integers(0, 40))]) for i in range(150)]
    rows += [(200, 0, None), (201, 0, [1.0, None, 2.0]), (202, 1, [1.0, 2.0]), (203, 1, [2.0, 4.0]), (204, None, [1.0, 1.0, 1.0]), (205, 2, [float("nan"), 1.0, 1.0])]
    rows += [(300, 5, [0.0, 0.0]), (301, 5, [0.0, 0.0]), (302, 6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    p = df.selectExpr("vec_id query_id", "label", "embedding q").join(df, "label").where("query_id <> vec_id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    want = p.withColumn("cosine", expr.cosine(F.col("q"), F.col("embedding"))).withColumn("n", n).where("n <= 3").select("query_id", "vec_id", "cosine")
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    found = neighbours.nearest_in_class(df, "label", "vec_id", "embedding", 3)
    key = lambda t: sorted((r.query_id, r.vec_id, repr(r.cosine)) for r in t.collect())
    assert key(found) == key(want)
    assert "zip_with" not in found._jdf.queryExecution().toString()  # no pair of vectors leaves a cell


def test_a_long_list_is_matched_in_little_memory_and_as_before(monkeypatch):
    rng = np.random.default_rng(7)
    short = [(np.sort(rng.integers(0, 60, int(rng.integers(0, 40)))).astype(float), np.sort(rng.integers(0, 60, int(rng.integers(0, 40)))).astype(float), float(rng.integers(0, 9))) for _ in range(200)]
    whole = [joins.match_sorted(*x).tolist() for x in short]
    a, b = (np.sort(rng.integers(0, 12_000, 12_000)).astype(float) for _ in "ab")
    tracemalloc.start()
    found = joins.match_sorted(a, b, 1000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(found) == 12_000  # 530 MB when every window is kept
    monkeypatch.setattr(joins, "KEPT_CELLS", 0)
    assert [joins.match_sorted(*x).tolist() for x in short] == whole


def test_a_large_component_is_matched_over_its_edges_only():
    rng = np.random.default_rng(8)
    for _ in range(300):
        table = np.where(rng.random((6, 7)) < rng.random(), rng.integers(0, 5, (6, 7)), 1000.0)
        l, r = np.nonzero(table < 1000)
        if len(l):
            picked = association.cheapest_matching(np.unique(l, return_inverse=True)[1], np.unique(r, return_inverse=True)[1], table[l, r])
            assert len(set(l[picked])) == len(set(r[picked])) == len(picked)
            best = table[np.arange(6), joins.assign(table)].sum()
            assert (len(picked), table[l, r][picked].sum()) == (6 - best // 1000, best % 1000)
    n = 3000  # row i meets columns i and i + 1; two tables of rows by columns are 144 MB
    l, r, cost = np.repeat(np.arange(n), 2), np.repeat(np.arange(n), 2) + np.tile([0, 1], n), np.tile([1.0, 0.0], n)
    tracemalloc.start()
    picked = association.cheapest_matching(l, r, cost)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and len(picked) == n and cost[picked].sum() == 0


def test_pairs_of_a_frame_get_more_tasks_with_more_rows(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id div 4 frame", "id % 4 id")
    assert joins.spread(rows, "frame").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(joins, "TASK_ROWS", 40)
    dealt = joins.spread(rows, "frame")
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 400
    assert dealt.select("frame", F.spark_partition_id().alias("p")).distinct().count() == 100
    pairs = dealt.selectExpr("frame", "id a").join(dealt.selectExpr("frame", "id b"), "frame")
    assert pairs._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1 and pairs.count() == 1600


def test_a_search_compares_places_and_not_the_candidates_on_them(monkeypatch):
    rng = np.random.default_rng(9)
    nodes = np.array(sorted(((f, float(x), float(x % 3), round(float(c), 2)) for f in range(20) for x, c in zip(rng.integers(0, 5, 100), rng.random(100), strict=True)), key=lambda r: (r[0], -r[3])))
    cells, real = [], np.hypot
    monkeypatch.setattr(tracklets.np, "hypot", lambda *a: cells.append(real(*a).size) or real(*a))
    score, parent = tracklets.search(nodes, 13, 4.0)
    monkeypatch.undo()
    assert sum(cells) <= 20 * 5 * 13 * 5  # every candidate with every one before it: 2,000,000 and more
    for i, (f, x, y, c) in enumerate(nodes):
        total = [score[j] + c - 0.6 * float(np.hypot(q[1] - x, q[2] - y)) / (4.0 * (f - q[0])) - 0.8 * (f - q[0] - 1) / 12 if f - 13 <= q[0] < f and np.hypot(q[1] - x, q[2] - y) <= 4.0 * (f - q[0]) else -np.inf for j, q in enumerate(nodes)]
        k = int(np.argmax(total))
        assert (score[i], parent[i]) == ((total[k], k) if total[k] > c else (c, -1))


def test_candidates_of_one_place_share_a_search_and_end_as_they_would_alone(spark):
    rng = np.random.default_rng(10)
    rows = [("v", int(f), int(i), float(rng.integers(0, 4)) * 5, float(rng.integers(0, 2)) * 5, float(rng.integers(1, 4)) / 4) for i, f in enumerate(rng.choice([0, 1, 2, 3, 9, 10, 11, 30, 31, 60], 400))]
    rows += rows[:40]  # rows that repeat an id too
    rules = ball.PathRules(speed=4.0, max_gap=3, min_path=3)
    out = ball.paths(spark.createDataFrame(rows, "video string, frame long, id long, x double, y double, confidence double").repartition(5), ["video"], rules)
    got = sorted((r.frame, r.id, r.path, r.reason or "") for r in out.collect())
    assert len(got) == len(rows)
    want = []
    for stretch in ([0, 1, 2, 3], [9, 10, 11], [30, 31], [60]):
        mine = sorted((r for r in rows if r[1] in stretch), key=lambda r: (r[1], -r[5], r[2]))
        nodes = np.array([(r[1], *r[3:]) for r in mine])
        path, short = ball.peel(nodes, 4, 4.0, 3)[:2]
        reason = np.where(path >= 0, "", np.where(short, "segment_too_short", "not_on_any_accepted_path")).astype(object)
        on = np.flatnonzero(path >= 0)
        if len(on) > 2:
            reason[on[1:-1][ball._jerks(nodes[on], 4, rules.max_accel)]] = "implausible_acceleration"
        want += [(r[1], r[2], int(p), w) for r, p, w in zip(mine, path, reason, strict=True)]
    assert got == sorted(want) and {"segment_too_short", "not_on_any_accepted_path", ""} <= {w[3] for w in want}


@pytest.mark.parametrize("seed", range(6))
def test_an_assignment_over_overlapping_pairs_costs_what_the_whole_one_does(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, m = rng.integers(1, 12, 2)
        cost = np.where(rng.random((n, m)) < 0.5, 1.0, rng.integers(0, 8, (n, m)) / 8 if seed % 2 else rng.random((n, m)))
        i, j = np.nonzero(cost < 1)
        edges = tracker.cheapest_pairs(i, j, cost[i, j])
        assert len(set(i[edges])) == len(set(j[edges])) == len(edges)
        whole = cost if n <= m else cost.T
        want = sum(whole[r, c] for r, c in enumerate(joins.assign(whole)))
        assert cost[i[edges], j[edges]].sum() + (min(n, m) - len(edges)) == pytest.approx(want)


def test_a_frame_of_many_boxes_compares_those_that_meet_only():
    at = np.arange(2500)
    boxes = np.stack([at % 50 * 30.0, at // 50 * 30.0, at % 50 * 30.0 + 20, at // 50 * 30.0 + 20], axis=1)
    tracks, score, kinds = tracker.Tracks(), np.full(2500, 0.9), ["p"] * 2500
    tracks.step(0, boxes, score, kinds, None, None, tracker.Settings())
    tracemalloc.start()
    out = tracks.step(1, boxes + 1, score, kinds, None, None, tracker.Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(r[0] for r in out) == list(range(1, 2501))
    assert peak < 40e6  # a table of tracks by boxes has 50 MB


class _Store:
    """A state store of one key that knows its largest value."""

    def __init__(self):
        self.values, self.largest, self.timers = {}, 0, []

    def getValueState(self, name, schema):
        return _Cell(self, name)

    def getMapState(self, name, key, value):
        return _Cell(self, name)

    def registerTimer(self, at):
        self.timers.append(at)


class _Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        return self.name in self.store.values

    def get(self):
        return self.store.values[self.name]

    def update(self, value):
        self.store.values[self.name] = value
        self._size(value)

    def clear(self):
        self.store.values.pop(self.name, None)

    def _size(self, value):
        self.store.largest = max([self.store.largest, *(len(v) for v in value if isinstance(v, bytes))])

    def keys(self):
        return list(self.store.values.setdefault(self.name, {}))

    def getValue(self, key):
        return self.store.values[self.name][key]

    def updateValue(self, key, value):
        self.store.values.setdefault(self.name, {})[key] = value
        self._size(value)

    def removeKey(self, key):
        del self.store.values[self.name][key]


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_rows_that_wait_are_kept_in_stretches_and_tracks_come_out_in_parts(monkeypatch):
    monkeypatch.setattr(tracker, "ROWS", 50)
    n = 4000
    f = np.random.default_rng(0).permutation(n)
    rows = pd.DataFrame({"video": 1, "ts": pd.to_datetime(f, unit="s"), "frame": f, "x1": f % 3 * 1.0, "y1": 0.0, "x2": f % 3 + 40.0, "y2": 90.0, "score": 0.9, "object_class": "p"})
    store = _Store()
    processor = streamed.OnlineTracker("video", "ts", tracker.Settings(), 10_000)
    processor.init(store)
    batches = iter([rows[a : a + 500] for a in range(0, n, 500)])
    assert not list(processor.handleInputRows((1,), batches, _Watermark(-1)))
    some = list(processor.handleExpiredTimer((1,), _Watermark(1_000_003), None))
    rest = list(processor.handleExpiredTimer((1,), _Watermark(10**10), None))
    assert store.largest < 40_000  # all rows at once take ten times that
    assert min(len(some), len(rest)) > 5 and max(map(len, some + rest)) < 100
    want = tracker.advance(tracker.Tracks(), rows, tracker.Settings())
    assert [r[1:] for part in some + rest for r in part.itertuples(index=False, name=None)] == want
    assert pd.concat(some)["frame"].max() == 1000 and not store.values.get("tracks") and not store.values["waiting"]


@pytest.mark.parametrize("steps", [3, 1000])
def test_a_frame_of_few_pairs_is_assigned_as_by_arrays(monkeypatch, steps):
    rng = np.random.default_rng(steps)
    cases = []
    for _ in range(400):
        n, m = rng.integers(1, 6, 2)
        g, p = np.nonzero(rng.random((n, m)) < 0.7)
        cases.append((g, p, rng.integers(1, steps + 1, len(g)) / steps))
    few = [scoring.best_pairs(*c) for c in cases]
    monkeypatch.setattr(joins, "assign", None)
    monkeypatch.setattr(scoring, "assign", None)  # no arrays for such frames
    assert [scoring.best_pairs(*c) for c in cases] == few
    monkeypatch.undo()
    monkeypatch.setattr(scoring, "FEW", 0)
    assert [sorted(scoring.best_pairs(*c)) if len(c[0]) else [] for c in cases if len(c[0])] == [sorted(f) for f in few if f]


def test_restarts_of_a_long_video_are_found_in_one_pass(spark):
    rng = np.random.default_rng(6)
    n = 3000
    states = rng.choice(["out_of_play", "unknown", "controlled", "loose_ball"], n, p=[0.3, 0.4, 0.1, 0.2])
    states[-500:] = "out_of_play"  # nobody takes the ball up again
    tracks = [int(i % 7) if s == "controlled" and i % 5 else None for i, s in enumerate(states)]
    rows = [("v", i, str(s), "A" if k is not None else None, k, i * 10, i * 10 + 9, i * 0.4, i * 0.4 + 0.36, 0.36, 0.5, 1.0, 2.0, 3.0, 4.0) for i, (s, k) in enumerate(zip(states, tracks, strict=True))]
    schema = "video string, span long, state string, team_id string, track_id long, start_frame long, end_frame long, start_t double, end_t double, duration double, confidence double, start_x double, start_y double, end_x double, end_y double"
    found = match_events.dead_and_contested(spark.createDataFrame(rows, schema).repartition(3))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()  # such a frame is read anew for each row
    want, ahead = [], None
    for i in range(n - 1, -1, -1):
        if states[i] == "out_of_play" and ahead is not None:
            want.append((ahead * 10, tracks[ahead]))
        if tracks[i] is not None:
            ahead = i
    got = [(r.frame_idx, r.track_id) for r in found.where("event_type = 'restart'").collect()]
    assert sorted(got) == sorted(want) and found.where("event_type = 'ball_out'").count() == (states == "out_of_play").sum()


def test_frames_never_pass_through_the_driver_however_small_their_files(spark, tmp_path):
    def stored(name, schema):
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        return spark.read.parquet(path)

    key = "video_id string, frame_idx long"
    people = stored("people", key + ", track_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, det_confidence double, track_confidence double, interpolated boolean")
    labels = stored("labels", "video_id string, track_id long, object_class string, team_id string, team_confidence double, role string, jersey_number int, jersey_confidence double")
    ball_rows = stored("ball", key + ", x double, y double, confidence double, method string")
    solves = stored("solves", key + ", homography array<double>, valid boolean, confidence double, segment_kind string, smoothed boolean")
    frames = stored("frames", key + ", timestamp_s double")
    state = game_state.assemble(people, labels, ball_rows, solves, frames)
    table = game_state.frame_table(frames, state, solves)
    spans = game_state.possession_spans(game_state.possession_by_frame(state, table))
    windows = spans.selectExpr("video", "start_frame as from_frame", "end_frame as to_frame")
    seen = game_state.ball_by_frame(state, table).selectExpr("video_id as video", "frame_idx", "ball_state as state")
    for df in (state, table, spans, match_events.coverage(windows, seen), game_state.physical_profiles(state)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spread", [1, 3])
def test_edges_are_folded_to_a_row_a_node(spark, monkeypatch, spread):
    monkeypatch.setattr(graph, "FOLD", 20)
    rng = np.random.default_rng(7)
    edges = [(v, int(a) * 2, int(b) * 2 + 1) for v in "ab" for a, b in [*rng.integers(0, 80, (90, 2)), *((i, i + 1) for i in range(100, 160))]]
    written = {}
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.setdefault(name, real(df, name)) if name == "stars" else real(df, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.v, r.node): r.component for r in graph.components(spark.createDataFrame(edges, "v string, a long, b long").repartition(5), ["v"], spread=spread).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    label = {(v, n): n for v, *ends in edges for n in ends}
    for _ in range(len(label)):
        for v, a, b in edges:
            label[v, a] = label[v, b] = min(label[v, a], label[v, b])
    assert found == label
    assert written["stars"].count() <= spread * len(label)


def test_refused_pairs_of_a_round_are_not_written(spark, monkeypatch):
    box = "video string, track_id long, object_class string, frame long, x1 double, y1 double, x2 double, y2 double, interpolated boolean"
    rows = [("v", t, "player" if t < 20 else "referee", 4 * t + k, 50.0 * t, 0.0, 50.0 * t + 20, 60.0, False) for t in range(40) for k in range(2)]
    written = []
    real = association.materialise
    monkeypatch.setattr(association, "materialise", lambda df, name: written.append((name, set(df.columns))) or real(df, name))
    out = association.associate(spark.createDataFrame(rows, box), ["video"])
    assert out.survivors.count() and {r.reason for r in out.refusals.collect()} >= {"class_mismatch", "image_distance_exceeded"}
    assert not any("refused" in columns for _, columns in written)


def test_a_dense_list_is_matched_with_two_bits_a_pair():
    rng = np.random.default_rng(8)
    a, b = (np.sort(rng.integers(0, 40_000, 12_000)).astype(float) for _ in range(2))
    tracemalloc.start()
    found = joins.match_sorted(a, b, 4000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (12_000, 2) and (np.diff(found, axis=0) > 0).all()
    assert peak < 2400 * 2 * 8 * np.sqrt(12_000) / 2  # half of what a state of 64 bits a pair takes, window by window


def test_hits_of_all_thresholds_are_sorted_as_one_number(spark, monkeypatch):
    types = []
    real = detection.running_sums
    monkeypatch.setattr(detection, "running_sums", lambda rows, *a: types.append(dict(rows.dtypes)["hits"]) or real(rows, *a))
    box = "frame long, object_class string, id long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(0, "ball", g, 0.0, 0.0, 10.0, 10.0) for g in range(2)], box)
    found = spark.createDataFrame([(0, "ball", p, 0.0, 0.0, 10.0, 10.0 - 3 * p, 0.5) for p in range(3)], box + ", score double")
    r = detection.evaluate_detection(truth, found, ["frame"]).first()
    # At 0.5 to 0.7 both true boxes are found by the first two ranks, from 0.75 on one is.
    assert types == ["bigint"] and r.tp == 2 and r.ap50 == 1.0 and abs(r.ap50_95 - (5 * 1.0 + 5 * 51 / 101) / 10) < 1e-9


def test_admitted_pairs_are_those_that_no_gate_refuses(spark):
    box = "video string, track_id long, object_class string, frame long, x1 double, y1 double, x2 double, y2 double, interpolated boolean"
    rows = [("v", t, "player" if t % 5 else "referee", 9 * t + k, 40.0 * (t % 7), 0.0, 40.0 * (t % 7) + 20, 60.0 + t % 3 * 30, False) for t in range(40) for k in range(2)]
    looks = spark.createDataFrame([("v", t, [1.0, 0.0] if t % 3 else [0.0, 1.0]) for t in range(0, 40, 2)], "video string, track_id long, vector array<double>")
    tracks = association.features(association.track_ends(spark.createDataFrame(rows, box), ["video"]), ["video"])
    whole = association.pair_costs(tracks, ["video"], looks).collect()
    some = association.pair_costs(tracks, ["video"], looks, admitted=True).collect()
    assert sorted(some) == sorted(r for r in whole if r.refused is None) and len({r.refused for r in whole}) > 3 and some
    gaps = {(a, b): 9 * b - 9 * a - 1 for a in range(40) for b in range(40) if 1 <= 9 * b - 9 * a - 1 <= 90}
    assert {(r.earlier, r.later) for r in whole} == set(gaps) and len(whole) == len(gaps)
