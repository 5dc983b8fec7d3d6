"""Association, online tracking and detection scores against plain versions: missing values, ties, repeated rows, hot videos, empty tables, restarts."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import association, detection, ordered, tracker
from touchline.operators.graph import components
from touchline.streaming import tracking

OBS = "video string, track_id long, object_class string, frame long, x1 double, y1 double, x2 double, y2 double, interpolated boolean, cost double"


def _tracklets(rng, n, video):
    """Fragments of a few runners, near enough for gates to bite either way."""
    rows = []
    for t in range(n):
        start, x, y, h = rng.randrange(0, 120), rng.uniform(0, 400), rng.uniform(0, 200), rng.uniform(50, 90)
        vx = rng.uniform(-3, 3)
        for k in range(rng.choice([1, 2, 5, 15, 30])):
            cx = x + vx * k + rng.uniform(-1, 1)
            rows.append((video, t * 3 + 1, rng.choice(["player"] * 9 + ["referee"]) if k == 0 else rows[-1][2], start + k, cx - 20, y - h / 2, cx + 20, y + h / 2, k % 7 == 3, 0.0))
    return rows


class Plain:
    """The same association, all pairs and all matchings of a video written out."""

    def __init__(self, rows, calibration, looks, rules):
        self.rules, self.calibration, self.looks = rules, calibration, looks
        self.tracks = {}
        for _, t, cls, f, x1, y1, x2, y2, inter, _ in rows:
            if not inter and x1 is not None:
                self.tracks.setdefault(t, {"cls": cls, "obs": {}})["obs"].setdefault(f, (x1, y1, x2, y2))
        self.tracks = {t: v for t, v in self.tracks.items() if v["obs"]}

    def pitch(self, obs, late):
        for f in sorted(obs, reverse=late)[: self.rules.probe]:
            c = self.calibration.get(f)
            if c and c[0] and c[1] >= self.rules.min_calibration:
                h, (x1, _, x2, y2) = c[2], obs[f]
                w = h[6] * (x1 + x2) / 2 + h[7] * y2 + h[8]
                return (h[0] * (x1 + x2) / 2 + h[1] * y2 + h[2]) / w, (h[3] * (x1 + x2) / 2 + h[4] * y2 + h[5]) / w, f
        return None

    def cost(self, a, b):
        r, (oa, ob) = self.rules, (self.tracks[a]["obs"], self.tracks[b]["obs"])
        centre = lambda q: np.array([(q[0] + q[2]) / 2, (q[1] + q[3]) / 2])
        gap = min(ob) - max(oa)
        if gap <= 0:
            return "temporal_overlap", None
        if gap > r.max_gap:
            return "gap_too_long", None
        if self.tracks[a]["cls"] != self.tracks[b]["cls"]:
            return "class_mismatch", None
        height = lambda q: q[3] - q[1]
        ratio = height(oa[max(oa)]) / max(1e-6, height(ob[min(ob)]))
        if not r.size_ratio[0] <= ratio <= r.size_ratio[1]:
            return "size_inconsistent", None
        tail, head = self.pitch(oa, True), self.pitch(ob, False)
        if tail and head:
            d, limit = math.dist(tail[:2], head[:2]), r.max_speed_m_s * max(1, head[2] - tail[2]) / r.fps + r.slack_m
            if d > limit:
                return "pitch_distance_exceeded", None
            geometry, kind = d / limit, "pitch"
        else:
            if gap > r.max_image_gap:
                return "long_gap_without_pitch_evidence", None
            last = sorted(oa)[-r.speed_over :]
            speed = (centre(oa[last[-1]]) - centre(oa[last[0]])) / max(1, last[-1] - last[0])
            d, limit = float(np.linalg.norm(centre(oa[max(oa)]) + speed * gap - centre(ob[min(ob)]))), r.max_distance_px + r.px_per_frame * gap
            if d > limit:
                return "image_distance_exceeded", None
            geometry, kind = d / limit, "image"
        u, v = self.looks.get(a), self.looks.get(b)
        look = 0.5
        if u is not None and v is not None and any(u) and any(v):
            look = min(1.0, max(0.0, 1 - float(np.dot(u, v)) / float(np.linalg.norm(u) * np.linalg.norm(v))))
            if look > r.appearance_reject:
                return "appearance_mismatch", None
        w = r.weights
        return kind, w[0] * geometry + w[1] * look + w[2] * gap / r.max_gap + w[3] * abs(math.log(ratio))

    def run(self):
        home, counts = {t: t for t in self.tracks}, []
        for _ in range(self.rules.max_rounds):
            costs, reasons = {}, {}
            for a, b in itertools.permutations(self.tracks, 2):
                kind, c = self.cost(a, b)
                if c is None:
                    reasons[kind] = reasons.get(kind, 0) + 1
                else:
                    reasons["admitted"] = reasons.get("admitted", 0) + 1
                    costs[a, b] = c
            counts.append(reasons)
            chosen = {p for p in _best(costs) if costs[p] < self.rules.max_cost}
            later = {b for _, b in chosen}
            merges = [(a, b) for a, b in chosen if a not in later]
            if not merges:
                break
            for a, b in merges:
                self.tracks[a]["obs"].update(self.tracks.pop(b)["obs"])
                home = {t: a if h == b else h for t, h in home.items()}
        return {(t, h) for t, h in home.items() if t != h}, counts


def _best(costs):
    """The largest and then cheapest set of pairs, by trying every choice for one tail after the other."""
    tails = sorted({a for a, _ in costs})

    def search(i, used):
        if i == len(tails):
            return 0, 0.0, []
        best = search(i + 1, used)
        for (a, b), c in costs.items():
            if a == tails[i] and b not in used:
                n, total, pairs = search(i + 1, used | {b})
                if (n + 1, -(total + c)) > (best[0], -best[1]):
                    best = n + 1, total + c, [(a, b), *pairs]
        return best

    return search(0, frozenset())[2]


@pytest.mark.parametrize("seed", range(3))
def test_association_is_the_cheapest_of_all_matchings(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rules = association.Rules(max_rounds=6)
    rows, cal, looks = {}, {}, {}
    for v in ("a", "b", "c"):
        rows[v] = _tracklets(rng, 8, v)
        cal[v] = {f: (f % 4 != 0, rng.choice([0.4, 0.5, 0.9]), [0.1, 0.0, 1.0, 0.0, 0.1, 2.0, 0.0, 0.0, 1.0]) for f in range(0, 160, rng.choice([1, 40]))}
        looks[v] = {t * 3 + 1: rng.choice([None, [0.0, 0.0], [1.0, 0.2], [0.3, 1.0], [-1.0, 0.1]]) for t in range(8)}
    every = [r for v in rows.values() for r in v]
    every += every[:5] + [("a", 1000, "player", 5, None, 1.0, 2.0, 3.0, False, 0.0), ("a", 1001, "player", 5, 0.0, 1.0, 2.0, 3.0, True, 0.0)]
    o = spark.createDataFrame(every, OBS).repartition(3)
    c = spark.createDataFrame([(v, f, *x) for v, fs in cal.items() for f, x in fs.items()], "video string, frame long, valid boolean, confidence double, homography array<double>")
    k = spark.createDataFrame([(v, t, x) for v, ts in looks.items() for t, x in ts.items()], "video string, track_id long, vector array<double>")
    if seed == 1:
        monkeypatch.setattr(association, "BATCH_PAIRS", 2)  # every video is split by components found with joins
    out = association.associate(o, ["video"], c, k, rules)
    got = {(r.video, r.track_id, r.survivor) for r in out.survivors.collect()}
    want, refusals = set(), {}
    for v in rows:
        pairs, counts = Plain(rows[v], cal[v], looks[v], rules).run()
        want |= {(v, *p) for p in pairs}
        refusals |= {(v, i, reason): n for i, x in enumerate(counts, 1) for reason, n in x.items()}
    assert got == want
    assert want
    assert {(r.video, r["round"], r.reason): r.n for r in out.refusals.collect() if (r.video, r["round"], r.reason) in refusals} == refusals
    whole = association.merged(o, out.survivors, ["video"])
    assert whole.columns == o.columns and whole.count() == len(every)


def test_association_of_nothing(spark):
    none = spark.createDataFrame([], OBS)
    out = association.associate(none, ["video"])
    assert out.survivors.count() == out.rounds.count() == out.refusals.count() == 0


def test_linked_and_components_agree(spark):
    rng = random.Random(4)
    edges = list({(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(i, i + 1) for i in range(100, 140)})
    l, r = np.array(edges).T
    parts = association.linked(l, r)
    assert sorted(i for p in parts for i in p) == list(range(len(edges)))
    nodes = components(spark.createDataFrame([("v", a * 2, b * 2 + 1) for a, b in edges], "v string, a long, b long"), ["v"])
    of = {x.node: x.component for x in nodes.collect()}
    groups = {}
    for i, (a, b) in enumerate(edges):
        assert of[a * 2] == of[b * 2 + 1]
        groups.setdefault(of[a * 2], []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(p.tolist()) for p in parts)


class OneBox:
    """A track's filter with whole matrices, one box at a time."""

    def __init__(self, box):
        self.x = np.append(self.measure(box), np.zeros(4))
        h = self.x[3]
        self.p = np.diag(np.array([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2)
        self.hits, self.unseen, self.state = 1, 0, "new"

    @staticmethod
    def measure(b):
        w, h = max(1e-6, b[2] - b[0]), max(1e-6, b[3] - b[1])
        return np.array([b[0] + w / 2, b[1] + h / 2, w / h, h])

    def box(self):
        h = max(1e-6, self.x[3])
        w = max(1e-6, self.x[2] * h)
        return np.array([self.x[0] - w / 2, self.x[1] - h / 2, self.x[0] + w / 2, self.x[1] + h / 2])

    def predict(self):
        if self.state != "tracked":
            self.x[6:] = 0
        f = np.eye(8)
        f[:4, 4:] = np.eye(4)
        h = self.x[3]
        q = np.diag(np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2)
        self.x, self.p = f @ self.x, f @ self.p @ f.T + q
        self.unseen += 1

    def update(self, b):
        m, h = np.eye(4, 8), self.x[3]
        s = m @ self.p @ m.T + np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
        gain = self.p @ m.T @ np.linalg.inv(s)
        self.x, self.p = self.x + gain @ (self.measure(b) - m @ self.x), self.p - gain @ s @ gain.T
        self.state, self.unseen, self.hits = "tracked", 0, self.hits + 1


def _iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _cheapest(cost):
    """The cheapest assignment of the smaller side, by trying all."""
    n, m = cost.shape
    if not cost.size:
        return []
    if n > m:
        return [(j, i) for i, j in _cheapest(cost.T)]
    return list(enumerate(min(itertools.permutations(range(m), n), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))))


def _plain_tracks(frames, s):
    live, done, next_id = {}, {}, 1
    for frame in range(min(frames), max(frames) + 1):
        dets = sorted(d for d in frames.get(frame, []) if d[4] >= s.low)
        high, low = [d for d in dets if d[4] >= s.high], [d for d in dets if d[4] < s.high]
        for t in live.values():
            t.predict()
        ids = list(live)
        found = {}

        def match(mine, boxes, ceiling):
            cost = np.array([[1 - _iou(live[i].box(), d) for d in boxes] for i in mine]).reshape(len(mine), len(boxes))
            return [(mine[a], b) for a, b in _cheapest(cost) if cost[a, b] <= ceiling]

        taken = set()
        for i, b in match(ids, high, s.match):
            found[i] = high[b]
            taken.add(b)
        rest = [i for i in ids if i not in found and live[i].state == "tracked"]
        for i, b in match(rest, low, s.rescue):
            found[i] = low[b]
        for i in ids:
            t = live[i]
            if i in found:
                d = found[i]
                t.update(np.array(d[:4]))
                done[i].append((frame, *d[:4], d[4], 0.5 * d[4] + 0.5 * min(1.0, t.hits / 20), False))
            else:
                t.state = "lost"
                done[i].append((frame, *t.box(), 0.0, 0.4 * max(0.0, 1 - t.unseen / 30), True))
        for b, d in enumerate(high):
            if b not in taken and d[4] >= s.birth:
                live[next_id] = OneBox(d)
                done[next_id] = [(frame, *d[:4], d[4], d[4], False)]
                next_id += 1
        live = {i: t for i, t in live.items() if t.unseen <= s.buffer}
    out = set()
    for i, rows in done.items():
        while rows and rows[-1][-1]:
            rows.pop()
        out |= {(i, *(round(x, 6) if isinstance(x, float) else x for x in map(lambda v: float(v) if isinstance(v, (float, np.floating)) else v, r))) for r in rows}
    return out


def _scene(seed, frames=60):
    rng = random.Random(seed)
    rows = {}
    for k in range(4):
        x, y, vx = rng.uniform(0, 300), rng.uniform(0, 100), rng.uniform(-4, 4)
        for f in range(rng.randrange(10), frames):
            x += vx + rng.uniform(-1, 1)
            if rng.random() < 0.8 and not 20 + k < f < 20 + k * 5:
                rows.setdefault(f, []).append((x, y, x + 30, y + 70, rng.choice([0.05, 0.3, 0.55, 0.7, 0.9])))
    return rows


def _frame_rows(video, scene):
    return [(video, f, *d, "player") for f, ds in scene.items() for d in ds]


SIGHT = "video string, frame long, x1 double, y1 double, x2 double, y2 double, score double, object_class string"


def _rounded(rows):
    return {(r.track_id, r.frame, *(round(float(v), 6) for v in (r.x1, r.y1, r.x2, r.y2, r.det_confidence, r.track_confidence)), r.interpolated) for r in rows}


def test_tracks_equal_those_of_single_boxes(spark):
    s = tracker.Settings(buffer=8)
    scenes = {f"v{i}": _scene(i) for i in range(4)}
    rows = [r for v, sc in scenes.items() for r in _frame_rows(v, sc)]
    rows += [("v0", 3, None, None, None, None, None, None), ("v1", None, 1.0, 1.0, 2.0, 2.0, 0.9, "player"), ("v9", 1, 0.0, 0.0, 1.0, 1.0, 0.2, "player")]
    got = tracker.track(spark.createDataFrame(rows, SIGHT).repartition(5), ["video"], s).collect()
    for v, scene in scenes.items():
        mine = [r for r in got if r.video == v]
        assert _rounded(mine) == _plain_tracks(scene, s)
    assert not [r for r in got if r.video == "v9"]
    assert tracker.track(spark.createDataFrame([], SIGHT), ["video"]).count() == 0


def test_a_warp_carries_tracks_and_an_appearance_decides(spark):
    s = tracker.Settings()
    t = tracker.Tracks()
    box = np.array([[0.0, 0.0, 40.0, 80.0], [60.0, 0.0, 100.0, 80.0]])
    t.step(0, box, np.array([0.9, 0.9]), ["p", "p"], [np.array([1.0, 0.0]), np.array([0.0, 1.0])], None, s)
    shift = np.array([[1.0, 0.0, 500.0], [0.0, 1.0, 0.0]])
    out = t.step(1, box + [500, 0, 500, 0], np.array([0.9, 0.9]), ["p", "p"], None, shift, s)
    assert [r[0] for r in out] == [1, 2]
    near = np.array([[528.0, 0.0, 568.0, 80.0], [532.0, 0.0, 572.0, 80.0]])  # both between the two; the looks are crossed
    out = t.step(2, near, np.array([0.9, 0.9]), ["p", "p"], [np.array([0.0, 1.0]), np.array([1.0, 0.0])], None, s)
    assert {r[0]: r[2] for r in out} == {1: 532.0, 2: 528.0}


def test_a_long_gap_ends_all_tracks(spark):
    s, t = tracker.Settings(buffer=3), tracker.Tracks()
    import pandas as pd

    row = lambda f: {"frame": f, "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0, "score": 0.9, "object_class": "p"}
    out = tracker.advance(t, pd.DataFrame([row(0), row(1), row(10**9)]), s)
    assert [(r[0], r[1]) for r in out] == [(1, 0), (1, 1), (2, 10**9)]
    assert tracker.advance(t, pd.DataFrame([row(5)]), s) == []  # a frame that has passed


def test_streamed_tracks_survive_a_restart(spark, tmp_path):
    scenes = {f"v{i}": _scene(10 + i) for i in range(3)}
    rows = [r for v, sc in scenes.items() for r in _frame_rows(v, sc)]
    schema = f"{SIGHT}, ts timestamp"
    whole = spark.createDataFrame(rows, SIGHT).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_000_000))
    want = {(r.video, *x) for v in scenes for r in [type("R", (), {"video": v})] for x in _rounded(tracker.track(whole.where(F.col("video") == v), ["video"]).collect())}
    parts = [whole.where("frame < 17"), whole.where("frame >= 17 and frame < 18"), whole.where("frame >= 18"), spark.createDataFrame([(None,) * 8], SIGHT).withColumn("ts", F.timestamp_seconds(F.lit(4102444800)))]
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    with tracking.state_store(spark):
        for part in parts:  # every part is a run of its own from the checkpoint of the one before
            part.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            job = tracking.online_tracks(stream, "video", "ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            job.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {(r.video, *x) for r in got for x in _rounded([r])} == want
    assert len(got) == len(want)


DET = "frame long, object_class string, id long, x1 double, y1 double, x2 double, y2 double"


def _boxes(rng, n_frames):
    truth, found = [], []
    for f in range(n_frames):
        for i in range(rng.randrange(0, 6)):
            x, y, w, h = rng.choice([0, 10, 20, 40]), rng.choice([0, 10]), rng.choice([20, 30, 60]), rng.choice([30, 40])
            cls = rng.choice(["ball", "player"])
            truth.append((f, cls, i, float(x), float(y), float(x + w), float(y + h)))
            for j in range(rng.randrange(0, 3)):
                d = rng.choice([0, 0, 3, 6, 10])
                found.append((f, cls, 10 * i + j, float(x + d), float(y), float(x + w + d), float(y + h), rng.choice([0.1, 0.5, 0.5, 0.9, 0.3])))
    found += [(n_frames + 5, "player", 1, 0.0, 0.0, 9.0, 9.0, 0.9), (0, "horse", 99, 0.0, 0.0, 9.0, 9.0, 0.9), (1, "player", 98, 5.0, 5.0, 1.0, 1.0, 0.8)]
    return truth, found


def _plain_scores(truth, found, thresholds):
    frames = {r[0] for r in truth}
    out = {}
    for cls in {r[1] for r in truth}:
        rows = {t: [] for t in thresholds}
        small = hits = tp = 0
        for f in frames:
            g = sorted(r for r in truth if r[0] == f and r[1] == cls)
            p = sorted((r for r in found if r[0] == f and r[1] == cls), key=lambda r: (-r[7], r[2]))
            small += sum((r[5] - r[3]) * (r[6] - r[4]) < 1024 for r in g)
            for t in thresholds:
                free = list(g)
                for r in p:
                    best = max(free, key=lambda q: (_iou(q[3:7], r[3:7]), -q[2]), default=None)
                    hit = best is not None and _iou(best[3:7], r[3:7]) >= t
                    if hit:
                        free.remove(best)
                        if t == 0.5:
                            tp += 1
                            hits += (best[5] - best[3]) * (best[6] - best[4]) < 1024
                    rows[t].append((-r[7], f, r[2], hit))
        n = sum(r[1] == cls for r in truth)
        aps = []
        for t in thresholds:
            flags = np.array([r[3] for r in sorted(rows[t])])
            cum = np.cumsum(flags)
            precision = np.maximum.accumulate((cum / np.arange(1, len(cum) + 1))[::-1])[::-1] if len(cum) else np.empty(0)
            at = np.searchsorted(cum / n, np.linspace(0, 1, 101), side="left")
            aps.append(np.mean([precision[i] if i < len(precision) else 0.0 for i in at]))
        m = len(rows[thresholds[0]])
        out[cls] = (n, m, tp, m - tp, n - tp, round(aps[0], 9), round(float(np.mean(aps)), 9), small, hits / small if small else None)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", [1, 5])
def test_detection_scores(spark, seed, partitions, monkeypatch):
    truth, found = _boxes(random.Random(seed), 40)
    t, f = spark.createDataFrame(truth, DET), spark.createDataFrame([(*r, "x") for r in found], f"{DET}, score double, hit string").repartition(3)
    monkeypatch.setattr(detection, "BATCH_PAIRS", 30)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = detection.evaluate_detection(t, f, ["frame"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {r.object_class: (r.n_truth, r.n_found, r.tp, r.fp, r.fn, round(r.ap50, 9), round(r.ap50_95, 9), r.n_small, r.small_recall) for r in rows}
    assert got == _plain_scores(truth, found, list(detection.THRESHOLDS))
    pooled = detection.pooled_detection(spark.createDataFrame(rows)).first()
    assert pooled.ball_ap50 == next(r.ap50 for r in rows if r.object_class == "ball")


def test_detection_without_boxes(spark):
    none, nothing = spark.createDataFrame([], DET), spark.createDataFrame([], f"{DET}, score double")
    assert detection.evaluate_detection(none, nothing, ["frame"]).count() == 0
    one = spark.createDataFrame([(1, "ball", 1, 0.0, 0.0, 5.0, 5.0)], DET)
    r = detection.evaluate_detection(one, nothing, ["frame"]).first()
    assert (r.n_truth, r.n_found, r.tp, r.fn, r.precision, r.recall, r.ap50) == (1, 0, 0, 1, 0.0, 0.0, 0.0)
    counts = detection.frame_counts(one, nothing, ["frame"], spark.createDataFrame([(1,), (2,)], "frame long"))
    assert sorted(map(tuple, counts.collect())) == [(1, 0, 0, 1), (2, 0, 0, 0)]


def test_bootstrap_means(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a", float(x)) for i, x in enumerate(rng.random(400))] + [(i, None, float(i)) for i in range(4)] + [(900, "a", None), (901, "a", float("nan"))]
    df = spark.createDataFrame(rows, "frame long, cls string, value double")
    got = {r.cls: r for r in detection.bootstrap_means(df.repartition(7), ["frame"], ["cls"], "value").collect()}
    again = {r.cls: r for r in detection.bootstrap_means(df.coalesce(1), ["frame"], ["cls"], "value").collect()}
    x = np.array([r[2] for r in rows[:400]])
    assert got["a"].n == 400 and got["a"].mean == pytest.approx(x.mean())
    half = 1.96 * x.std() / 20
    assert got["a"].lower == pytest.approx(x.mean() - half, abs=half / 8) and got["a"].upper == pytest.approx(x.mean() + half, abs=half / 8)
    assert got["a"].lower == pytest.approx(again["a"].lower) and got["a"].upper == pytest.approx(again["a"].upper)
    assert (got[None].n, got[None].lower, got[None].upper) == (4, None, None)
    weights = detection.poisson_weights(rng.integers(-(2**63), 2**63, 3000), 200, 1)
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)
    assert detection.bootstrap_means(df.where("false"), ["frame"], ["cls"], "value").count() == 0


def test_running_sums_and_quantiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, float("nan"), 1.0, 1.0, rng.uniform(-5, 5)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(6)
    got = {r.i: (r.n, r.total) for r in ordered.running_sums(df, ["g"], [F.desc("i")], {"n": F.lit(1).cast("long"), "total": F.col("i")}).collect()}
    for g in ("hot", "b", None):
        mine = sorted((i for k, _, i in rows if k == g), reverse=True)
        assert [got[i] for i in mine] == [(n + 1, sum(mine[: n + 1])) for n in range(len(mine))]
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    for few in (10_000, 3):
        q = {(r.g, r.share): r.quantile for r in ordered.quantiles(df, ["g"], "v", shares, bins=7, few=few).collect()}
        for g in ("hot", "b", None):
            known = [v for k, v, _ in rows if k == g and v is not None and not math.isnan(v)]
            for s in shares:
                assert q[g, s] == pytest.approx(float(np.quantile(known, s)))
    assert ordered.quantiles(df.where("v is null"), ["g"], "v", shares).count() == 0
