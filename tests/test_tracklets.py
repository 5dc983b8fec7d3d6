"""Stitching, paths and propagated calibrations against plain versions on small inputs."""

from __future__ import annotations

import random

import numpy as np

from touchline.operators import tracklets


def test_stitching_takes_the_cheapest_free_predecessor(spark):
    rng = random.Random(3)
    pairs = [(v, rng.randrange(40), 100 + later, later * 7 + v, round(rng.random() * 50, 3)) for v in range(2) for later in range(25) for _ in range(3)]
    pairs = [(v, a, b, f, c) for (v, a, b, f), c in {p[:4]: p[4] for p in pairs}.items()]
    # Predecessors end within the gap before their successors, so those far apart in time have other ids.
    pairs = [(v, a + 1000 * (f // 30), b, f, c) for v, a, b, f, c in pairs]
    taken, want = set(), set()
    for v, b, f in sorted({(p[0], p[2], p[3]) for p in pairs}, key=lambda k: (k[2], k[1])):
        free = sorted((c, a) for w, a, x, _, c in pairs if (w, x) == (v, b) and (v, a) not in taken)
        if free:
            taken.add((v, free[0][1]))
            want.add((v, free[0][1], b))
    df = spark.createDataFrame(pairs, "video long, earlier long, later long, later_first long, cost double")
    assert {(r.video, r.earlier, r.later) for r in tracklets.stitch(df, ["video"]).collect()} == want
    assert tracklets.stitch(df.limit(0), ["video"]).count() == 0


def test_chains_collapse_to_their_first(spark):
    links = [(1, k, k + 1) for k in range(20)] + [(1, 50, 51), (2, 7, 8)]
    out = tracklets.chain_heads(spark.createDataFrame(links, "video long, earlier long, later long"), ["video"]).collect()
    assert sorted((r.video, r.later, r.head) for r in out) == sorted([(1, k + 1, 0) for k in range(20)] + [(1, 51, 50), (2, 8, 7)])


def _score(path, reach, speed):
    total = path[0][3]
    for a, b in zip(path, path[1:], strict=False):
        gap, d = b[0] - a[0], float(np.hypot(b[1] - a[1], b[2] - a[2]))
        if not 1 <= gap <= reach or d > speed * gap:
            return -np.inf
        total += b[3] - 0.6 * d / (speed * gap) - 0.8 * (gap - 1) / (reach - 1)
    return total


def test_best_path_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(40):
        nodes = sorted((float(rng.randrange(8)), rng.random() * 9, rng.random() * 9, rng.random()) for _ in range(8))
        nodes.sort(key=lambda n: (n[0], -n[3]))
        best = max(_score([n for k, n in enumerate(nodes) if m >> k & 1], 3, 4.0) for m in range(1, 256))
        got = tracklets.best_path(np.array(nodes), 3, 4.0)
        assert abs(_score([nodes[k] for k in got], 3, 4.0) - best) < 1e-9


def test_trajectories_leave_unknown_places_out(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 0.9), (1, 1, 2, 1.0, 0.0, 0.9), (1, 1, 3, 500.0, 0.0, 0.95), (1, 2, 4, None, 0.0, 0.9), (1, 2, 5, 2.0, 0.0, 0.9), (1, 40, 6, 0.0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "video long, frame long, id long, x double, y double, confidence double")
    assert sorted(r.id for r in tracklets.trajectories(df, ["video"]).collect()) == [1, 2, 5, 6]


def test_propagated_homographies_are_matrix_products(spark):
    rng = np.random.default_rng(2)
    n, solves = 12, {3: 0.9, 9: 0.8}
    warps = [np.vstack([np.hstack([np.eye(2) + rng.normal(size=(2, 2)) * 0.05, rng.normal(size=(2, 1))]), [0, 0, 1]]) for _ in range(n)]
    homs = {f: np.eye(3) + rng.normal(size=(3, 3)) * 0.1 for f in solves}
    rows = [(1, f, f in solves, solves.get(f, 0.0), [float(v) for v in homs[f].ravel()] if f in solves else None, [float(v) for v in warps[f].ravel()[:6]] if f != 11 else None) for f in range(n)]
    df = spark.createDataFrame(rows, "video long, frame long, valid boolean, confidence double, homography array<double>, warp array<double>")
    out = {r.frame: r for r in tracklets.propagate_calibration(df, ["video"]).collect()}
    assert sorted(out) == [0, 1, 2, 4, 5, 6, 7, 8, 10]  # the warp of frame 11 is missing
    assert out[6].anchor_frame == 3  # equally far from both: the one before
    for f, r in out.items():
        a, h = r.anchor_frame, homs[r.anchor_frame]
        if f > a:
            for k in range(a + 1, f + 1):
                h = h @ np.linalg.inv(warps[k])
        else:
            for k in range(a, f, -1):
                h = h @ warps[k]
        assert np.abs(np.array(r.homography).reshape(3, 3) - h / h[2, 2]).max() < 1e-9
        assert abs(r.confidence - solves[a] * (1 - 0.02 * abs(f - a))) < 1e-12
