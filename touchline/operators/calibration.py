"""Homographies along a video: averages over a centred window that stops at cuts, drift between neighbouring frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators.ordered import around, positions, quantiles, running_sums
from touchline.operators.staging import materialise

#: Probe points of an average: 3 places from 0.1 to 0.9 of the width by 3 from 0.5 to 0.95 of the height; fixed values.
PROBES = [(0.1 + 0.4 * i, 0.5 + 0.225 * j) for j in range(3) for i in range(3)]
#: Least weight of a solve in an average; fixed value.
LEAST_WEIGHT = 1e-3


def normalised(h: list[Column]) -> list[Column]:
    """A homography scaled so that its last entry is 1; to unit length where that entry is 0."""
    norm = F.sqrt(sum((x * x for x in h[1:]), h[0] * h[0]))
    scale = F.when(F.abs(h[8]) >= 1e-12, h[8]).when(norm > 0, norm).otherwise(1.0)
    return [x / scale for x in h]


def _similarity(points: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Transforms (n, 3, 3) that bring each row's used points to mean 0 and mean distance sqrt 2."""
    n = used.sum(1, keepdims=True)
    centre = (points * used[:, :, None]).sum(1) / n
    away = np.linalg.norm(points - centre[:, None], axis=2)
    scale = np.sqrt(2) / np.maximum((away * used).sum(1) / n[:, 0], 1e-12)
    out = np.zeros((len(points), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = scale
    out[:, :2, 2], out[:, 2, 2] = -centre * scale[:, None], 1
    return out


def _mapped(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.einsum("nij,nkj->nki", h[:, :, :2], points) + h[:, None, :, 2]
    return q[:, :, :2] / np.where(np.abs(q[:, :, 2:]) > 1e-12, q[:, :, 2:], 1e-12)


def fit_homographies(source: np.ndarray, target: np.ndarray, used: np.ndarray, rounds: int = 10) -> np.ndarray:
    """(n, 3, 3): least squares of the distances of mapped source from target points (n, k, 2), over the used ones, four or more.

    A linear solution on normalised points starts Gauss-Newton steps of all rows at once; a step is kept where it helps.
    """
    a, b = _similarity(source, used), _similarity(target, used)
    x, y = _mapped(a, source), _mapped(b, target)
    w = used.astype(float)
    one, nil = np.ones_like(x[:, :, 0]), np.zeros_like(x[:, :, 0])
    u, v, s, t = x[:, :, 0], x[:, :, 1], y[:, :, 0], y[:, :, 1]
    rows = np.concatenate(
        [np.stack([u, v, one, nil, nil, nil, -s * u, -s * v, -s], 2) * w[:, :, None], np.stack([nil, nil, nil, u, v, one, -t * u, -t * v, -t], 2) * w[:, :, None]], axis=1
    )
    h = np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3)
    h = h / np.where(np.abs(h[:, 2:, 2:]) > 1e-12, h[:, 2:, 2:], 1.0)
    loss = lambda m: (((_mapped(m, x) - y) ** 2).sum(2) * w).sum(1)
    best = loss(h)
    for _ in range(rounds):
        d = h[:, 2, 0, None] * u + h[:, 2, 1, None] * v + h[:, 2, 2, None]
        d = np.where(np.abs(d) > 1e-12, d, 1e-12)
        p = _mapped(h, x)
        jx = np.stack([u / d, v / d, one / d, nil, nil, nil, -p[:, :, 0] * u / d, -p[:, :, 0] * v / d], 2)
        jy = np.stack([nil, nil, nil, u / d, v / d, one / d, -p[:, :, 1] * u / d, -p[:, :, 1] * v / d], 2)
        j, r = np.concatenate([jx, jy], 1) * np.concatenate([w, w], 1)[:, :, None], np.concatenate([s - p[:, :, 0], t - p[:, :, 1]], 1)
        left = np.einsum("nki,nkj->nij", j, j) + 1e-12 * np.eye(8)
        step = np.linalg.solve(left, np.einsum("nki,nk->ni", j, r)[:, :, None])[:, :, 0]
        tried = (h.reshape(-1, 9) + np.pad(step, ((0, 0), (0, 1)))).reshape(-1, 3, 3)
        now = loss(tried)
        better = now < best
        if not better.any():
            break
        h[better], best[better] = tried[better], now[better]
    h = np.linalg.inv(b) @ h @ a
    return h / np.where(np.abs(h[:, 2:, 2:]) > 1e-12, h[:, 2:, 2:], 1.0)


def _weighted_median(pairs: Column) -> Column:
    """Of an array of (v, w): the first v, in order, at which the running weight reaches half of the whole."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0.0), lambda s, p: s + p["w"]) * 0.5
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(ordered, start, lambda a, p: F.struct((a["s"] + p["w"]).alias("s"), F.when(a["v"].isNull() & (a["s"] + p["w"] >= half), p["v"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])


def smooth(solves: DataFrame, by: list[str], window: int, width: float, height: float) -> DataFrame:
    """(by, frame, valid, confidence, homography, smoothed): each valid solve averaged with its valid neighbours in the window.

    solves: by + frame, valid, confidence, homography (9, row-major), cut (a shot starts). The window counts rows on either side,
    `window` // 2 of them, of the same shot. Homographies are combined by where they map nine probe points of the image: the
    weighted median of each, by confidence, and a new fit to these. A solve without a valid neighbour, or whose probes
    mostly go to infinity, stays as it is. Invalid rows are never repaired.
    """
    half = window // 2
    rows = running_sums(solves, by, [F.col("frame")], {"__pos": F.lit(1).cast("long"), "__shot": F.coalesce("cut", F.lit(False)).cast("long")})
    if half == 0:
        return solves.select(*by, "frame", "valid", "confidence", "homography", F.lit(False).alias("smoothed"))
    here = [F.struct(*(c.alias(n) for n, c in zip("xy", expr.project([F.col("homography")[i] for i in range(9)], F.lit(px * width), F.lit(py * height)), strict=True))) for px, py in PROBES]
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.col("confidence"))
    near = around(rows, by, "__pos", F.when(F.col("valid"), F.struct("__shot", weight.alias("w"), F.array(*here).alias("at"))), half, half)
    mine = F.filter("near", lambda n: n["item"]["__shot"] == F.col("__shot"))
    many = F.col("valid") & (F.size(mine) > 1)

    def probe(i: int, axis: str) -> Column:
        known = F.filter(mine, lambda n: n["item"]["at"][i]["x"].isNotNull() & n["item"]["at"][i]["y"].isNotNull())
        return _weighted_median(F.transform(known, lambda n: F.struct(n["item"]["at"][i][axis].alias("v"), n["item"]["w"].alias("w"))))

    points = F.when(many, F.array(*(probe(i, axis) for i in range(len(PROBES)) for axis in "xy")))
    wide = near.select(*by, "frame", "valid", "confidence", "homography", points.alias("points"))
    source = np.array([(px * width, py * height) for px, py in PROBES])

    def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points_, old = batch.column("points"), batch.column("homography").to_pylist()
            at = np.flatnonzero(points_.is_valid().to_numpy(zero_copy_only=False))
            new = list(old)
            done = np.zeros(batch.num_rows, bool)
            if len(at):
                target = np.array([[np.nan if v is None else v for v in p] for p in points_.take(pa.array(at)).to_pylist()], float).reshape(len(at), -1, 2)
                used = np.isfinite(target).all(2)
                enough = used.sum(1) >= 4
                if enough.any():
                    fitted = fit_homographies(np.repeat(source[None], enough.sum(), 0), np.where(used[enough][:, :, None], target[enough], 0.0), used[enough])
                    for i, h in zip(at[enough], fitted, strict=True):
                        new[i], done[i] = h.reshape(-1).tolist(), True
            arrays = [batch.column(c) for c in (*by, "frame", "valid", "confidence")] + [pa.array(new, pa.list_(pa.float64())), pa.array(done)]
            yield pa.RecordBatch.from_arrays(arrays, [*by, "frame", "valid", "confidence", "homography", "smoothed"])

    types = dict(wide.dtypes)
    return wide.mapInArrow(refit, ", ".join([*(f"{c} {types[c]}" for c in (*by, "frame", "valid", "confidence")), "homography array<double>", "smoothed boolean"]))


def drift(solves: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """(by, frame, delta): how far the solve of each valid frame moves from that of the frame just before, where that is valid too."""
    rows = positions(solves, by, [F.col("frame")], "__pos")
    near = around(rows, by, "__pos", F.when(F.col("valid"), F.col("homography")), 1, 0)
    before = F.try_element_at(F.filter("near", lambda n: n["d"] == -1), F.lit(1))["item"]
    both = near.where("valid").select(*by, "frame", "homography", before.alias("before")).where("before is not null")
    delta = expr.homography_distance([F.col("before")[i] for i in range(9)], [F.col("homography")[i] for i in range(9)], width, height)
    return both.select(*by, "frame", delta.alias("delta")).where(F.col("delta") < float("inf"))


def stability(solves: DataFrame, by: list[str], width: float, height: float, far: float = 5.0) -> DataFrame:
    """(by, n_pairs, mean, median, p90, p95, largest, over): the drift of each video; zeros for one without two valid frames in a row."""
    steps = materialise(drift(solves, by, width, height), "drift")
    marks = quantiles(steps, by, "delta", [0.5, 0.9, 0.95]).groupBy(*by).agg(*(F.max(F.when(F.abs(F.col("share") - s) < 1e-9, F.col("quantile"))).alias(n) for n, s in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))))
    sums = steps.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean"), F.max("delta").alias("largest"), F.count_if(F.col("delta") > far).alias("over"))
    whole = solves.select(*by).distinct().join(sums.join(marks, by), by, "left")
    return whole.select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "mean", "median", "p90", "p95", "largest", "over")))
