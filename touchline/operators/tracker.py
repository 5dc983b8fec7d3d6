"""Online tracking of boxes, frame by frame: predicted boxes, two assignments a frame, births, coasting and expiry.

The state of a video is a few arrays over its live tracks and a step is the same for all of them, so a frame costs a handful of array
operations, and its assignments the pairs that overlap. A batch run folds a video's frames with it; the streaming form keeps it
between micro-batches. Either way only the state, some frames and a stretch of the result are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    """Thresholds; the defaults are fixed values."""

    high: float = 0.5
    low: float = 0.1
    birth: float = 0.6
    buffer: int = 60
    #: Dearest cost of the first and of the second assignment.
    match: float = 0.8
    rescue: float = 0.5
    #: Weight of appearance against overlap, for pairs whose overlap cost is no more than `gate`.
    look: float = 0.4
    gate: float = 0.9
    momentum: float = 0.9
    #: Frames whose numbers differ by more than this are not next to each other.
    stride: int = 1


#: Standard deviations relative to a box's height: of its place, and of its speed. Fixed values.
PLACE, SPEED = 1 / 20, 1 / 160
#: Fixed deviations of the aspect when a track opens or moves, when it is seen, and of its speed.
ASPECT, ASPECT_SEEN, ASPECT_SPEED = 1e-2, 1e-1, 1e-5
#: Pairs of boxes that are compared at once, and rows of a result that are handed on together.
CELLS, ROWS = 1 << 20, 20_000
OBSERVATION = ["track_id", "frame", "x1", "y1", "x2", "y2", "object_class", "det_confidence", "track_confidence", "interpolated"]
TYPES = "track_id long, frame long, x1 double, y1 double, x2 double, y2 double, object_class string, det_confidence double, track_confidence double, interpolated boolean"


def to_measure(boxes: np.ndarray) -> np.ndarray:
    """Corner boxes as centre, aspect and height."""
    w, h = np.maximum(1e-6, boxes[:, 2] - boxes[:, 0]), np.maximum(1e-6, boxes[:, 3] - boxes[:, 1])
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h], axis=1)


def to_boxes(mean: np.ndarray) -> np.ndarray:
    h = np.maximum(1e-6, mean[:, 3])
    w = np.maximum(1e-6, mean[:, 2] * h)
    return np.stack([mean[:, 0] - w / 2, mean[:, 1] - h / 2, mean[:, 0] + w / 2, mean[:, 1] + h / 2], axis=1)


def _noise(height: np.ndarray, place: float, aspect: float, speed: float | None, aspect_speed: float = ASPECT_SPEED) -> np.ndarray:
    """Diagonal variances, four of the place or, with a speed, eight."""
    one = np.ones_like(height)
    std = [place * height, place * height, aspect * one, place * height]
    if speed is not None:
        std += [speed * height, speed * height, aspect_speed * one, speed * height]
    return np.stack(std, axis=1) ** 2


def _diagonal(values: np.ndarray) -> np.ndarray:
    return values[:, :, None] * np.eye(values.shape[1])


def opened(measure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.concatenate([measure, np.zeros_like(measure)], axis=1)
    return mean, _diagonal(_noise(measure[:, 3], 2 * PLACE, ASPECT, 10 * SPEED))


def moved(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One frame on at constant speed: place and speed are the two halves, and a place gains its speed."""
    places = cov[:, :4] + cov[:, 4:]
    cov = cov.copy()
    cov[:, :4, :4], cov[:, :4, 4:] = places[:, :, :4] + places[:, :, 4:], places[:, :, 4:]
    cov[:, 4:, :4] += cov[:, 4:, 4:]
    at = np.arange(8)
    cov[:, at, at] += _noise(mean[:, 3], PLACE, ASPECT, SPEED)
    return np.concatenate([mean[:, :4] + mean[:, 4:], mean[:, 4:]], axis=1), cov


def seen(mean: np.ndarray, cov: np.ndarray, measure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected by a measurement each."""
    spread = cov[:, :4, :4] + _diagonal(_noise(mean[:, 3], PLACE, ASPECT_SEEN, None))
    gain = np.linalg.solve(spread.transpose(0, 2, 1), cov[:, :4, :]).transpose(0, 2, 1)
    return mean + np.einsum("nij,nj->ni", gain, measure - mean[:, :4]), cov - gain @ spread @ gain.transpose(0, 2, 1)


def warped(mean: np.ndarray, cov: np.ndarray, warp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carried by the camera's affine motion (2 x 3): centres turn and shift, speeds turn, heights scale."""
    turn = np.eye(8)
    turn[0:2, 0:2] = turn[4:6, 4:6] = warp[:, :2]
    turn[3, 3] = turn[7, 7] = np.sqrt(abs(np.linalg.det(warp[:, :2]))) or 1.0
    mean = mean @ turn.T
    mean[:, 0:2] += warp[:, 2]
    return mean, turn @ cov @ turn.T


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of the boxes of a and b that overlap, by i and j; only boxes whose widths meet are compared."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.argsort(b[:, 0], kind="stable")
    left, widest = b[order, 0], max(0.0, float((b[:, 2] - b[:, 0]).max()))
    low, high = np.searchsorted(left, a[:, 0] - widest * (1 + 1e-9) - 1e-9, "left"), np.searchsorted(left, a[:, 2], "left")
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    out, start = [], 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
        n = counts[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)]
        p, q = a[i], b[j]
        shared = np.clip(np.minimum(p[:, 2:], q[:, 2:]) - np.maximum(p[:, :2], q[:, :2]), 0, None).prod(1)
        some = np.flatnonzero(shared > 0)
        i, j, p, q, shared = i[some], j[some], p[some], q[some], shared[some]
        union = np.clip(p[:, 2:] - p[:, :2], 0, None).prod(1) + np.clip(q[:, 2:] - q[:, :2], 0, None).prod(1) - shared
        out.append((i, j, np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)))
        start = stop
    i, j, share = (np.concatenate(part) for part in zip(*out, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order], share[order]


def cheapest_pairs(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges of the cheapest choice of pairs, one an end, where all pairs that are not among the edges cost 1 and edges less.

    That is the cheapest assignment of the smaller side to the larger one without its pairs that cost 1. Shortest augmenting
    paths over the edges, an end's cheapest ones first: a search ends where the next price is above that of the nearest free end.
    """
    if not len(cost):
        return np.empty(0, np.int64)
    l, r = (np.unique(x, return_inverse=True)[1] for x in (left, right))
    if l.max() > r.max():
        l, r = r, l
    order = np.lexsort((r, cost, l))
    rows, columns = int(l.max()) + 1, int(r.max()) + 1
    cuts = np.searchsorted(l[order], np.arange(rows + 1)).tolist()
    to, price = r[order].tolist(), cost[order].tolist()
    u, v, owner, held = [0.0] * rows, [0.0] * columns, [-1] * columns, [-1] * rows
    for start in range(rows):
        least: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        done: list[tuple[float, int]] = []
        settled, heap, i, far, bound, goal = set(), [], start, 0.0, inf, (start, -1)
        while True:
            base = far - u[i]
            if base + 1.0 < bound:  # the row stays alone
                bound, goal = base + 1.0, (i, -1)
            for e in range(cuts[i], cuts[i + 1]):
                d = base + price[e]
                if d >= bound:  # a column's own price never lowers this
                    break
                j = to[e]
                d -= v[j]
                if d < bound and j not in settled and d < least.get(j, inf):
                    if owner[j] < 0:
                        bound, goal = d, (i, e)
                    else:
                        least[j], way[j] = d, (i, e)
                        heappush(heap, (d, j))
            while heap and heap[0][1] in settled:
                heappop(heap)
            if not heap or heap[0][0] >= bound:
                break
            far, j = heappop(heap)
            settled.add(j)
            done.append((far, j))
            i = owner[j]
        u[start] += bound
        for d, j in done:
            u[owner[j]] += bound - d
            v[j] -= bound - d
        i, e = goal
        while True:
            before, held[i] = held[i], e
            if e >= 0:
                owner[to[e]] = i
            if i == start:
                break
            i, e = way[to[before]]
    return order[[e for e in held if e >= 0]]


def pairing(i: np.ndarray, j: np.ndarray, cost: np.ndarray, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest assignment over edges, by i and without the pairs dearer than the ceiling."""
    near = np.flatnonzero(cost < 1)
    at = near[cheapest_pairs(i[near], j[near], cost[near])]
    at = np.sort(at[cost[at] <= ceiling])
    return i[at], j[at]


@dataclass
class Tracks:
    """Live tracks of a video: arrays in a common order, the observed ones first, and rows that wait for a sighting."""

    next_id: int = 1
    frame: int | None = None
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    mean: np.ndarray = field(default_factory=lambda: np.empty((0, 8)))
    cov: np.ndarray = field(default_factory=lambda: np.empty((0, 8, 8)))
    unseen: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hits: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: Whether a track was corrected in the frame before; a newborn one wasn't.
    tracked: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    classes: np.ndarray = field(default_factory=lambda: np.empty(0, object))
    looks: dict = field(default_factory=dict)
    #: Each track's place in the table of boxes predicted since it was seen, the free places, and the frames of the last steps.
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    trail: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 4)))
    free: list = field(default_factory=list)
    steps: list = field(default_factory=list)

    def _kept(self, order: np.ndarray) -> None:
        for name in ("ids", "mean", "cov", "unseen", "hits", "tracked", "classes", "slots"):
            setattr(self, name, getattr(self, name)[order])

    def _places(self, n: int, s: Settings) -> np.ndarray:
        """Free places of the table of predicted boxes, which doubles when it is full."""
        if len(self.free) < n:
            had, more = len(self.trail), max(n, len(self.trail), 16)
            wider = np.empty((had + more, s.buffer, 4))
            if had:
                wider[:had] = self.trail
            self.trail = wider
            self.free += range(had + more - 1, had - 1, -1)
        return np.array([self.free.pop() for _ in range(n)], np.int64)

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray, classes: list, looks: list | None, warp: np.ndarray | None, s: Settings) -> list[tuple]:
        """Advance by one frame; returns observations, those coasted before a sighting included. Trailing coasted ones never come out."""
        named = np.empty(len(classes), object)
        named[:] = classes
        return [r for part in self.advanced(frame, boxes, scores, named, looks, warp, s) for r in _tuples(part)]

    def advanced(self, frame: int, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, looks: list | None, warp: np.ndarray | None, s: Settings) -> list[tuple]:
        """step() with the observations as columns: ids, frames, boxes, classes and so on, of seen and of newborn tracks."""
        high, low = np.flatnonzero(scores >= s.high), np.flatnonzero((scores >= s.low) & (scores < s.high))
        if len(self.ids):
            self.mean[~self.tracked, 6:8] = 0.0
            self.mean, self.cov = moved(self.mean, self.cov)
            self.unseen = self.unseen + 1
            if warp is not None:
                self.mean, self.cov = warped(self.mean, self.cov, warp)
        mine, n = to_boxes(self.mean), len(self.ids)
        at, det = pairing(*self._costs(mine, boxes[high], [looks[i] for i in high] if looks else None, s), s.match)
        det = high[det]
        sure = len(det)
        met = np.zeros(len(scores), bool)
        met[det] = True
        hit = np.zeros(n, bool)
        hit[at] = True
        rest = np.flatnonzero(~hit & self.tracked)
        if len(rest) and len(low):
            i, j, share = overlaps(mine[rest], boxes[low])
            i, j = pairing(i, j, 1 - share, s.rescue)
            at, det = np.concatenate([at, rest[i]]), np.concatenate([det, low[j]])
            hit[rest[i]] = True
        out = []
        if len(at):
            coasted = self.unseen[at] - 1
            self.mean[at], self.cov[at] = seen(self.mean[at], self.cov[at], to_measure(boxes[det]))
            self.unseen[at], self.hits[at] = 0, self.hits[at] + 1
            out.append(self._sighted(frame, at, coasted, boxes[det], scores[det], classes[det]))
            if looks:
                for t, d in zip(at[:sure].tolist(), det[:sure].tolist(), strict=True):
                    self._remember(int(self.ids[t]), looks[d], scores[d], s)
        lost = np.flatnonzero(~hit & (self.unseen <= s.buffer))
        if len(lost):
            self.trail[self.slots[lost], self.unseen[lost] - 1] = to_boxes(self.mean[lost])
        born = high[~met[high] & (scores[high] >= s.birth)]
        self.tracked = hit
        if len(born):
            mean, cov = opened(to_measure(boxes[born]))
            ids = np.arange(self.next_id, self.next_id + len(born))
            self.next_id += len(born)
            nobody = np.zeros(len(born), bool)
            out.append((ids, np.full(len(born), frame), boxes[born], classes[born], scores[born], scores[born], nobody))
            if looks:
                for i, d in zip(ids.tolist(), born.tolist(), strict=True):
                    self._remember(i, looks[d], scores[d], s)
            self.ids, self.mean, self.cov = np.append(self.ids, ids), np.concatenate([self.mean, mean]), np.concatenate([self.cov, cov])
            self.unseen, self.hits, self.tracked = np.append(self.unseen, np.zeros(len(born), np.int64)), np.append(self.hits, np.ones(len(born), np.int64)), np.append(self.tracked, nobody)
            self.classes, self.slots = np.append(self.classes, classes[born]), np.append(self.slots, self._places(len(born), s))
        live = self.unseen <= s.buffer
        self.free += self.slots[~live].tolist()
        for i in self.ids[~live].tolist():
            self.looks.pop(i, None)
        # Observed tracks go first: by the pair they came from, then the newborn; then the lost ones as they were.
        rank = np.full(len(self.ids), 10**9)
        rank[at] = np.arange(len(at))
        rank[n:] = 10**6 + np.arange(len(self.ids) - n)
        order = np.argsort(rank, kind="stable")
        self._kept(order[live[order]])
        self.frame = frame
        self.steps = [*self.steps[-s.buffer :], frame]
        return out

    def _sighted(self, frame: int, at: np.ndarray, coasted: np.ndarray, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray) -> tuple:
        """Rows of seen tracks, each after those predicted since its sighting before."""
        which = np.repeat(np.arange(len(at)), coasted + 1)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(coasted + 1) - coasted - 1, coasted + 1)
        guess = turn < coasted[which]
        place, det = boxes[which], np.where(guess, 0.0, scores[which])
        place[guess] = self.trail[self.slots[at][which[guess]], turn[guess]]
        sure = np.where(guess, 0.4 * np.maximum(0.0, 1.0 - (turn + 1) / 30), 0.5 * scores[which] + 0.5 * np.minimum(1.0, self.hits[at][which] / 20))
        # A class is the one that a track was born with where it is predicted, and the seen box's where it is seen.
        kinds = np.where(guess, self.classes[at][which], classes[which])
        frames = np.array([*self.steps, frame], np.int64)[len(self.steps) - coasted[which] + turn]
        return self.ids[at][which], frames, place, kinds, det, sure, guess

    def _costs(self, mine: np.ndarray, boxes: np.ndarray, looks: list | None, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(track, box, cost) of the pairs that cost less than 1; appearance has a say where the overlap cost is inside the gate."""
        i, j, share = overlaps(mine, boxes)
        cost = 1 - share
        if not looks or not len(mine):
            return i, j, cost
        if s.gate >= 1:  # pairs without overlap may be alike
            whole = np.ones((len(mine), len(boxes)))
            whole[i, j] = cost
            i, j = (x.ravel() for x in np.indices(whole.shape))
            cost = whole.ravel()
        for e in np.flatnonzero(cost <= s.gate).tolist():
            held, look = self.looks.get(int(self.ids[i[e]])), looks[j[e]]
            if held is not None and look is not None and np.any(look) and np.any(held):
                cost[e] = (1 - s.look) * cost[e] + s.look * min(1.0, max(0.0, 1.0 - float(np.dot(held, look))))
        return i, j, cost

    def _remember(self, i: int, look, score: float, s: Settings) -> None:
        """A track's appearance moves slowly, and not on unsure sightings."""
        if look is None or not np.any(look) or (score < 0.5 and i in self.looks):
            return
        now = np.asarray(look, float)
        now = now if i not in self.looks else s.momentum * self.looks[i] + (1 - s.momentum) * now
        norm = np.linalg.norm(now)
        self.looks[i] = now / norm if norm > 0 else now


def _tuples(part: tuple) -> list[tuple]:
    ids, frames, boxes, *rest = part
    return list(zip(ids.tolist(), frames.tolist(), *boxes.T.tolist(), *(c.tolist() for c in rest), strict=True))


def _table(parts: list[tuple]) -> pd.DataFrame:
    ids, frames, boxes, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pd.DataFrame(dict(zip(OBSERVATION, (ids, frames, *boxes.T, *rest), strict=True)))


def stretches(tracks: Tracks, rows: pd.DataFrame, s: Settings) -> Iterator[pd.DataFrame]:
    """Fold detections into the tracks, frame by frame, and yield observations, some ROWS at once; frames between them are steps without detections.

    rows: frame, x1, y1, x2, y2, score, object_class, and perhaps look and warp (6, the same in all rows of a frame). A row
    with a null box is a frame without detections; rows of frames already passed and with a null score are left out.
    """
    out: list[tuple] = []
    rows = rows[rows["frame"].notna()]
    if tracks.frame is not None:
        rows = rows[rows["frame"] > tracks.frame]
    if not len(rows):
        return
    keys = [c for c in ("frame", "x1", "y1", "x2", "y2", "score", "object_class") if c in rows]
    rows = rows.sort_values(keys, kind="stable")
    frames = rows["frame"].to_numpy(np.int64)
    boxes, scores = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["score"].to_numpy(float)
    good = np.isfinite(boxes).all(1) & np.isfinite(scores)
    classes = rows["object_class"].to_numpy(object)
    looks = rows["look"].tolist() if "look" in rows else None
    warps = rows["warp"].tolist() if "warp" in rows else None
    cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1), len(frames)]
    nothing = (np.empty((0, 4)), np.empty(0), np.empty(0, object), None, None)
    held = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        frame = int(frames[a])
        if tracks.frame is not None:
            # After `buffer` frames without a detection no track is left, so a longer gap needs no more steps.
            last = min(frame - 1, tracks.frame + (s.buffer + 1) * s.stride)
            for between in range(tracks.frame + s.stride, last + 1, s.stride):
                tracks.advanced(between, *nothing, s)
        at = np.flatnonzero(good[a:b]) + a
        warp = None if warps is None or warps[a] is None else np.asarray(warps[a], float).reshape(2, 3)
        new = tracks.advanced(frame, boxes[at], scores[at], classes[at], [looks[i] for i in at] if looks else None, warp, s)
        out, held = out + new, held + sum(len(part[0]) for part in new)
        if held >= ROWS:
            yield _table(out)
            out, held = [], 0
    if out:
        yield _table(out)


def advance(tracks: Tracks, rows: pd.DataFrame, s: Settings) -> list[tuple]:
    """stretches() as rows."""
    return [r for part in stretches(tracks, rows, s) for r in part.itertuples(index=False, name=None)]


def track(detections: DataFrame, by: list[str], s: Settings = Settings()) -> DataFrame:
    """(by, observations): the tracks of each video. detections: by + frame, corners, score, object_class and perhaps look, warp.

    A video is a fold and hence one task, over rows that Spark has sorted by frame and hands on batch by batch; longer ones are
    cut into overlapping chunks, tracked apart and linked. Predicted rows between two sightings come out marked as interpolated,
    those after the last one don't. An empty table gives none.
    """
    types = dict(detections.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracks, key, waiting = Tracks(), None, []  # the rows of the last frame, which may go on in the next batch

        def taken(rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in stretches(tracks, pd.concat(rows), s) if rows else ():
                for at, c in enumerate(by):
                    part.insert(at, c, [key[at]] * len(part))
                yield part

        for batch in batches:
            for _, rows in batch.groupby(by, sort=False, dropna=False):
                mine = tuple(None if pd.isna(x) else x for x in rows[by].iloc[0])
                if mine != key:
                    yield from taken(waiting)
                    tracks, key, waiting = Tracks(), mine, []
                open_ = rows["frame"] == rows["frame"].iloc[-1]
                if not open_.all() or (waiting and waiting[0]["frame"].iloc[0] != rows["frame"].iloc[0]):
                    yield from taken([*waiting, rows[~open_]])
                    waiting = []
                waiting.append(rows[open_])
        yield from taken(waiting)

    # With a number of partitions, adaptive execution leaves few long videos apart, however small their rows are.
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = detections.where("frame is not null").repartition(parts, *by).sortWithinPartitions(*by, "frame")
    return rows.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), TYPES]))
