"""One small fast object from many candidates: fusion of duplicates, checks against neighbouring frames, paths, states of every frame.

Per-frame folds are higher-order functions over a frame's few candidates; neighbouring frames meet by their place on the
lattice of frames, so no video is sorted in one task but for the search of paths, which runs island by island.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordered import around, positions, running_sums
from touchline.operators.staging import materialise
from touchline.operators.tracklets import islands, search


@dataclass(frozen=True)
class FusionRules:
    """Radii, shares and counts; the defaults are fixed values."""

    #: none, iou, centre_distance or weighted_centre.
    method: str = "weighted_centre"
    radius: float = 22.0
    iou: float = 0.5
    keep: int = 3
    min_camera: float = 0.35
    max_step: float = 90.0
    min_support: int = 2
    support_radius: float = 55.0
    camera_motion: float = 6.0
    static: float = 2.0
    background: float = 3.0
    max_size_ratio: float = 2.2
    trust: float = 0.75


#: Reasons for rejecting a candidate, in the order in which they are listed. Fixed values.
REASONS = ("outside_plausible_region", "implausible_jump", "size_inconsistent", "static_in_image_while_camera_moves", "moves_with_background", "single_frame_only", "no_neighbour_support")


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, m: s + of(m))


def fuse(candidates: DataFrame, by: list[str], rules: FusionRules = FusionRules()) -> DataFrame:
    """(by, rank, x, y, radius, confidence, source_ids, n_merged, uncertainty, method): a frame's candidates without duplicates.

    candidates: by (a frame's key) + id, x, y, radius, confidence. By falling confidence (ties: smaller id) each joins the first
    cluster whose leader is near, or leads a new one. A cluster has the confidence of its strongest member, not a sum; with
    weighted_centre its place and radius are means weighted by confidence. The best `keep` of a frame come out. Rows with a
    null place or confidence take no part.
    """
    known = candidates.where("x is not null and y is not null and confidence is not null")
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    member = F.struct((-d("confidence")).alias("less"), F.col("id").cast("long").alias("id"), d("x").alias("x"), d("y").alias("y"), d("radius").alias("r"))
    frames = known.groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("items"))
    shape = "struct<less:double,id:bigint,x:double,y:double,r:double>"

    def near(a: Column, b: Column) -> Column:
        if rules.method == "iou":
            side = lambda c: F.greatest(F.lit(0.0), F.least(a[c] + a["r"], b[c] + b["r"]) - F.greatest(a[c] - a["r"], b[c] - b["r"]))
            inter = side("x") * side("y")
            union = 4 * a["r"] * a["r"] + 4 * b["r"] * b["r"] - inter
            return F.coalesce((union > 0) & (inter / union > rules.iou), F.lit(False))
        return F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= rules.radius

    def join(clusters: Column, m: Column) -> Column:
        hits = F.transform(clusters, lambda c: near(m, c[0]))
        first = F.array_position(hits, F.lit(True)).cast("int")
        return F.when(first > 0, F.transform(clusters, lambda c, i: F.when(i == first - 1, F.concat(c, F.array(m))).otherwise(c))).otherwise(F.concat(clusters, F.array(F.array(m))))

    if rules.method == "none":
        clusters = F.transform("items", lambda m: F.array(m))
    else:
        clusters = F.aggregate("items", F.array().cast(f"array<array<{shape}>>"), join)

    def merged(c: Column) -> Column:
        weight = _sum(c, lambda m: -m["less"])
        mean = lambda f: _sum(c, lambda m: -m["less"] * m[f]) / weight
        pick = (lambda f: F.when(weight > 0, mean(f)).otherwise(c[0][f])) if rules.method == "weighted_centre" else (lambda f: c[0][f])
        return F.struct(pick("x").alias("x"), pick("y").alias("y"), pick("r").alias("radius"), (-c[0]["less"]).alias("confidence"), F.array_sort(F.transform(c, lambda m: m["id"])).alias("source_ids"), c.alias("c"))

    best = frames.select(*by, F.posexplode(F.slice(F.transform(clusters, merged), 1, rules.keep)).alias("at", "m")).select(*by, (F.col("at") + 1).alias("rank"), "m.*")
    spread = F.aggregate("c", F.lit(0.0), lambda s, m: F.greatest(s, F.hypot(m["x"] - F.col("x"), m["y"] - F.col("y"))))
    uncertainty = F.when(F.lit(rules.method == "none"), 0.0).otherwise(F.greatest(spread, F.col("radius") / 2))
    return best.select(*by, "rank", "x", "y", "radius", "confidence", "source_ids", F.size("c").alias("n_merged"), uncertainty.alias("uncertainty"), F.lit(rules.method).alias("method"))


def verify(lattice: DataFrame, best: DataFrame, by: list[str], rules: FusionRules = FusionRules(), region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(by, frame, state, support, reasons) of every frame: its one candidate judged by the frames around it.

    lattice: by + frame, shift_x, shift_y, camera (confidence of the shift; null counts as sure) - the camera's move since the
    frame before, nulls if unknown; best: by + frame, x, y, radius, confidence, one row a frame. Neighbours are the two frames on
    either side on the lattice; jumps and sizes are compared with the preceding frame only, and camera tests need its
    candidate and a trusted shift. State: unknown without a candidate, rejected with reasons, else temporally_verified with
    min_support near neighbours, or direct.
    """
    whole = lattice.join(best.select(*by, "frame", F.struct(F.col("frame").alias("f"), "x", "y", "radius", "confidence").alias("c")), [*by, "frame"], "left")
    placed = positions(whole, by, [F.col("frame")])
    rows = around(placed, by, "pos", F.col("c"), 2, 2).withColumn("before", F.try_element_at(F.filter("near", lambda n: n["d"] == -1), F.lit(1))["item"])
    c, p = F.col("c"), F.col("before")
    support = F.size(F.filter(F.coalesce("near", F.array().cast(dict(rows.dtypes)["near"])), lambda n: (n["d"] != 0) & (F.hypot(n["item"]["x"] - c["x"], n["item"]["y"] - c["y"]) <= rules.support_radius)))
    gap = F.greatest(F.lit(1), c["f"] - p["f"])
    ratio = c["radius"] / F.greatest(F.lit(1e-6), p["radius"])
    shift = F.hypot("shift_x", "shift_y")
    trusted = F.col("shift_x").isNotNull() & F.col("shift_y").isNotNull() & (F.coalesce("camera", F.lit(1.0)) >= rules.min_camera)
    moving = p.isNotNull() & trusted & (shift >= rules.camera_motion)
    dx, dy = c["x"] - p["x"], c["y"] - p["y"]
    lonely = (F.col("support") < rules.min_support) & (c["confidence"] < rules.trust)
    outside = F.lit(False) if region is None else ~(c["x"].between(region[0], region[2]) & c["y"].between(region[1], region[3]))
    tests = [
        outside, p.isNotNull() & (F.hypot(dx, dy) / gap > rules.max_step), p.isNotNull() & ((ratio > rules.max_size_ratio) | (ratio < 1 / rules.max_size_ratio)), moving & (F.hypot(dx, dy) <= rules.static),
        moving & (F.hypot(dx + F.col("shift_x"), dy + F.col("shift_y")) <= rules.background), lonely & (F.col("support") == 0), lonely & (F.col("support") > 0),
    ]
    reasons = F.array_compact(F.array(*(F.when(t, r) for t, r in zip(tests, REASONS, strict=True))))
    judged = rows.withColumn("support", F.when(c.isNotNull(), support).otherwise(0)).withColumn("reasons", F.when(c.isNotNull(), reasons).otherwise(F.array().cast("array<string>")))
    state = F.when(c.isNull(), "unknown").when(F.size("reasons") > 0, "rejected").when(F.col("support") >= rules.min_support, "temporally_verified").otherwise("direct")
    return judged.select(*by, "frame", state.alias("state"), "support", "reasons")


#: What a frame without a candidate is, by what is known of its visibility. Fixed values.
HIDDEN = {"likely_outside_frame": "outside_frame", "likely_occluded": "occluded", "likely_hidden_by_players": "occluded"}


def fused_states(candidates: DataFrame, lattice: DataFrame, by: list[str], rules: FusionRules = FusionRules(), region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row a frame of the lattice: kind, place, confidences, sources and rejection reasons of its best candidate.

    lattice: as in verify(), and perhaps `visibility`. A rejected candidate keeps its confidence but no place; the fused
    confidence is the detector's times 0.6 to 1.0 by how far the neighbourhood agrees, never more than the detector's.
    """
    best = materialise(fuse(candidates, [*by, "frame"], rules).where("rank = 1"), "fused")
    seen = verify(lattice, best, by, rules, region)
    rows = lattice.join(seen, [*by, "frame"]).join(best.drop("rank"), [*by, "frame"], "left")
    held = F.col("state").isin("temporally_verified", "direct")
    hidden = F.lit("unknown")
    if "visibility" in lattice.columns:
        for name, kind in HIDDEN.items():
            hidden = F.when(F.col("visibility") == name, kind).otherwise(hidden)
    kind = F.when(F.col("state") == "temporally_verified", "observed_temporally_verified").when(F.col("state") == "direct", "observed_direct").when(F.col("state") == "rejected", "unknown").otherwise(hidden)
    temporal = F.when(F.col("confidence").isNotNull(), F.least(F.lit(1.0), F.col("support") / float(max(1, rules.min_support)))).otherwise(0.0)
    return rows.select(
        *by, "frame", kind.alias("kind"), *(F.when(held, F.col(n)).alias(n) for n in ("x", "y", "radius")), F.coalesce("confidence", F.lit(0.0)).alias("detector_confidence"),
        temporal.alias("temporal_confidence"), F.when(held, F.col("confidence") * (0.6 + 0.4 * temporal)).otherwise(0.0).alias("fusion_confidence"), "source_ids", "n_merged",
        F.when(held, F.col("uncertainty")).otherwise(0.0).alias("uncertainty"), "reasons",
    )


def fusion_summary(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_frames, observed, direct, duplicate_rate, mean_merged, reasons): shares of frames, and how often each reason was given."""
    counts = states.select(*by, F.explode("reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    share = lambda c: F.count_if(c) / F.count("*")
    whole = states.groupBy(*by).agg(
        F.count("*").alias("n_frames"), share(F.col("kind").startswith("observed")).alias("observed"), share(F.col("kind") == "observed_direct").alias("direct"),
        F.coalesce(F.avg((F.col("n_merged") > 1).cast("double")), F.lit(0.0)).alias("duplicate_rate"), F.coalesce(F.avg("n_merged"), F.lit(0.0)).alias("mean_merged"),
    )
    return whole.join(maps, by, "left").withColumn("reasons", F.coalesce("reasons", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))


# -- paths and states ---------------------------------------------------------------------------------------------------------


def peel(nodes: np.ndarray, reach: int, speed: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, short, copies) of candidates (frame, x, y, confidence), sorted by frame and falling confidence; path is -1 off all paths.

    By falling score, each unclaimed end is walked back until a claimed node or frame; walks of `least` nodes are paths and
    claim their nodes and frames, shorter ones claim their end only, so that a longer path may still use the rest.
    short is where a node was on a walk that was too short. copies says the same of later candidates equal to a node: -2 for none,
    else for those before the node with that number, -1 for all.
    """
    score, parent = search(nodes, reach, speed)
    order = np.argsort(-score, kind="stable")
    path, short, alone = np.full(len(nodes), -1), np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    at_frame = np.unique(nodes[:, 0], return_inverse=True)[1].reshape(-1)
    # Arrays of plain numbers: a quarter of what lists of them take.
    frame, back = array("q", at_frame.astype(np.int64).tobytes()), array("q", parent.tobytes())
    taken, claimed = [-1] * (int(at_frame.max(initial=-1)) + 1), bytearray(len(nodes))
    number = 0
    for end in array("q", order.tobytes()):
        if taken[frame[end]] >= 0 or claimed[end]:
            continue
        walk, at = [], end
        while at >= 0 and not claimed[at] and taken[frame[at]] < 0:
            walk.append(at)
            at = back[at]
        if len(walk) < least:
            claimed[end] = 1
            short[walk] = alone[end] = True
            continue
        path[walk] = number
        for at in walk:
            claimed[at], taken[frame[at]] = 1, end
        number += 1
    taker = np.array(taken, np.int64)[at_frame]
    # A copy's turn comes after the node's own and before that of any later node with the same score.
    tie = (taker >= 0) & (nodes[taker, 0] == nodes[:, 0]) & (nodes[taker, 3] == nodes[:, 3]) & (score[taker] == score)
    return path, short, np.where(alone, np.where(tie, taker, -1), -2)


#: Why a candidate is on no path, or is dropped from one; the first is for those that are kept.
LOSSES = (None, "segment_too_short", "not_on_any_accepted_path", "implausible_acceleration")
TAKEN, SHORT, NOWHERE, JERKY = range(1, 5)


@dataclass(frozen=True)
class PathRules:
    """Limits in pixels of a frame `width` wide; the defaults are fixed values."""

    width: float = 1920.0
    reference_width: float = 1920.0
    speed: float = 140.0
    max_gap: int = 12
    min_path: int = 3
    max_accel: float = 60.0
    smoothing: int = 5

    @property
    def scale(self) -> float:
        return self.width / self.reference_width


def paths(candidates: DataFrame, by: list[str], rules: PathRules = PathRules()) -> DataFrame:
    """(by, island, path, frame, id, x, y, confidence, reason): every candidate, with the path that took it or the reason why none did.

    candidates: by + frame, id, x, y, confidence. A frame has one accepted candidate at most; all paths of a stretch of frames that
    no step leaves are peeled off one search. Then points whose turn within a path's reach needs too much acceleration are
    dropped. Rows with a null place or confidence take no part.

    Of candidates of a frame with the same place and confidence only the one with the smallest id can be on a path, so the search sees
    that one alone; the others learn from it why they are on none.
    """
    known = candidates.where("x is not null and y is not null and confidence is not null").select(*by, F.col("frame").cast("long").alias("frame"), "id", "x", "y", "confidence")
    reach = rules.max_gap + 1
    spot = [*by, "frame", "x", "y", "confidence"]
    rows = known.groupBy(*spot, "id").agg(F.count("*").alias("__n"))
    stretches = islands(rows.groupBy(*spot).agg(F.min("id").alias("id")), by, reach)
    types = dict(stretches.dtypes)

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("frame", "ascending"), ("confidence", "descending"), ("id", "ascending")]))
        column = lambda n: group.column(n).cast(pa.float64()).to_numpy()
        nodes, island = np.column_stack([column(n) for n in ("frame", "x", "y", "confidence")]), group.column("island").to_numpy()
        path, reason, copies = np.full(len(nodes), -1), np.empty(len(nodes), np.int8), np.full(len(nodes), -1)
        cuts = [0, *(np.flatnonzero(np.diff(island)) + 1), len(nodes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            path[a:b], short, later = peel(nodes[a:b], reach, rules.speed * rules.scale, rules.min_path)
            reason[a:b] = np.where(path[a:b] >= 0, TAKEN, np.where(short, SHORT, NOWHERE))
            copies[a:b] = np.where(later >= 0, later + a, later)
            # The points of an island that were taken, in order of frames, are what an acceleration is measured on.
            taken = a + np.flatnonzero(path[a:b] >= 0)
            if len(taken) > 2:
                reason[taken[1:-1][_jerks(nodes[taken], reach, rules.max_accel * rules.scale)]] = JERKY
        until = group.column("id").take(pa.array(copies, mask=copies < 0))
        out = [*(group.column(c) for c in (*spot, "island", "id")), pa.array(path), pa.array(reason), pa.array(copies > -2), until]
        return pa.table(out, names=[*spot, "island", "id", "path", "reason", "alone", "until"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in (*spot, "island", "id")), f"path long, reason tinyint, alone boolean, until {types['id']}"])
    # A number keeps the planner from putting all groups, which are few and of few bytes, into one task.
    dealt = stretches.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "__batch")
    leaders = dealt.groupBy(*by, "__batch").applyInArrow(run, schema)
    c = F.col
    leaders = leaders.select(*(c(n).alias(f"__{n}") for n in (*spot, "id")), *("island", "path", "reason", "alone", "until"))
    each = rows.join(leaders, [c(n).eqNullSafe(c(f"__{n}")) for n in spot]).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    leads = c("id").eqNullSafe(c("__id")) & (c("__i") == 1)
    copy = F.when(c("alone") & (c("until").isNull() | F.coalesce(c("id") < c("until"), F.lit(False))), SHORT).otherwise(NOWHERE)
    why = F.element_at(F.array(*(F.lit(r) for r in LOSSES)), F.when(leads, c("reason")).otherwise(copy).cast("int"))
    return each.select(*by, "island", F.when(leads, c("path")).otherwise(-1).alias("path"), "frame", "id", "x", "y", "confidence", why.alias("reason"))


def _jerks(points: np.ndarray, reach: int, limit: float) -> np.ndarray:
    """Which inner points turn harder than the limit, both steps being within reach."""
    dt = np.maximum(1.0, np.diff(points[:, 0]))
    v = np.diff(points[:, 1:3], axis=0) / dt[:, None]
    accel = np.linalg.norm(np.diff(v, axis=0), axis=1) / ((dt[:-1] + dt[1:]) / 2)
    return (accel > limit) & (dt[:-1] <= reach) & (dt[1:] <= reach)


def path_losses(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, with_candidates, accepted, lost, causes): frames with candidates, those with an accepted one, and why the others have none."""
    order = F.when(F.col("reason").isNull(), 0).when(F.col("reason") == "implausible_acceleration", 2).when(F.col("reason") == "segment_too_short", 1).otherwise(3)
    frames = found.groupBy(*by, "frame").agg(F.min_by(F.coalesce("reason", F.lit("")), order).alias("reason"))
    causes = frames.where("reason <> ''").groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("causes"))
    sizes = frames.groupBy(*by).agg(F.count("*").alias("with_candidates"), F.count_if(F.col("reason") == "").alias("accepted"))
    return sizes.join(causes, by, "left").select(*by, "with_candidates", "accepted", (F.col("with_candidates") - F.col("accepted")).alias("lost"), "causes")


def ball_states(found: DataFrame, lattice: DataFrame, by: list[str], rules: PathRules = PathRules()) -> DataFrame:
    """(by, frame, x, y, vx, vy, confidence, method, uncertainty) of every frame of the lattice (by + frame).

    found: paths(). Between two accepted points at most max_gap frames apart places are interpolated, with less confidence and
    more uncertainty towards the middle; other frames stay unknown, with null places. Runs of three known frames or more are
    smoothed by a centred mean: observed points move 0.3 of the way, interpolated ones all of it. Speeds are backward differences in
    the run, the first frame's forward.
    """
    hits = found.where("reason is null").select(*by, "frame", F.struct(F.col("frame").alias("f"), "x", "y", "confidence").alias("o"))
    rows = positions(lattice.select(*by, F.col("frame").cast("long").alias("frame")).join(hits, [*by, "frame"], "left"), by, [F.col("frame")])
    # A frame can lie between points max_gap frames apart at most, which are no further away on the lattice.
    rows = around(rows, by, "pos", F.col("o"), rules.max_gap, rules.max_gap)
    side = lambda ahead: F.filter("near", lambda n: (n["d"] > 0) if ahead else (n["d"] < 0))
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("a", F.try_element_at(side(False), F.lit(-1))["item"]).withColumn("b", F.try_element_at(side(True), F.lit(1))["item"])
    gap, t = b["f"] - a["f"], (F.col("frame") - a["f"]) / (b["f"] - a["f"])
    inside = F.col("o").isNull() & a.isNotNull() & b.isNotNull() & (gap <= rules.max_gap)
    away = F.least(F.col("frame") - a["f"], b["f"] - F.col("frame"))
    seen = F.col("o").isNotNull()
    mid = lambda c: F.when(seen, F.col("o")[c]).when(inside, a[c] + t * (b[c] - a[c]))
    sure = F.when(seen, F.col("o.confidence")).when(inside, F.least(a["confidence"], b["confidence"]) * F.greatest(F.lit(0.1), 1 - gap / (2.0 * (rules.max_gap + 1)))).otherwise(0.0)
    filled = rows.select(
        *by, "pos", "frame", mid("x").alias("x"), mid("y").alias("y"), sure.alias("confidence"), F.when(seen, "observed").when(inside, "interpolated").otherwise("unknown").alias("method"),
        F.when(seen, 2.0).when(inside, 2.0 + 4.0 * away).otherwise(float("inf")).alias("uncertainty"),
    )
    known = F.when(F.col("x").isNotNull(), F.struct("pos", "frame", "x", "y"))
    runs = _runs(materialise(filled, "filled"), by)
    half = F.least(F.lit((rules.smoothing - 1) // 2), F.floor((F.col("length") - F.when(F.col("length") % 2 == 0, 2).otherwise(1)) / 2)).cast("int")
    wide = around(runs, by, "pos", known, rules.smoothing // 2, rules.smoothing // 2)
    mine = F.filter("near", lambda n: (n["item"]["pos"] >= F.col("first")) & (n["item"]["pos"] <= F.col("last")) & (F.abs(n["d"]) <= half))
    mean = lambda c: F.aggregate(mine, F.lit(0.0), lambda s, n: s + n["item"][c]) / F.size(mine)
    blend = lambda c: F.when(F.col("length") < 3, F.col(c)).when(F.col("method") == "observed", 0.7 * F.col(c) + 0.3 * mean(c)).otherwise(mean(c))
    smooth = wide.select(*by, "pos", "frame", "first", "last", "length", F.when(F.col("x").isNotNull(), blend("x")).alias("x"), F.when(F.col("y").isNotNull(), blend("y")).alias("y"), "confidence", "method", "uncertainty")
    smooth = materialise(smooth, "smooth")
    moved = around(smooth, by, "pos", F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y")), 1, 1)
    other = F.try_element_at(F.filter("near", lambda n: n["d"] == F.when(F.col("pos") == F.col("first"), 1).otherwise(-1)), F.lit(1))["item"]
    forward = F.when(F.col("pos") == F.col("first"), 1).otherwise(-1)
    step = F.greatest(F.lit(1), F.abs(other["frame"] - F.col("frame")))
    v = lambda c: F.when(F.col("length") >= 2, forward * (other[c] - F.col(c)) / step)
    return moved.select(*by, "frame", "x", "y", v("x").alias("vx"), v("y").alias("vy"), "confidence", "method", "uncertainty")


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with first, last and length of the run of neighbouring known places they are in; null for unknown ones."""
    marked = running_sums(rows, by, [F.col("pos")], {"__unknown": F.col("x").isNull().cast("long")})
    ends = marked.where("x is not null").groupBy(*by, "__unknown").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("length"))
    return marked.join(ends, [*by, "__unknown"], "left").select(*rows.columns, *(F.when(F.col("x").isNotNull(), F.col(c)).alias(c) for c in ("first", "last", "length")))
