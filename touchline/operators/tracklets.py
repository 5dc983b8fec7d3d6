"""Tracklets, trajectories and calibrations along a video: joining pieces, chains of identities, best paths, spread of solves.

Pairs come from bucketed joins and windows; folds run over islands, stretches of a video that cannot influence each other.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.streaming.windows import shared_dir

#: Row-major identity as the first two rows of an affine warp.
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
#: Islands are handed to a task together until they hold this many rows.
BATCH_ROWS = 10_000
#: Pairs of places that a search compares at once.
CELLS = 1 << 20


def _islands(rows: DataFrame, by: list[str], order: list[str], new: Column) -> DataFrame:
    """rows with `island`, which rises where `new` holds, and `__batch`, whole islands in a row of about BATCH_ROWS rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("__new", F.coalesce(new, F.lit(True))).withColumn("__n", F.row_number().over(w))
    first = F.max(F.when(F.col("__new"), F.col("__n"))).over(w)
    return rows.withColumn("island", F.sum(F.col("__new").cast("long")).over(w)).withColumn("__batch", F.floor(first / BATCH_ROWS)).drop("__new", "__n")


def stitch_pairs(tracks: DataFrame, by: list[str], max_gap: int = 30, max_distance: float = 120.0, ratios: tuple[float, float] = (0.6, 1.67)) -> DataFrame:
    """(by, earlier, later, later_first, cost) of tracks of one class that one object may have made, one after the other.

    tracks: by + track_id, object_class, first_frame, last_frame, tail and head centres (tail_x, ...), tail speed in pixels
    a frame (speed_x, speed_y), tail_height and head_height. The later one starts 1 to max_gap frames after the earlier one's
    end, near where its speed leads, and is of like height. Ends are joined by buckets of max_gap frames.
    """
    cut = lambda c: F.floor(F.col(c) / max_gap)
    ends = tracks.select(*by, "object_class", F.col("track_id").alias("earlier"), "last_frame", "tail_x", "tail_y", "speed_x", "speed_y", "tail_height", F.explode(F.array(cut("last_frame"), cut("last_frame") + 1)).alias("__b"))
    starts = tracks.select(*by, "object_class", F.col("track_id").alias("later"), F.col("first_frame").alias("later_first"), "head_x", "head_y", "head_height", cut("first_frame").alias("__b"))
    gap = F.col("later_first") - F.col("last_frame")
    distance = F.hypot(F.col("tail_x") + F.col("speed_x") * gap - F.col("head_x"), F.col("tail_y") + F.col("speed_y") * gap - F.col("head_y"))
    ratio = F.col("tail_height") / F.greatest(F.lit(1e-6), F.col("head_height"))
    pairs = ends.join(starts, [*by, "object_class", "__b"]).where((F.col("earlier") != F.col("later")) & gap.between(1, max_gap) & (distance <= max_distance) & ratio.between(*ratios))
    return pairs.select(*by, "earlier", "later", "later_first", (distance + 2.0 * gap).alias("cost"))


def stitch(pairs: DataFrame, by: list[str], max_gap: int = 30) -> DataFrame:
    """(by, earlier, later): in order of their start, later tracks take the cheapest predecessor that nothing follows yet.

    Ties go to the smaller ids. Two later tracks want the same predecessor only if they start within max_gap frames of each
    other, so a video is cut where no start lies for that long, and a batch of such islands is a task's group.
    """
    order = ["later_first", "later", "earlier"]
    far = F.col("later_first") - F.lag("later_first").over(Window.partitionBy(*by).orderBy(*order)) >= max_gap
    types = dict(pairs.dtypes)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        followed: set = set()
        out, done = [], set()
        for row in group.sort_values(["later_first", "later", "cost", "earlier"]).itertuples():
            if row.later not in done and row.earlier not in followed:
                done.add(row.later)
                followed.add(row.earlier)
                out.append((*key[:-1], row.earlier, row.later))
        return pd.DataFrame(out, columns=[*by, "earlier", "later"])

    return _islands(pairs, by, order, far).groupBy(*by, "__batch").applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in (*by, "earlier", "later")))


def chain_heads(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, later, head): the first track of the chain that ends in each linked track.

    links: by + earlier + later, each later once and no circles. Pointers double each round, so rounds grow with the logarithm
    of the longest chain; every round ends in a table in the shared folder, which cuts the lineage.
    """
    spark = links.sparkSession
    base = f"{shared_dir(spark)}/chains-{uuid.uuid4().hex}"
    heads = links.select(*by, "later", F.col("earlier").alias("head"))
    for turn in itertools.count():
        ahead = heads.select(*by, F.col("later").alias("head"), F.col("head").alias("__next"))
        joined = heads.join(ahead, [*by, "head"], "left").select(*by, "later", F.coalesce("__next", "head").alias("head"), F.col("__next").isNotNull().alias("__open"))
        joined.write.parquet(f"{base}/{turn}")
        joined = spark.read.schema(joined.schema).parquet(f"{base}/{turn}")
        heads = joined.drop("__open")
        if joined.where("__open").isEmpty():
            return heads


def search(nodes: np.ndarray, reach: int, speed: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, parent) of the best chain that ends in each candidate (frame, x, y, confidence), sorted by frame and falling confidence.

    A step adds the next one's confidence less 0.6 of its share of speed * frames and 0.8 of the frames skipped / (reach - 1);
    steps of more than reach frames or beyond that speed are impossible. A predecessor counts only if it raises the score.

    Of candidates at one place of a frame only the surest can be a predecessor, and all have the same steps before them; so places are
    compared with places, once a frame, however many candidates they hold.
    """
    frame, place, sure = nodes[:, 0], nodes[:, 1:3], nodes[:, 3]
    score, parent = sure.copy(), np.full(len(nodes), -1)
    if not len(nodes):
        return score, parent
    order = np.lexsort((place[:, 1], place[:, 0], frame))
    opens = np.concatenate([[True], (np.diff(nodes[order, :3], axis=0) != 0).any(1)])
    spot = np.empty(len(nodes), np.int64)
    spot[order] = np.cumsum(opens) - 1
    tops = order[opens]  # the first node of each place, as the sort is stable
    leaders = np.sort(tops)
    cuts = [0, *(np.flatnonzero(np.diff(frame)) + 1), len(nodes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        before = leaders[np.searchsorted(frame[leaders], frame[a] - reach, "left") : np.searchsorted(frame[leaders], frame[a], "left")]
        if not len(before):
            continue
        gap = frame[a] - frame[before]
        limit, idle = speed * gap, 0.8 * (gap - 1) / max(1, reach - 1)
        mine = np.argsort(spot[a:b], kind="stable") + a
        here, whose = np.unique(spot[mine], return_inverse=True)
        size = max(1, CELLS // len(before))
        for lo in range(0, len(here), size):
            block = tops[here[lo : lo + size]]
            d = np.hypot(*(place[before][None] - place[block][:, None]).transpose(2, 0, 1))
            cost = 0.6 * d / np.maximum(1e-6, limit)
            value = np.where(d > limit, -np.inf, score[before] - cost - idle)
            best = value.max(1, keepdims=True)
            # Sums are rounded with a candidate's own confidence, so all that may be its best are added up for it.
            row, col = np.nonzero((value >= best - 1e-9 * np.maximum(1, np.abs(best))) & np.isfinite(value))
            if not len(row):
                continue
            n = np.bincount(row, minlength=len(block))
            close = np.full((len(block), n.max()), -1)
            close[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = col
            first, last = np.searchsorted(whose, [lo, lo + size])
            at, of = mine[first:last], whose[first:last] - lo
            there = close[of]
            total = np.where(there < 0, -np.inf, score[before][there] + sure[at, None] - cost[of[:, None], there] - idle[there])
            k = np.argmax(total, axis=1)
            total, found = total[np.arange(len(at)), k], there[np.arange(len(at)), k]
            better = total > sure[at]
            score[at[better]], parent[at[better]] = total[better], before[found[better]]
    return score, parent


def best_path(nodes: np.ndarray, reach: int, speed: float) -> list[int]:
    """Rows of the best chain through candidates, as search() scores them."""
    score, parent = search(nodes, reach, speed)
    at, out = int(np.argmax(score)), []
    while at >= 0:
        out.append(at)
        at = int(parent[at])
    return out[::-1]


def islands(rows: DataFrame, by: list[str], reach: int) -> DataFrame:
    """rows with `island`, a stretch of frames that no step of `reach` frames leaves, and `__batch`, whole islands for one task.

    Windows run over the frames that have rows, not over the rows.
    """
    w = Window.partitionBy(*by).orderBy("frame")
    frames = rows.groupBy(*by, "frame").agg(F.count("*").alias("__k"))
    far = F.coalesce(F.col("frame") - F.lag("frame").over(w) > reach, F.lit(True))
    frames = frames.withColumn("__new", far).withColumn("__n", F.sum("__k").over(w) - F.col("__k") + 1)
    first = F.max(F.when(F.col("__new"), F.col("__n"))).over(w)
    frames = frames.select(*(F.col(c).alias(f"__{c}") for c in (*by, "frame")), F.sum(F.col("__new").cast("long")).over(w).alias("island"), F.floor(first / BATCH_ROWS).alias("__batch"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "frame")]
    return rows.join(frames, same).select(*rows.columns, "island", "__batch")


def trajectories(candidates: DataFrame, by: list[str], reach: int = 13, speed: float = 90.0) -> DataFrame:
    """(by, island, frame, id): candidates on the best path of each island, frames that no step of `reach` frames leaves.

    candidates: by + frame, id, x, y, confidence. Rows with a null place or confidence take no part.
    """
    known = candidates.where("x is not null and y is not null and confidence is not null")
    stretches = islands(known, by, reach)
    types = dict(stretches.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["frame", "confidence", "id"], ascending=[True, False, True])
        nodes, island = group[["frame", "x", "y", "confidence"]].to_numpy(float), group["island"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(island)) + 1), len(group)]
        rows = [a + k for a, b in zip(cuts, cuts[1:], strict=False) for k in best_path(nodes[a:b], reach, speed)]
        return group.iloc[rows][[*by, "island", "frame", "id"]]

    return stretches.groupBy(*by, "__batch").applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in (*by, "island", "frame", "id")))


def _compose(later: Column, earlier: Column) -> Column:
    """Affine product later * earlier, both as their first two rows."""
    a, b = [later[i] for i in range(6)], [earlier[i] for i in range(6)]
    row = lambda p: [a[p] * b[0] + a[p + 1] * b[3], a[p] * b[1] + a[p + 1] * b[4], a[p] * b[2] + a[p + 1] * b[5] + a[p + 2]]
    return F.array(*row(0), *row(3))


def propagate_calibration(frames: DataFrame, by: list[str], reach: int = 45, decay: float = 0.02, anchor: float = 0.5, least: float = 0.1) -> DataFrame:
    """(by, frame, anchor_frame, step, confidence, homography) of frames without a solve that a nearby solve reaches.

    frames: by + frame, valid, confidence, homography (9, row-major; of valid frames), warp (6; from the frame before, null if
    unknown). The nearest solve on each side counts if it is as sure as `anchor`; a missing warp between ends its reach. The
    nearer side gives the homography, the side before on a tie, moved by the warps between, at most `reach` of them, and its
    confidence falls by `decay` a frame, down to `least`. Solved frames are never replaced and don't come out.
    """
    w = Window.partitionBy(*by).orderBy("frame")
    at = frames.withColumn("__p", F.row_number().over(w)).withColumn("__gone", F.sum(F.col("warp").isNull().cast("long")).over(w))
    solve = F.when(F.col("valid"), F.struct("frame", "__p", "__gone", "confidence", "homography"))
    warp = F.struct("__p", "warp")
    at = (
        at.withColumn("__a", F.last(solve, True).over(w.rowsBetween(-reach, -1)))
        .withColumn("__z", F.first(solve, True).over(w.rowsBetween(1, reach)))
        .withColumn("__past", F.collect_list(warp).over(w.rowsBetween(1 - reach, 0)))
        .withColumn("__next", F.collect_list(warp).over(w.rowsBetween(1, reach)))
        .where(~F.col("valid"))
    )
    chain = lambda items: F.aggregate(items, F.array(*map(F.lit, IDENTITY)), lambda done, i: _compose(i["warp"], done))

    def side(name: str, forward: bool) -> Column:
        s, here = F.col(name), F.col("__p")
        step = (here - s["__p"] if forward else s["__p"] - here).cast("int")
        sure = s["confidence"] * F.greatest(F.lit(0.0), 1 - decay * step)
        fine = (s["confidence"] >= anchor) & (s["__gone"] == F.col("__gone")) & (sure >= least)
        between = F.filter("__past", lambda i: i["__p"] > s["__p"]) if forward else F.filter("__next", lambda i: i["__p"] <= s["__p"])
        return F.when(fine, F.struct(step.alias("step"), F.lit(0 if forward else 1).alias("back"), s["frame"].alias("anchor_frame"), sure.alias("confidence"), s["homography"].alias("h"), chain(between).alias("move")))

    best = at.withColumn("__best", F.array_min(F.array_compact(F.array(side("__a", True), side("__z", False))))).where("__best is not null")
    best = best.select(*by, "frame", "__best.*")
    move = [F.col("move")[i] for i in range(6)] + [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    turned = [F.when(F.col("back") == 1, m).otherwise(i) for m, i in zip(move, expr.invert(move), strict=True)]
    h = [F.col("h")[i] for i in range(9)]
    product = [h[3 * i] * turned[j] + h[3 * i + 1] * turned[3 + j] + h[3 * i + 2] * turned[6 + j] for i in range(3) for j in range(3)]
    scale = F.when(F.abs(product[8]) > 1e-12, product[8])
    return best.select(*by, "frame", "anchor_frame", "step", "confidence", F.array(*(p / scale for p in product)).alias("homography")).where("homography[0] is not null")
