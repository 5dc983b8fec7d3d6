"""Motion of tracked entities: smoothing of positions, interval speeds, physical profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.staging import shuffled

#: Limits and zones of running speed in metres a second; fixed values.
MAX_SPEED, MAX_ACCELERATION, EFFORT = 12.0, 8.0, 2.0
SPRINT_SPEED, SPRINT_TIME = 7.0, 0.7
ZONES = (("walking", 0.0, 2.0), ("jogging", 2.0, 4.0), ("running", 4.0, 5.5), ("high_speed", 5.5, 7.0), ("sprinting", 7.0, float("inf")))


def smooth_segments(t: np.ndarray, z: np.ndarray, starts: np.ndarray, noise: float, acceleration: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, velocities) of segments that follow each other, sorted by time: forward Kalman filter and backward pass of a constant-velocity model.

    starts has the first row of each segment; z has a column for each axis; axes share the gains, which depend on times alone.
    Fewer than three samples come back as they are, at rest. The i-th samples of all segments are one step, so steps are as
    many as the longest segment has samples.
    """
    place, velocity = z.astype(float), np.zeros(z.shape)
    sizes = np.diff(np.append(starts, len(t)))
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes >= 3)]
    starts, sizes = starts[order], sizes[order]
    if not len(starts):
        return place, velocity
    longer = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "left")  # how many segments have more than i samples
    state, cov, moves = np.zeros((len(t), 2, z.shape[1])), np.zeros((len(t), 2, 2)), np.tile(np.eye(2), (len(t), 1, 1))
    ahead, ahead_cov = np.zeros_like(state), np.zeros_like(cov)
    dt = np.maximum(np.diff(t, prepend=t[:1]), 1e-3)
    moves[:, 0, 1] = dt
    g = np.stack([dt * dt / 2, dt], 1)
    state[starts, 0], cov[starts] = z[starts], np.diag([noise**2, 4.0])
    for i in range(1, sizes[0]):
        at = starts[: longer[i]] + i
        f, u = moves[at], g[at]
        x, p = f @ state[at - 1], f @ cov[at - 1] @ f.transpose(0, 2, 1) + acceleration**2 * u[:, :, None] * u[:, None]
        ahead[at], ahead_cov[at] = x, p
        gain = p[:, :, 0] / (p[:, 0, 0] + noise**2)[:, None]
        state[at], cov[at] = x + gain[:, :, None] * (z[at] - x[:, 0])[:, None], p - gain[:, :, None] * p[:, :1]
    for i in range(sizes[0] - 2, -1, -1):
        at = starts[: longer[i + 1]] + i
        back = cov[at] @ moves[at + 1].transpose(0, 2, 1) @ np.linalg.inv(ahead_cov[at + 1])
        state[at] += back @ (state[at + 1] - ahead[at + 1])
    done = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place[done], velocity[done] = state[done, 0], state[done, 1]
    return place, velocity


def constant_velocity_smoother(t: np.ndarray, z: np.ndarray, noise: float, acceleration: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, velocities) of one segment."""
    return smooth_segments(t, z, np.zeros(min(1, len(t)), int), noise, acceleration)


def smooth_tracks(df: DataFrame, by: list[str], time: str, x: str, y: str, noise: float = 0.5, acceleration: float = 3.0) -> DataFrame:
    """df with `smooth_x`, `smooth_y` and `speed` at each sample. `by` names a segment, which has to fit in a task.

    The first estimate is at rest at the first sample, with a variance of 4 for its velocity. The window leaves segments whole
    and in order in their partition, so a task smooths all those of a batch together; one that goes on in the next batch waits for it.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in df.columns), "smooth_x double, smooth_y double, speed double"])

    def smooth(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        place, velocity = smooth_segments(rows[time].to_numpy(float), rows[[x, y]].to_numpy(float), np.flatnonzero(rows.pop("__first")), noise, acceleration)
        return rows.assign(smooth_x=place[:, 0], smooth_y=place[:, 1], speed=np.hypot(velocity[:, 0], velocity[:, 1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch["__first"])
            if len(starts):
                held.append(batch.iloc[: starts[-1]])
                if sum(map(len, held)):
                    yield smooth(held)
                held, batch = [], batch.iloc[starts[-1] :]
            held.append(batch)
        if held:
            yield smooth(held)

    first = F.row_number().over(Window.partitionBy(*by).orderBy(time)) == 1
    return df.withColumn("__first", first).mapInPandas(run, schema)


def intervals(df: DataFrame, by: list[str], order: list[str], time: str, x: str, y: str, speed: str) -> DataFrame:
    """One row per pair of neighbouring samples of a segment: (by, start_t, end_t, speed, step, acceleration, rejected).

    An interval's speed is the mean of its ends'. Over MAX_SPEED it is unknown, with its step; an acceleration is unknown
    where either speed is, and over MAX_ACCELERATION.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = lambda c: F.lead(c).over(w)
    pairs = df.withColumn("__end", ahead(time)).withColumn("__v", (F.col(speed) + ahead(speed)) / 2).withColumn("__s", F.hypot(ahead(x) - F.col(x), ahead(y) - F.col(y)))
    pairs = pairs.where(F.col("__end").isNotNull()).withColumn("rejected", F.col("__v") > MAX_SPEED)
    pairs = pairs.withColumn("speed", F.when(~F.col("rejected"), F.col("__v"))).withColumn("step", F.when(~F.col("rejected"), F.col("__s")))
    dt = F.greatest(F.col("__end") - F.col(time), F.lit(1e-6))
    change = (F.col("speed") - F.lag("speed").over(w)) / dt
    return pairs.select(*by, F.col(time).alias("start_t"), F.col("__end").alias("end_t"), "speed", "step", F.when(F.abs(change) <= MAX_ACCELERATION, change).alias("acceleration"), "rejected")


def sprints(steps: DataFrame, by: list[str], segment: list[str]) -> DataFrame:
    """(by, n_sprints, sprint_distance): runs of intervals at SPRINT_SPEED or more that last SPRINT_TIME.

    A run ends at the start of the first interval below, or at the end of its segment.
    """
    w = Window.partitionBy(*segment).orderBy("start_t")
    marked = steps.withColumn("__fast", F.coalesce(F.col("speed") >= SPRINT_SPEED, F.lit(False)))
    runs = marked.withColumn("__run", F.sum(F.when(F.col("__fast") != F.lag("__fast", 1, False).over(w), 1).otherwise(0)).over(w)).where("__fast")
    runs = runs.groupBy(*segment, "__run").agg((F.max("end_t") - F.min("start_t")).alias("__t"), F.sum("step").alias("__d")).where(F.col("__t") >= SPRINT_TIME)
    return runs.groupBy(*by).agg(F.count("*").alias("n_sprints"), F.sum("__d").alias("sprint_distance"))


def profiles(tracks: DataFrame, steps: DataFrame, by: list[str], segment: list[str]) -> DataFrame:
    """Physical profile of every track: tracks (by, n_rows, n_usable, duration) with sums over its intervals, 0 without any.

    top_speed is the 99th percentile of more than ten speeds, else the largest. confidence is the usable share of rows,
    less for tracks under five seconds.
    """
    zone = [F.coalesce(F.sum(F.when((F.col("speed") >= lo) & (F.col("speed") < hi), F.col("step"))), F.lit(0.0)).alias(f"{name}_m") for name, lo, hi in ZONES]
    found = steps.groupBy(*by).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"), *zone, F.avg("speed").alias("mean_speed"),
        F.when(F.count("speed") > 10, F.percentile("speed", F.lit(0.99))).otherwise(F.max("speed")).alias("top_speed"),
        F.count_if(F.col("acceleration") > EFFORT).alias("n_accelerations"), F.count_if(F.col("acceleration") < -EFFORT).alias("n_decelerations"),
        F.count_if("rejected").alias("n_rejected"),
    )
    whole = tracks.join(shuffled(found), by, "left").join(shuffled(sprints(steps, by, segment)), by, "left")
    names = [c for c in whole.columns if c not in tracks.columns]
    coverage = F.when(F.col("n_rows") > 0, F.col("n_usable") / F.col("n_rows")).otherwise(0.0)
    trust: Column = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage * F.least(F.lit(1.0), F.col("duration") / 5.0)))
    return whole.select(*tracks.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in names), coverage.alias("coverage"), trust.alias("confidence"))
