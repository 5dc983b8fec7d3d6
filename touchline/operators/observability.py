"""Whether a small object could be seen in a frame at all, and weak evidence of it that neighbouring frames confirm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordered import around, running_sums
from touchline.operators.staging import materialise


@dataclass(frozen=True)
class Visibility:
    """Margins, radii and limits; the defaults are fixed values."""

    margin: float = 24.0
    radius: float = 120.0
    crowd: int = 5
    blur: float = 18.0
    min_keypoints: int = 3
    min_calibration: float = 0.10
    max_frames: int = 12
    max_drift: float = 300.0


#: States in which a missing object counts against the detector, and those that explain its absence. Fixed values.
FAIR = ("likely_visible", "likely_motion_blurred", "uncertain")
EXPLAINED = ("likely_occluded", "likely_outside_frame", "likely_hidden_by_players", "not_on_pitch")


def expectation(frames: DataFrame, by: list[str], rules: Visibility = Visibility()) -> DataFrame:
    """frames with `age`, the frames since the last sighting in the shot, and ex, ey, where it should be by now; nulls if nowhere sure.

    frames: by + frame, x, y (of direct sightings only, else null), cut (a shot starts). The place of the last sighting moves on
    with the speed between the last two of the shot, up to max_frames and max_drift. Sightings are numbered by running counts
    over range partitions, and a frame finds its last ones by number: no video is sorted in one task.
    """
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = running_sums(frames, by, [F.col("frame")], {"__k": seen.cast("long"), "__era": F.coalesce("cut", F.lit(False)).cast("long")})
    rows = materialise(rows, "numbered")
    sightings = rows.where(seen).select(*by, "__k", F.struct("frame", "x", "y", "__era").alias("s"))
    earlier = sightings.select(*by, (F.col("__k") + 1).alias("__k"), F.col("s").alias("p"))
    pairs = sightings.join(earlier, [*by, "__k"], "left")
    # A row that is a sighting itself looks at the one before it.
    wanted = rows.withColumn("__last", F.col("__k") - seen.cast("long"))
    last = pairs.withColumnRenamed("__k", "__last")
    joined = wanted.join(last, [*by, "__last"], "left")
    s = F.when(F.col("s.__era") == F.col("__era"), F.col("s"))
    p = F.when(F.col("p.__era") == F.col("s.__era"), F.col("p"))
    joined = joined.withColumn("s", s).withColumn("p", p)
    age = F.col("frame") - F.col("s.frame")
    step = F.col("s.frame") - F.col("p.frame")
    vx, vy = (F.col("s.x") - F.col("p.x")) / step, (F.col("s.y") - F.col("p.y")) / step
    near = (age > 0) & (age <= rules.max_frames) & F.coalesce(F.hypot(vx, vy) * age <= rules.max_drift, F.lit(True))
    move = lambda c, v: F.when(near, F.col(f"s.{c}") + F.coalesce(v, F.lit(0.0)) * age)
    return joined.select(*frames.columns, age.alias("age"), move("x", vx).alias("ex"), move("y", vy).alias("ey"))


def label_frames(frames: DataFrame, players: DataFrame, by: list[str], width: float, height: float, rules: Visibility = Visibility()) -> DataFrame:
    """(by, frame, state, confidence, age, nearby): how visible the object was in each frame, and how sure that is.

    frames: as in expectation() + camera_motion (null: 0), calibration (null: 1), keypoints (null: 32); players: by + frame and
    corners. Tried in order: no pitch in shot, a blurring camera, no expectation, an expectation outside the picture, inside a
    player's box, in a crowd; else it should have been seen. nearby counts players where a place is expected, else it is null.
    """
    rows = materialise(expectation(frames, by, rules), "expected")
    asked = rows.where("ex is not null and x is null").select(*by, "frame", "ex", "ey")
    near = asked.join(players.select(*by, "frame", "x1", "y1", "x2", "y2"), [*by, "frame"]).groupBy(*by, "frame").agg(
        F.count_if(F.col("ex").between(F.col("x1"), F.col("x2")) & F.col("ey").between(F.col("y1"), F.col("y2"))).alias("inside"),
        F.count_if(F.hypot((F.col("x1") + F.col("x2")) / 2 - F.col("ex"), (F.col("y1") + F.col("y2")) / 2 - F.col("ey")) <= rules.radius).alias("close"),
    )
    rows = rows.join(near, [*by, "frame"], "left").na.fill(0, ["inside", "close"])
    seen, m = F.col("x").isNotNull() & F.col("y").isNotNull(), rules.margin
    off = (F.coalesce("keypoints", F.lit(32)) < rules.min_keypoints) & (F.coalesce("calibration", F.lit(1.0)) < rules.min_calibration)
    blurred = F.coalesce("camera_motion", F.lit(0.0)) >= rules.blur
    outside = ~(F.col("ex").between(m, width - m) & F.col("ey").between(m, height - m))
    cases = [
        (seen, "likely_visible", 1.0), (off, "not_on_pitch", 0.8), (blurred, "likely_motion_blurred", 0.6), (F.col("ex").isNull(), "uncertain", 0.3), (outside, "likely_outside_frame", 0.7),
        (F.col("inside") > 0, "likely_occluded", 0.75), (F.col("close") >= rules.crowd, "likely_hidden_by_players", 0.6),
    ]
    state, sure = F.lit("likely_visible"), F.lit(0.7)
    for when, name, value in reversed(cases):
        state, sure = F.when(when, name).otherwise(state), F.when(when, value).otherwise(sure)
    counted = ~seen & ~off & ~blurred & F.col("ex").isNotNull() & ~outside
    return rows.select(*by, "frame", state.alias("state"), sure.alias("confidence"), F.when(seen, 0).otherwise(F.col("age")).alias("age"), F.when(counted, F.col("close")).alias("nearby"))


def visibility_summary(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_frames, fair, explained, observed, raw_coverage, fair_coverage) of label_frames(): coverage of all and of fair frames."""
    observed = F.col("confidence") == 1.0
    fair = F.col("state").isin(*FAIR)
    t = labels.groupBy(*by).agg(F.count("*").alias("n_frames"), F.count_if(fair).alias("fair"), F.count_if(F.col("state").isin(*EXPLAINED)).alias("explained"), F.count_if(observed).alias("observed"))
    return t.select("*", (F.col("observed") / F.col("n_frames")).alias("raw_coverage"), F.coalesce(F.try_divide("observed", "fair"), F.lit(0.0)).alias("fair_coverage"))


@dataclass(frozen=True)
class Recovery:
    """What a run of weak evidence needs; the defaults are fixed values."""

    min_run: int = 3
    max_gap: int = 15
    max_step: float = 60.0
    max_deviation: float = 36.0
    min_ratio: float = 3.0
    max_confidence: float = 0.45


def confirmed(candidates: DataFrame, by: list[str], rules: Recovery = Recovery()) -> DataFrame:
    """(by, frame, x, y, confidence, first_frame, last_frame, consistency) of weak candidates that a run of frames supports.

    candidates: by + frame (one a frame), x, y, ratio (of its response to the surroundings), deviation (from where it was expected), gap_frames
    (length of the gap that is being filled) and perhaps visibility. A run goes on from frame to next frame by steps an object can
    take; min_run frames confirm it. Confidence falls with weak response, deviation and uneven steps. Gaps that are too long, frames
    outside the picture or off the pitch and rows with nulls take no part.
    """
    rows = candidates.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("ratio").isNotNull() & F.col("deviation").isNotNull() & (F.col("gap_frames") <= rules.max_gap))
    if "visibility" in candidates.columns:
        rows = rows.where(~F.coalesce(F.col("visibility").isin("likely_outside_frame", "not_on_pitch"), F.lit(False)))
    linked = around(rows.select(*by, "frame", "x", "y", "ratio", "deviation"), by, "frame", F.struct("x", "y"), 1, 0)
    before = F.try_element_at(F.filter("near", lambda n: n["d"] == -1), F.lit(1))["item"]
    step = F.hypot(F.col("x") - before["x"], F.col("y") - before["y"])
    marked = linked.withColumn("__step", F.when(step <= rules.max_step, step))
    runs = running_sums(marked.drop("near"), by, [F.col("frame")], {"__run": F.col("__step").isNull().cast("long")})
    runs = materialise(runs, "runs")
    # The first row of a run has no step, so the steps of a run are those of its other rows.
    whole = runs.groupBy(*by, "__run").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.avg("__step").alias("mean"), F.stddev_pop("__step").alias("spread"))
    consistency = 1 / (1 + F.coalesce("spread", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("mean", F.lit(0.0))))
    kept = runs.join(whole.where(F.col("n") >= rules.min_run).withColumn("consistency", consistency), [*by, "__run"])
    strength = F.least(F.lit(1.0), F.col("ratio") / (rules.min_ratio * 3))
    close = 1 - F.least(F.lit(1.0), F.col("deviation") / rules.max_deviation)
    sure = F.least(F.lit(rules.max_confidence), rules.max_confidence * strength * close * F.col("consistency"))
    return kept.select(*by, "frame", "x", "y", sure.alias("confidence"), "first_frame", "last_frame", "consistency")
