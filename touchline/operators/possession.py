"""Who has the ball in a frame: an ordered ladder of rules, and how sure it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators.staging import shuffled


@dataclass(frozen=True)
class Rules:
    """Thresholds in player heights and seconds; fixed values."""

    control_radius: float = 0.6
    loose_radius: float = 4.0
    contest_margin: float = 0.3
    travelling_speed: float = 6.0
    interpolated_factor: float = 0.6
    least_calibration: float = 0.45
    implausible_margin: float = 15.0


def two_nearest(people: DataFrame, ball: DataFrame, by: list[str]) -> DataFrame:
    """Ball frames with the nearest person's track, team and distance and the second's team and distance, in heights.

    people: by, track_id, team_id, x, y, height; without a track or of a height of 1 or less they don't count. ball: by, x, y.
    The two least of a frame are ranked by a window over its people, which are few.
    """
    usable = people.where("track_id is not null and height > 1").select(*by, "track_id", "team_id", "height", F.col("x").alias("__x"), F.col("y").alias("__y"))
    pairs = ball.join(shuffled(usable), by).withColumn("d", F.hypot(F.col("__x") - F.col("x"), F.col("__y") - F.col("y")) / F.col("height"))
    w = Window.partitionBy(*by).orderBy("d", "track_id")
    ranked = pairs.withColumn("__r", F.row_number().over(w)).where("__r <= 2")
    pick = lambda c, n: F.max(F.when(F.col("__r") == n, F.col(c)))
    two = ranked.groupBy(*by).agg(
        pick("track_id", 1).alias("track_id"), pick("team_id", 1).alias("team_id"), pick("d", 1).alias("nearest"),
        pick("team_id", 2).alias("contest_team"), pick("d", 2).alias("contest"),
    )
    return ball.join(shuffled(two), by, "left")


def control_confidence(nearest: Column, contest: Column, speed: Column, interpolated: Column, previous: Column, held: Column, rules: Rules = Rules()) -> Column:
    """0.35 proximity + 0.20 separation + 0.20 stillness + 0.25 duration, less for a new owner and an interpolated ball."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    separation = F.when(contest.isNull(), 1.0).otherwise(unit((contest - nearest) / 2))
    still = F.when(speed.isNull(), 1.0).otherwise(unit(1 - speed / rules.travelling_speed))
    total = 0.35 * unit(1 - nearest / rules.control_radius) + 0.20 * separation + 0.20 * still + 0.25 * unit(held)
    return unit(total * F.when(previous, 1.0).otherwise(0.6) * F.when(interpolated, rules.interpolated_factor).otherwise(1.0))


def decide(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """frames with `state`, `holder`, `holder_team` and `confidence`; of a controlled frame the confidence is control_confidence().

    frames: ball_state (observed, interpolated or unknown), sustained_out, plausible, calibration, track_id, team_id, nearest,
    contest_team, contest, speed, previous_owner, held_for. The first rule that holds decides.
    """
    c = F.col
    known = F.coalesce(c("ball_state").isin("observed", "interpolated"), F.lit(False))
    out = F.coalesce(c("sustained_out") & c("plausible") & (c("calibration") >= rules.least_calibration), F.lit(False))
    fast = F.coalesce(c("speed") > rules.travelling_speed, F.lit(False))
    close = F.coalesce(c("contest") <= rules.control_radius, F.lit(False)) & (c("nearest") <= rules.control_radius)
    opposed = expr.is_team(c("team_id")) & expr.is_team(c("contest_team")) & (c("team_id") != c("contest_team"))
    contested = close & opposed & (c("contest") - c("nearest") < rules.contest_margin)
    held = control_confidence(
        c("nearest"), c("contest"), c("speed"), c("ball_state") == "interpolated", F.coalesce(c("track_id") == c("previous_owner"), F.lit(False)), F.coalesce(c("held_for"), F.lit(0.0)), rules
    )
    far = F.greatest(F.lit(0.3), F.least(F.lit(0.8), c("nearest") / 8))
    ladder = [
        (~known, "unknown", F.lit(0.0)), (out, "out_of_play", F.lit(0.6)), (c("nearest").isNull(), "loose_ball", F.lit(0.3)), (fast, "loose_ball", F.lit(0.55)),
        (c("nearest") > rules.loose_radius, "loose_ball", far), (contested, "contested", F.lit(0.5)), (c("nearest") <= rules.control_radius, "controlled", held),
    ]
    state, sure = F.lit("loose_ball"), F.lit(0.45)
    for holds, name, value in reversed(ladder):
        state, sure = F.when(holds, name).otherwise(state), F.when(holds, value).otherwise(sure)
    out_ = frames.withColumn("state", state).withColumn("confidence", sure)
    mine = F.col("state") == "controlled"
    team = F.when(mine, c("team_id")).when(F.col("state") == "contested", "contested").otherwise("unknown")
    return out_.withColumn("holder", F.when(mine, c("track_id"))).withColumn("holder_team", team)
