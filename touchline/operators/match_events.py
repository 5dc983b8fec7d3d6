"""Match events from possession spans: touches, carries, passes, turnovers, shots, dead balls, contests.

Spans: video, span (their order), state, team_id, track_id, start_frame, end_frame, start_t, end_t, duration, confidence,
start_x, start_y, end_x, end_y (the ball at its ends, null where unknown). Directions: video, team_id, direction (1 towards
larger x, -1 towards smaller, 0 unknown). Each family is a projection or a `lead` within a video, and an event's kinds are one
array exploded, so spans are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators.staging import shuffled


@dataclass(frozen=True)
class Rules:
    """Thresholds in metres and seconds, and the pitch; fixed values."""

    least_pass: float = 3.0
    long_pass: float = 25.0
    progressive: float = 10.0
    back: float = -5.0
    cross_width: float = 18.0
    least_carry: float = 4.0
    dribble: float = 8.0
    shot_distance: float = 35.0
    target_half_width: float = 4.0
    interception_time: float = 1.2
    length: float = 105.0
    width: float = 68.0
    box_length: float = 16.5
    box_width: float = 40.32


EVENT = ("video", "event_type", "frame_idx", "team_id", "track_id", "related_track_id", "confidence", "start_x", "start_y", "end_x", "end_y", "distance", "duration")


def _emit(rows: DataFrame, kinds: list[tuple[Column, str, Column]], **columns: Column) -> DataFrame:
    """One event for each kind (condition, type, confidence) that holds for a row."""
    made = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("event_type"), sure.cast("double").alias("confidence"))) for when, kind, sure in kinds))
    types = {"frame_idx": "long", "track_id": "long", "related_track_id": "long", "team_id": "string"}
    out = rows.withColumn("__e", F.explode(F.array_compact(made)))
    cell = lambda c: F.col(f"__e.{c}") if c in ("event_type", "confidence") else columns["video"] if c == "video" else columns.get(c, F.lit(None)).cast(types.get(c, "double"))
    return out.select(*(cell(c).alias(c) for c in EVENT))


def coverage(windows: DataFrame, ball: DataFrame, first: str = "from_frame", last: str = "to_frame") -> DataFrame:
    """windows with `coverage`, the share of its processed frames with a known ball, and `ball_state`, the dominant state.

    ball: video, frame_idx, state of every processed frame. Running counts at both ends give a closed window's counts, so
    nothing is joined by range; both ends must be processed frames.
    """
    w = Window.partitionBy("video").orderBy("frame_idx")
    flag = lambda c: c.cast("long")
    known, observed = flag(F.col("state").isin("observed", "interpolated")), flag(F.col("state") == "observed")
    counted = ball.select("video", "frame_idx", known.alias("k"), observed.alias("o"), F.sum(known).over(w).alias("ks"), F.sum(observed).over(w).alias("os"), F.row_number().over(w).alias("n"))
    a = counted.select("video", F.col("frame_idx").alias(first), (F.col("ks") - F.col("k")).alias("k0"), (F.col("os") - F.col("o")).alias("o0"), (F.col("n") - 1).alias("n0"))
    b = counted.select("video", F.col("frame_idx").alias(last), "ks", "os", "n")
    both = windows.join(shuffled(a), ["video", first], "left").join(shuffled(b), ["video", last], "left")
    n, k, o = F.col("n") - F.col("n0"), F.col("ks") - F.col("k0"), F.col("os") - F.col("o0")
    state = F.when(o * 2 > n, "observed").when(k > 0, "interpolated").otherwise("unknown")
    return both.select(*windows.columns, F.when(n > 0, k / n).otherwise(0.0).alias("coverage"), state.alias("ball_state"))


def directed(spans: DataFrame, directions: DataFrame, team: str = "team_id", name: str = "direction") -> DataFrame:
    d = directions.select("video", F.col("team_id").alias(team), F.col("direction").alias(name))
    return spans.join(d, ["video", team], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def touches_and_carries(spans: DataFrame, directions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A touch for each controlled span, a carry where the ball moved with its holder, a dribble candidate where it gained."""
    held = directed(spans.where("state = 'controlled' and track_id is not null"), directions)
    c = F.col
    moved = expr.distance(c("end_x") - c("start_x"), c("end_y") - c("start_y"))
    gain = (c("end_x") - c("start_x")) * c("direction")
    carried = moved >= rules.least_carry
    own = {x: c(x) for x in ("video", "team_id", "track_id", "start_x", "start_y")} | {"frame_idx": c("start_frame")}
    touch = _emit(held, [(F.lit(True), "ball_touch", c("confidence"))], duration=c("duration"), **own)
    kinds = [(carried, "carry", c("confidence")), (carried & (c("direction") != 0) & (gain >= rules.dribble), "dribble_candidate", c("confidence") * 0.8)]
    return touch.unionByName(_emit(held, kinds, duration=c("duration"), end_x=c("end_x"), end_y=c("end_y"), distance=F.round(moved, 2), **own))


def handovers(spans: DataFrame) -> DataFrame:
    """Neighbouring controlled spans of different holders with a known ball at both ends: a row of columns a_* and b_*.

    `contested`: whether a contested span lies between.
    """
    w = Window.partitionBy("video").orderBy("span")
    fights = F.sum((F.col("state") == "contested").cast("long")).over(w)
    held = spans.withColumn("fights", fights).where("state = 'controlled' and track_id is not null")
    names = [c for c in held.columns if c != "video"]
    after = F.lead(F.struct(*names)).over(w)
    pairs = held.select("video", F.struct(*names).alias("a"), after.alias("b")).where("b is not null and a.track_id <> b.track_id")
    flat = pairs.select("video", *(F.col(f"a.{n}").alias(f"a_{n}") for n in names), *(F.col(f"b.{n}").alias(f"b_{n}") for n in names))
    return flat.where("a_end_x is not null and b_start_x is not null").withColumn("contested", F.col("b_fights") > F.col("a_fights"))


def pass_and_turnover(spans: DataFrame, ball: DataFrame, directions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Passes within a team, and what a change of team is: turnover, failed pass, interception or recovery, shot or clearance."""
    c = F.col
    pairs = handovers(spans).withColumn("from_frame", c("a_end_frame")).withColumn("to_frame", c("b_start_frame"))
    pairs = directed(coverage(pairs, ball), directions, "a_team_id", "forward")
    other = directions.withColumn("team_id", F.when(c("team_id") == "A", "B").otherwise("A"))
    rows = directed(pairs.withColumn("own_side", F.when(c("a_team_id") == "A", "A").otherwise("B")), other, "own_side", "behind")
    x0, y0, x1, y1 = c("a_end_x"), c("a_end_y"), c("b_start_x"), c("b_start_y")
    distance = expr.distance(x1 - x0, y1 - y0)
    gap = F.greatest(F.lit(0.0), (c("b_start_t") - c("a_end_t")).cast("double"))
    sure = F.least("a_confidence", "b_confidence") * F.greatest(F.lit(0.2), c("coverage"))
    same = (c("a_team_id") == c("b_team_id")) & expr.is_team(c("a_team_id"))
    lost = ~F.coalesce(same, F.lit(False)) & expr.is_team(c("b_team_id"))
    moved = distance >= rules.least_pass
    gain = F.when(c("forward") != 0, (x1 - x0) * c("forward"))
    right = c("forward") > 0
    in_box = y1.between((rules.width - rules.box_width) / 2, (rules.width + rules.box_width) / 2) & F.when(
        right, x1.between(rules.length - rules.box_length, rules.length)
    ).otherwise(x1.between(0, rules.box_length))
    third = F.when(right, x0 > 2 * rules.length / 3).otherwise(x0 < rules.length / 3)
    cross = (c("forward") != 0) & (F.least(y0, rules.width - y0) <= rules.cross_width) & third & in_box
    goal_x = F.when(right, rules.length).otherwise(0.0)
    before, after = expr.distance(goal_x - x0, rules.width / 2 - y0), expr.distance(goal_x - x1, rules.width / 2 - y1)
    own_x = F.when(c("behind") > 0, rules.length).otherwise(0.0)
    away, far = expr.distance(own_x - x0, rules.width / 2 - y0), expr.distance(own_x - x1, rules.width / 2 - y1)
    aimed = lost & (c("forward") != 0)
    shot = aimed & (before <= rules.shot_distance) & (after < before) & moved
    target = shot & (F.abs(y1 - rules.width / 2) <= rules.target_half_width)
    cleared = aimed & ~shot & (c("behind") != 0) & (away < 25) & (far > away + 8)
    passed, quick = same & moved, moved & (gap <= rules.interception_time)
    a = _emit(
        rows,
        [
            (passed, "pass", sure), (passed, "pass_successful", sure), (passed & (distance >= rules.long_pass), "pass_long", sure),
            (passed & (gain >= rules.progressive), "pass_progressive", sure), (passed & (gain <= rules.back), "pass_back", sure), (passed & cross, "cross", sure * 0.85),
            (lost, "turnover", sure), (lost & quick, "pass_failed", sure), (shot, "shot", sure * 0.7), (target, "shot_on_target", sure * 0.6),
            (target & (after < 3), "goal_candidate", sure * 0.4), (cleared, "clearance", sure * 0.75),
        ],
        video=c("video"), frame_idx=c("a_end_frame"), team_id=c("a_team_id"), track_id=c("a_track_id"), related_track_id=c("b_track_id"),
        start_x=x0, start_y=y0, end_x=x1, end_y=y1, distance=F.round(distance, 2), duration=F.round(gap, 3),
    )
    b = _emit(
        rows, [(lost & quick, "interception", sure), (lost & ~quick, "recovery", sure * 0.9)],
        video=c("video"), frame_idx=c("b_start_frame"), team_id=c("b_team_id"), track_id=c("b_track_id"), related_track_id=c("a_track_id"), start_x=x1, start_y=y1,
    )
    return a.unionByName(b)


def dead_and_contested(spans: DataFrame) -> DataFrame:
    """Balls out with the restart at the next controlled span, loose balls of 0.4 s and contests of 0.3 s."""
    c = F.col
    # Read backwards: a frame that grows with the rows is one pass, one that shrinks is read anew for each row.
    w = Window.partitionBy("video").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    held = F.when((c("state") == "controlled") & c("track_id").isNotNull(), F.struct("start_frame", "team_id", "track_id", "confidence"))
    rows = spans.withColumn("next", F.last(held, ignorenulls=True).over(w))
    own = {x: c(x) for x in ("video", "team_id", "track_id")} | {"frame_idx": c("start_frame")}
    out = _emit(rows.where("state = 'out_of_play'"), [(F.lit(True), "ball_out", c("confidence"))], start_x=c("start_x"), start_y=c("start_y"), **own)
    back = _emit(
        rows.where("state = 'out_of_play' and next is not null"), [(F.lit(True), "restart", c("next.confidence") * 0.7)],
        video=c("video"), frame_idx=c("next.start_frame"), team_id=c("next.team_id"), track_id=c("next.track_id"),
    )
    kinds = [((c("state") == "loose_ball") & (c("duration") >= 0.4), "loose_ball", c("confidence")), ((c("state") == "contested") & (c("duration") >= 0.3), "contested_possession", c("confidence"))]
    return out.unionByName(back).unionByName(_emit(rows, kinds, duration=c("duration"), **own))


def detect(spans: DataFrame, ball: DataFrame, directions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All families, with an id from the event's content that reruns repeat."""
    found = touches_and_carries(spans, directions, rules).unionByName(pass_and_turnover(spans, ball, directions, rules)).unionByName(dead_and_contested(spans))
    key = F.concat_ws("|", "video", "event_type", "frame_idx", F.coalesce(F.col("track_id").cast("string"), F.lit("-")), F.coalesce(F.col("related_track_id").cast("string"), F.lit("-")))
    return found.withColumn("event_id", F.substring(F.sha2(key, 256), 1, 16))
