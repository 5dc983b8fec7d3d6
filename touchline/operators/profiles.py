"""Profiles of players, keepers and teams as tables of metrics, each with its coverage and confidence; grids of where things happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators.staging import shuffled

TRACK = ["video_id", "track_id"]
#: Metric and the event type it counts, of the track itself; and of the track an event is related to. Fixed values.
COUNTS = {
    "touches": "ball_touch", "pass_attempts": "pass", "passes_completed": "pass_successful", "passes_failed": "pass_failed", "progressive_passes": "pass_progressive", "long_passes": "pass_long",
    "back_passes": "pass_back", "crosses": "cross", "carries": "carry", "dribble_candidates": "dribble_candidate", "interceptions": "interception", "recoveries": "recovery", "clearances": "clearance",
    "possession_lost": "turnover", "shots": "shot", "shots_on_target": "shot_on_target",
}
RELATED = {"passes_received": "pass_successful"}
#: Physical metrics: column of motion.profiles() and unit.
PHYSICAL = {
    "distance_m": ("distance", "m"), "mean_speed_m_s": ("mean_speed", "m/s"), "top_speed_m_s": ("top_speed", "m/s"), "sprints": ("n_sprints", "count"), "sprint_distance_m": ("sprint_distance", "m"),
    "accelerations": ("n_accelerations", "count"), "decelerations": ("n_decelerations", "count"), "distance_walking_m": ("walking_m", "m"), "distance_jogging_m": ("jogging_m", "m"),
    "distance_running_m": ("running_m", "m"), "distance_high_speed_m": ("high_speed_m", "m"), "distance_sprinting_m": ("sprinting_m", "m"),
}
_METRIC = "array<struct<metric:string,value:double,coverage:double,confidence:double,n_samples:bigint,basis:string,unit:string>>"


def _metric(name: str, value: Column, coverage: Column, confidence: Column, n: Column, basis: str, unit: str) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(
        F.lit(name).alias("metric"), d(value).alias("value"), d(coverage).alias("coverage"), d(confidence).alias("confidence"), n.cast("bigint").alias("n_samples"), F.lit(basis).alias("basis"), F.lit(unit).alias("unit")
    )


def track_coverage(state: DataFrame, ball: DataFrame, physical: DataFrame, labels: DataFrame) -> DataFrame:
    """(video_id, track_id, n_rows, first_s, last_s, tracking, pitch, ball, identity, mean_x, mean_y): how much of a track each kind of evidence covers.

    state: game state; ball: ball_by_frame(); physical: physical_profiles(); labels: video_id, track_id, team_confidence. tracking is
    a track's rows over the video's frames, ball the share of its rows whose frame has a known ball.
    """
    key = ["video_id", "frame_idx"]
    people = state.where("object_class <> 'ball' and track_id is not null").select(*key, "track_id", "timestamp_s", "pitch_x", "pitch_y", "validation_status")
    known = ball.select(*key, (F.col("ball_state") != "unknown").alias("known"))
    usable = F.col("validation_status") == "valid"
    t = people.join(shuffled(known), key, "left").groupBy(*TRACK).agg(
        F.count("*").alias("n_rows"), F.min("timestamp_s").alias("first_s"), F.max("timestamp_s").alias("last_s"), F.avg(F.coalesce("known", F.lit(False)).cast("double")).alias("ball"),
        F.avg(F.when(usable, F.col("pitch_x"))).alias("mean_x"), F.avg(F.when(usable, F.col("pitch_y"))).alias("mean_y"),
    )
    frames = ball.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    t = t.join(frames, "video_id").join(shuffled(physical.select(*TRACK, F.col("coverage").alias("pitch"))), TRACK, "left").join(shuffled(labels.select(*TRACK, F.col("team_confidence").alias("identity"))), TRACK, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return t.select(*TRACK, "n_rows", "first_s", "last_s", (F.col("n_rows") / F.col("n_frames")).alias("tracking"), zero("pitch"), "ball", zero("identity"), "mean_x", "mean_y")


def player_metrics(coverage: DataFrame, physical: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """(video_id, track_id, metric, value, coverage, confidence, n_samples, basis, unit): some thirty metrics of every tracked person.

    coverage: track_coverage(); events: match_events.detect(); spans: possession_spans(). Counts are 0 where nothing was found;
    a rate without attempts is null with coverage 0, not 0. Counts rest on how often the ball is known; their n_samples are all
    events the track has a part in.
    """
    e = events.withColumnRenamed("video", "video_id")
    own = e.where("track_id is not null").groupBy(*TRACK).agg(*(F.count_if(F.col("event_type") == t).alias(n) for n, t in COUNTS.items()), F.count("*").alias("__own"))
    other = e.where("related_track_id is not null").select("video_id", F.col("related_track_id").alias("track_id"), "event_type").groupBy(*TRACK)
    other = other.agg(*(F.count_if(F.col("event_type") == t).alias(n) for n, t in RELATED.items()), F.count("*").alias("__related"))
    held = spans.withColumnRenamed("video", "video_id").where("state = 'controlled' and track_id is not null").groupBy(*TRACK).agg(F.sum("duration").alias("__held"))
    rows = coverage.join(shuffled(physical.drop("coverage", "n_rows", "duration")), TRACK, "left")
    for part in (own, other, held):
        rows = rows.join(shuffled(part), TRACK, "left")
    rows = rows.na.fill(0, [*COUNTS, *RELATED, "__own", "__related"]).na.fill(0.0, ["__held"])
    c = F.col
    n = c("__own") + c("__related")
    counted = lambda name: _metric(name, c(name), c("ball"), c("ball") * F.greatest(F.lit(0.2), c("identity")), n, "event_derived", "")
    moved = lambda name, column, unit: _metric(name, F.coalesce(column, F.lit(0)), c("pitch"), F.coalesce("confidence", F.lit(0.0)), F.coalesce("n_usable", F.lit(0)), "pitch_space", unit)
    passes = c("pass_attempts")
    some = passes > 0
    accuracy = _metric(
        "pass_accuracy_pct", F.when(some, 100 * c("passes_completed") / passes), F.when(some, c("ball")).otherwise(0.0), F.when(some, c("ball") * F.least(F.lit(1.0), passes / 5)).otherwise(0.0), passes, "event_derived", "%"
    )
    metrics = F.array(
        *(moved(name, column, unit) for name, (column, unit) in PHYSICAL.items()), *(counted(name) for name in (*COUNTS, *RELATED)), accuracy,
        _metric("possession_time_s", c("__held"), c("ball"), c("ball"), c("n_rows"), "event_derived", "s"),
        _metric("minutes_tracked", (c("last_s") - c("first_s")) / 60, c("tracking"), c("identity"), c("n_rows"), "image_space", "min"),
    )
    return rows.select(*TRACK, F.inline(metrics.cast(_METRIC)))


def keeper_metrics(players: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    """(video_id, track_id, metric, value): what goalkeeper tracks faced and did with the ball.

    players: player_metrics(); labels: video_id, track_id, team_id, role. Shots are those of the other team; whether one was saved can't
    be told without the goal line, so save_candidates are an upper bound. An accuracy without distributions is null.
    """
    e = events.withColumnRenamed("video", "video_id")
    keepers = labels.where("role = 'goalkeeper'").select(*TRACK, "team_id")
    shots = e.where(expr.is_team(F.col("team_id"))).groupBy("video_id", F.when(F.col("team_id") == "A", "B").otherwise("A").alias("team_id")).agg(
        F.count_if(F.col("event_type") == "shot").alias("shots_faced"), F.count_if(F.col("event_type") == "goal_candidate").alias("goal_candidates_conceded")
    )
    given = F.col("event_type").isin("pass", "clearance")
    own = e.groupBy(*TRACK).agg(
        F.count_if(given).alias("distributions"), F.count_if(F.col("event_type") == "pass_successful").alias("distributions_completed"), F.count_if(given & (F.coalesce("distance", F.lit(0.0)) >= 25)).alias("long_distributions")
    )
    rows = keepers.join(shots, ["video_id", "team_id"], "left").join(shuffled(own), TRACK, "left").na.fill(0)
    names = ("shots_faced", "goal_candidates_conceded", "distributions", "distributions_completed", "long_distributions")
    cell = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    made = F.array(*(cell(n, F.col(n)) for n in names), cell("save_candidates", F.col("shots_faced")), cell("distribution_accuracy_pct", 100 * expr.ratio(F.col("distributions_completed"), F.col("distributions"))))
    kept = players.where(F.col("metric").isin("recoveries", "clearances", "distance_m")).select(*TRACK, "metric", "value").join(shuffled(keepers.select(*TRACK)), TRACK, "left_semi")
    return rows.select(*TRACK, F.inline(made)).unionByName(kept)


def team_metrics(players: DataFrame, labels: DataFrame, coverage: DataFrame) -> DataFrame:
    """(video_id, team_id, n_players, metric, value, coverage): sums over a team's tracks of their counts and distances, and the team's pass accuracy."""
    mine = labels.where(expr.is_team(F.col("team_id"))).select(*TRACK, "team_id")
    size = mine.join(coverage, TRACK).groupBy("video_id", "team_id").agg(F.count("*").alias("n_players"), F.avg("ball").alias("coverage"))
    summed = players.where(F.col("unit").isin("", "m", "s", "count")).join(mine, TRACK).groupBy("video_id", "team_id", "metric").agg(F.sum("value").alias("value"))
    of = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    rate = summed.groupBy("video_id", "team_id").agg((100 * F.try_divide(of("passes_completed"), of("pass_attempts"))).alias("value")).select("video_id", "team_id", F.lit("pass_accuracy_pct").alias("metric"), "value")
    return summed.unionByName(rate).join(size, ["video_id", "team_id"]).select("video_id", "team_id", "n_players", "metric", "value", "coverage")


#: Cells of a heatmap along and across the pitch; fixed values.
GRID = (26, 17)
#: Kinds that are read from events, with their types and which end of them counts.
EVENT_KINDS = {
    "touches": (("ball_touch",), "start"), "carries": (("carry",), "start"), "pass_origin": (("pass",), "start"), "pass_destination": (("pass_successful",), "end"),
    "defensive_actions": (("interception", "recovery", "clearance"), "start"),
}
FAST = 5.5


def heatmap_points(state: DataFrame, frames: DataFrame, ball: DataFrame, events: DataFrame, spans: DataFrame, speeds: DataFrame, phase: str = "all", time_range: tuple[float, float] | None = None, half: int | None = None, switches: DataFrame | None = None) -> DataFrame:
    """(video_id, kind, track_id, team_id, x, y, weight) of everything that the nine kinds of heatmap count.

    state, frames: game state; ball: ball_by_frame(); speeds: video_id, track_id, frame_idx, speed. position, influence (more weight the
    faster) and sprints (at FAST or more) are valid rows of people; possession is the ball's place while a team holds it, which
    spans tell by frame; the rest are events. phase keeps rows of people while their own team holds the ball (in_possession,
    attacking) or doesn't (out_of_possession, defending). half needs switches: video_id, switch_s, the time of the first change of ends.
    """
    key = ["video_id", "frame_idx"]
    time = frames.select(*key, "timestamp_s")
    if switches is not None:
        time = time.join(switches, "video_id", "left")
    if half is not None:
        late = F.coalesce(F.col("timestamp_s") >= F.col("switch_s"), F.lit(False)) if switches is not None else F.lit(False)
        time = time.where(F.when(late, 2).otherwise(1) == half)
    if time_range is not None:
        time = time.where(F.col("timestamp_s").between(*time_range))
    time = time.select(*key)
    held = spans.withColumnRenamed("video", "video_id").where("state = 'controlled'").where(expr.is_team(F.col("team_id")))
    # A span covers the processed frames between its ends; a frame lies in one span at most.
    owned = held.select("video_id", F.col("team_id").alias("owner"), F.col("track_id").alias("holder"), F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    people = state.where("object_class <> 'ball' and validation_status = 'valid' and pitch_x is not null and track_id is not null").select(*key, "track_id", "team_id", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"))
    people = people.join(time, key, "left_semi").join(owned.select(*key, "owner"), key, "left")
    mine = F.coalesce(F.col("owner") == F.col("team_id"), F.lit(False)) | ~expr.is_team(F.col("team_id"))
    if phase in ("in_possession", "attacking"):
        people = people.where(mine)
    elif phase in ("out_of_possession", "defending"):
        people = people.where(~mine | ~expr.is_team(F.col("team_id")))
    elif phase != "all":
        raise ValueError(f"no phase is called {phase}")
    fast = people.join(speeds, ["video_id", "track_id", "frame_idx"], "left")
    point = lambda rows, kind, weight=F.lit(1.0): rows.select("video_id", F.lit(kind).alias("kind"), F.col("track_id").cast("long").alias("track_id"), "team_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), weight.alias("weight"))
    out = point(people, "position").unionByName(point(fast, "influence", 1 + F.coalesce("speed", F.lit(0.0)) / 5)).unionByName(point(fast.where(F.col("speed") >= FAST), "sprints"))
    where = ball.where("x is not null").select(*key, "x", "y").join(time, key, "left_semi")
    out = out.unionByName(point(owned.join(where, key).select("video_id", F.col("holder").alias("track_id"), F.col("owner").alias("team_id"), "x", "y"), "possession"))
    e = events.withColumnRenamed("video", "video_id").join(time, key, "left_semi")
    for kind, (types, end) in EVENT_KINDS.items():
        rows = e.where(F.col("event_type").isin(*types)).select("video_id", "track_id", "team_id", F.col(f"{end}_x").alias("x"), F.col(f"{end}_y").alias("y")).where("x is not null and y is not null")
        out = out.unionByName(point(rows, kind))
    return out


def heatmap_grids(points: DataFrame, of: list[str], length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(of, gx, gy, share, n): the share of each cell in its map's weight, points outside the pitch counted at its edge. Cells without points aren't there.

    of: the columns that name a map, such as video_id, kind and team_id or track_id; rows that have a null in one are left out.
    """
    known = points
    for c in of:
        known = known.where(F.col(c).isNotNull())
    cell = lambda v, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(v) / size * n))).cast("int")
    cells = known.groupBy(*of, cell("x", length, GRID[0]).alias("gx"), cell("y", width, GRID[1]).alias("gy")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    whole = cells.groupBy(*of).agg(F.sum("w").alias("total"))
    return cells.join(whole, of).select(*of, "gx", "gy", (F.col("w") / F.col("total")).alias("share"), "n")
