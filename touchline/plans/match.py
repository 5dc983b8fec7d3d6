"""Match analytics on the event table: its rows are a video's frames, pairs of frames its possession spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import edits, match_events, motion, possession, scoring
from touchline.plans.registry import query
from touchline.sources.tables import boxes, states, table

r = lambda c, n=6: F.round(c, n)
W = "(PARTITION BY video ORDER BY f)"
FRAMES = """, fr AS (SELECT u AS video, CAST(row_number() OVER (PARTITION BY u ORDER BY t, id) AS BIGINT) AS f, id, state AS event_type,
   CASE id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'interpolated' ELSE 'observed' END AS ball_state,
   CASE WHEN id % 5 <> 0 THEN CAST(id * 37 % 1050 AS DOUBLE) / 10 END AS x, CASE WHEN id % 5 <> 0 THEN CAST(id * 53 % 680 AS DOUBLE) / 10 END AS y FROM ev)"""
SPANS = FRAMES + f""", sp AS (SELECT video, (f - 1) // 2 AS span, id % 11 AS track_id, f AS start_frame, coalesce(lead(f) OVER {W}, f) AS end_frame,
   CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'controlled' WHEN event_type = 'view' THEN 'contested' WHEN id % 2 = 1 THEN 'loose_ball' ELSE 'out_of_play' END AS state,
   CASE WHEN id % 11 % 5 = 0 THEN 'unknown' WHEN id % 11 % 2 = 1 THEN 'A' ELSE 'B' END AS team_id, CAST(id % 97 AS DOUBLE) / 97 AS confidence, x AS start_x, y AS start_y,
   CASE WHEN lead(f) OVER {W} IS NULL THEN x ELSE lead(x) OVER {W} END AS end_x, CASE WHEN lead(f) OVER {W} IS NULL THEN y ELSE lead(y) OVER {W} END AS end_y
   FROM fr QUALIFY f % 2 = 1),
 s AS (SELECT *, start_frame * 0.75::DOUBLE AS start_t, end_frame * 0.75::DOUBLE AS end_t, (end_frame - start_frame) * 0.75::DOUBLE AS duration,
   CASE team_id WHEN 'A' THEN video % 3 - 1 WHEN 'B' THEN 1 - video % 3 ELSE 0 END AS direction FROM sp)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.row_number().over(Window.partitionBy("u").orderBy("t", "id")).cast("long")
    known, five = F.col("id") % 5 != 0, F.col("id") % 5
    place = lambda a, b: F.when(known, (F.col("id") * a % b).cast("double") / 10)
    ball = F.when(five == 0, "unknown").when(five == 1, "interpolated").otherwise("observed")
    return states(spark, sf_dir).select(
        F.col("u").alias("video"), f.alias("f"), "id", F.col("state").alias("event_type"), ball.alias("ball_state"), place(37, 1050).alias("x"), place(53, 680).alias("y")
    )


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video").orderBy("f")
    track, kind = F.col("id") % 11, F.col("event_type")
    ahead = lambda c: F.lead(c).over(w)
    state = F.when(kind.isin("click", "purchase", "signup"), "controlled").when(kind == "view", "contested").when(F.col("id") % 2 == 1, "loose_ball").otherwise("out_of_play")
    team = F.when(track % 5 == 0, "unknown").when(track % 2 == 1, "A").otherwise("B")
    last = lambda c: F.when(ahead("f").isNull(), F.col(c)).otherwise(ahead(c))
    s = _frames(spark, sf_dir).select(
        "video", F.floor((F.col("f") - 1) / 2).alias("span"), state.alias("state"), team.alias("team_id"), track.alias("track_id"), F.col("f").alias("start_frame"),
        F.coalesce(ahead("f"), "f").alias("end_frame"), (F.col("id") % 97 / 97).alias("confidence"), F.col("x").alias("start_x"), F.col("y").alias("start_y"),
        last("x").alias("end_x"), last("y").alias("end_y"),
    ).where("start_frame % 2 = 1")
    time = lambda c: (F.col(c) * F.lit(0.75)).cast("double")
    return s.withColumn("start_t", time("start_frame")).withColumn("end_t", time("end_frame")).withColumn("duration", F.col("end_t") - F.col("start_t"))


def _ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("video", F.col("f").alias("frame_idx"), F.col("ball_state").alias("state"))


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = states(spark, sf_dir).select(F.col("u").alias("video")).distinct()
    side = (F.col("video") % 3 - 1).cast("int")
    return d.select("video", F.lit("A").alias("team_id"), side.alias("direction")).unionByName(d.select("video", F.lit("B").alias("team_id"), (-side).alias("direction")))


def _shown(events: DataFrame) -> DataFrame:
    return events.select(
        "video", "event_type", "frame_idx", "team_id", "track_id", "related_track_id", r("confidence").alias("confidence"), r("start_x").alias("start_x"), r("end_y").alias("end_y"),
        r("distance", 2).alias("distance"), r("duration", 3).alias("duration"),
    )


@query(SPANS + """, e AS (SELECT *, sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) AS d, (end_x - start_x) * direction AS gain FROM s WHERE state = 'controlled')
 SELECT video, 'ball_touch' AS event_type, start_frame AS frame_idx, team_id, track_id, CAST(NULL AS BIGINT) AS related_track_id, round(confidence, 6) AS confidence, round(start_x, 6) AS start_x,
  CAST(NULL AS DOUBLE) AS end_y, CAST(NULL AS DOUBLE) AS distance, round(duration, 3) AS duration FROM e
 UNION ALL SELECT video, 'carry', start_frame, team_id, track_id, NULL, round(confidence, 6), round(start_x, 6), round(end_y, 6), round(d, 2), round(duration, 3) FROM e WHERE d >= 4
 UNION ALL SELECT video, 'dribble_candidate', start_frame, team_id, track_id, NULL, round(confidence * 0.8, 6), round(start_x, 6), round(end_y, 6), round(d, 2), round(duration, 3)
  FROM e WHERE d >= 4 AND direction <> 0 AND gain >= 8""")
def touches_and_carries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A touch per controlled span, carries and dribble candidates."""
    return _shown(match_events.touches_and_carries(_spans(spark, sf_dir), _directions(spark, sf_dir)))


HANDOVERS = SPANS + """, h AS (SELECT * FROM (SELECT *, lead(start_frame) OVER w AS b_frame, lead(start_t) OVER w AS b_t, lead(track_id) OVER w AS b_track, lead(team_id) OVER w AS b_team,
   lead(confidence) OVER w AS b_conf, lead(start_x) OVER w AS bx, lead(start_y) OVER w AS by_ FROM s WHERE state = 'controlled' WINDOW w AS (PARTITION BY video ORDER BY span))
   WHERE b_track <> track_id AND end_x IS NOT NULL AND bx IS NOT NULL),
 k AS (SELECT h.video, h.span, avg(CASE WHEN fr.ball_state <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END) AS cover FROM h JOIN fr ON fr.video = h.video AND fr.f BETWEEN h.end_frame AND h.b_frame GROUP BY 1, 2),
 q AS (SELECT *, sqrt((bx - end_x) * (bx - end_x) + (by_ - end_y) * (by_ - end_y)) AS d, greatest(0, b_t - end_t) AS gap, least(confidence, b_conf) * greatest(0.2::DOUBLE, cover) AS sure,
   (bx - end_x) * direction AS gain, team_id = b_team AND team_id <> 'unknown' AS same, CASE WHEN direction > 0 THEN 105.0::DOUBLE ELSE 0 END AS gx,
   CASE WHEN team_id = 'A' THEN 1 - video % 3 ELSE video % 3 - 1 END AS behind FROM h JOIN k USING (video, span)),
 z AS (SELECT *, NOT same AND b_team <> 'unknown' AS lost, sqrt((gx - end_x) * (gx - end_x) + (34 - end_y) * (34 - end_y)) AS before_, sqrt((gx - bx) * (gx - bx) + (34 - by_) * (34 - by_)) AS after_,
   CASE WHEN behind > 0 THEN 105.0::DOUBLE ELSE 0 END AS ox FROM q),
 zz AS (SELECT *, sqrt((ox - end_x) * (ox - end_x) + (34 - end_y) * (34 - end_y)) AS away, sqrt((ox - bx) * (ox - bx) + (34 - by_) * (34 - by_)) AS far,
   lost AND direction <> 0 AND before_ <= 35 AND after_ < before_ AND d >= 3 AS shot FROM z)"""
_A = "video, '{}' AS event_type, end_frame AS frame_idx, team_id, track_id, b_track AS related_track_id, round(sure * {}::DOUBLE, 6) AS confidence, round(end_x, 6) AS start_x, round(by_, 6) AS end_y, round(d, 2) AS distance, round(gap, 3) AS duration FROM zz WHERE {}"
_B = "video, '{}', b_frame, b_team, b_track, track_id, round(sure * {}::DOUBLE, 6), round(bx, 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM zz WHERE {}"
_CROSS = """same AND d >= 3 AND direction <> 0 AND least(end_y, 68 - end_y) <= 18 AND CASE WHEN direction > 0 THEN end_x > 70 ELSE end_x < 35 END
  AND by_ BETWEEN 13.84 AND 54.16 AND CASE WHEN direction > 0 THEN bx BETWEEN 88.5 AND 105 ELSE bx BETWEEN 0 AND 16.5 END"""
_KINDS = [
    (_A, "pass", 1, "same AND d >= 3"), (_A, "pass_successful", 1, "same AND d >= 3"), (_A, "pass_long", 1, "same AND d >= 25"), (_A, "pass_progressive", 1, "same AND d >= 3 AND direction <> 0 AND gain >= 10"),
    (_A, "pass_back", 1, "same AND d >= 3 AND direction <> 0 AND gain <= -5"), (_A, "cross", 0.85, _CROSS), (_A, "turnover", 1, "lost"), (_A, "pass_failed", 1, "lost AND d >= 3 AND gap <= 1.2"),
    (_B, "interception", 1, "lost AND d >= 3 AND gap <= 1.2"), (_B, "recovery", 0.9, "lost AND NOT (d >= 3 AND gap <= 1.2)"), (_A, "shot", 0.7, "shot"),
    (_A, "shot_on_target", 0.6, "shot AND abs(by_ - 34) <= 4"), (_A, "goal_candidate", 0.4, "shot AND abs(by_ - 34) <= 4 AND after_ < 3"),
    (_A, "clearance", 0.75, "lost AND direction <> 0 AND NOT shot AND behind <> 0 AND away < 25 AND far > away + 8"),
]


@query(HANDOVERS + " UNION ALL ".join(f" SELECT {shape.format(name, factor, when)}" for shape, name, factor, when in _KINDS))
def passes_and_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes by kind, turnovers, interceptions, recoveries, shots, clearances."""
    return _shown(match_events.pass_and_turnover(_spans(spark, sf_dir), _ball(spark, sf_dir), _directions(spark, sf_dir)))


@query(SPANS + """, n AS (SELECT *, (SELECT min(c.span) FROM s c WHERE c.video = s.video AND c.span > s.span AND c.state = 'controlled') AS next_span FROM s)
 SELECT video, 'ball_out' AS event_type, start_frame AS frame_idx, team_id, track_id, round(confidence, 6) AS confidence FROM n WHERE state = 'out_of_play'
 UNION ALL SELECT n.video, 'restart', c.start_frame, c.team_id, c.track_id, round(c.confidence * 0.7, 6) FROM n JOIN s c ON c.video = n.video AND c.span = n.next_span WHERE n.state = 'out_of_play'
 UNION ALL SELECT video, 'loose_ball', start_frame, team_id, track_id, round(confidence, 6) FROM n WHERE state = 'loose_ball' AND duration >= 0.4
 UNION ALL SELECT video, 'contested_possession', start_frame, team_id, track_id, round(confidence, 6) FROM n WHERE state = 'contested' AND duration >= 0.3""")
def dead_and_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balls out, restarts, loose balls and contests."""
    out = match_events.dead_and_contested(_spans(spark, sf_dir))
    return out.select("video", "event_type", "frame_idx", "team_id", "track_id", r("confidence").alias("confidence"))


@query(FRAMES + """, w AS (SELECT video, f AS from_frame, least(f + 6, max(f) OVER (PARTITION BY video)) AS to_frame FROM fr QUALIFY f % 3 = 0)
 SELECT w.video, from_frame, to_frame, round(avg(CASE WHEN ball_state <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
  CASE WHEN count_if(ball_state = 'observed') * 2 > count(*) THEN 'observed' WHEN count_if(ball_state <> 'unknown') > 0 THEN 'interpolated' ELSE 'unknown' END AS ball_state
 FROM w JOIN fr ON fr.video = w.video AND fr.f BETWEEN from_frame AND to_frame GROUP BY 1, 2, 3""")
def event_ball_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an event's frames with a known ball, and the dominant state."""
    f = _frames(spark, sf_dir)
    last = F.max("f").over(Window.partitionBy("video"))
    windows = f.select("video", F.col("f").alias("from_frame"), F.least(F.col("f") + 6, last).alias("to_frame")).where("from_frame % 3 = 0")
    return match_events.coverage(windows, _ball(spark, sf_dir)).withColumn("coverage", r("coverage"))


LADDER = FRAMES + """, g AS (SELECT *, id % 11 AS track_id, CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'unknown' END AS team_id, CASE id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS contest_team,
   CASE WHEN id % 17 <> 0 THEN CAST(id % 50 AS DOUBLE) / 40 * CASE WHEN id % 23 = 0 THEN 8 ELSE 1 END END AS nearest, CAST(id % 7 AS DOUBLE) / 10 AS more,
   CASE WHEN id % 6 <> 0 THEN CAST(id % 90 AS DOUBLE) / 12 END AS speed, id % 13 = 0 AS sustained_out, id % 4 <> 0 AS plausible, CAST(id % 10 AS DOUBLE) / 10 AS calibration,
   CASE WHEN id % 2 = 0 THEN id % 11 END AS previous_owner, CAST(id % 15 AS DOUBLE) / 10 AS held_for FROM fr),
 m AS (SELECT *, CASE WHEN id % 19 <> 0 THEN nearest + more END AS contest FROM g),
 l AS (SELECT *, CASE WHEN ball_state = 'unknown' THEN 1 WHEN sustained_out AND plausible AND calibration >= 0.45 THEN 2 WHEN nearest IS NULL THEN 3 WHEN speed > 6 THEN 4 WHEN nearest > 4 THEN 5
   WHEN nearest <= 0.6::DOUBLE AND contest <= 0.6::DOUBLE AND team_id <> 'unknown' AND team_id <> contest_team AND contest - nearest < 0.3::DOUBLE THEN 6 WHEN nearest <= 0.6::DOUBLE THEN 7 ELSE 8 END AS rule,
   (0.35::DOUBLE * greatest(0, least(1, 1 - nearest / 0.6::DOUBLE)) + 0.2::DOUBLE * coalesce(greatest(0, least(1, (contest - nearest) / 2)), 1) + 0.2::DOUBLE * coalesce(greatest(0, least(1, 1 - speed / 6)), 1)
    + 0.25::DOUBLE * greatest(0, least(1, held_for))) * CASE WHEN track_id = previous_owner THEN 1 ELSE 0.6::DOUBLE END * CASE WHEN ball_state = 'interpolated' THEN 0.6::DOUBLE ELSE 1 END AS control FROM m)"""


@query(LADDER + """ SELECT video, f, CASE WHEN rule = 1 THEN 'unknown' WHEN rule = 2 THEN 'out_of_play' WHEN rule = 6 THEN 'contested' WHEN rule = 7 THEN 'controlled' ELSE 'loose_ball' END AS state,
  CASE WHEN rule = 7 THEN track_id END AS holder, CASE WHEN rule = 7 THEN team_id WHEN rule = 6 THEN 'contested' ELSE 'unknown' END AS holder_team,
  round(CASE rule WHEN 1 THEN 0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 WHEN 4 THEN 0.55 WHEN 5 THEN greatest(0.3, least(0.8, nearest / 8)) WHEN 6 THEN 0.5 WHEN 7 THEN greatest(0, least(1, control)) ELSE 0.45 END, 6) AS confidence
 FROM l""")
def possession_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every frame by the ordered rules, with control confidence."""
    i = F.col("id")
    d = lambda a, b: (i % a).cast("double") / b
    f = _frames(spark, sf_dir).select(
        "video", "f", "ball_state", (i % 11).alias("track_id"), F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("unknown").alias("team_id"), F.when(i % 2 == 0, "A").otherwise("B").alias("contest_team"),
        F.when(i % 17 != 0, d(50, 40) * F.when(i % 23 == 0, 8).otherwise(1)).alias("nearest"), F.when(i % 19 != 0, d(7, 10)).alias("more"), F.when(i % 6 != 0, d(90, 12)).alias("speed"),
        (i % 13 == 0).alias("sustained_out"), (i % 4 != 0).alias("plausible"), d(10, 10).alias("calibration"), F.when(i % 2 == 0, i % 11).alias("previous_owner"), d(15, 10).alias("held_for"),
    )
    out = possession.decide(f.withColumn("contest", F.col("nearest") + F.col("more")))
    return out.select("video", "f", "state", "holder", "holder_team", r("confidence").alias("confidence"))


MOTION = FRAMES + f""", tr AS (SELECT *, f * 0.5::DOUBLE AS t, CAST(id * 37 % 1050 AS DOUBLE) / 10 AS px, CAST(id * 53 % 680 AS DOUBLE) / 10 AS py, CAST(id % 140 AS DOUBLE) / 10 AS v,
   CAST(sum(CASE WHEN id % 29 = 0 THEN 1 ELSE 0 END) OVER {W} AS BIGINT) AS segment FROM fr),
 st AS (SELECT *, lead(t) OVER sg AS end_t, (v + lead(v) OVER sg) / 2 AS s0, sqrt((lead(px) OVER sg - px) * (lead(px) OVER sg - px) + (lead(py) OVER sg - py) * (lead(py) OVER sg - py)) AS d0
   FROM tr WINDOW sg AS (PARTITION BY video, segment ORDER BY f)),
 iv AS (SELECT video, segment, t AS start_t, end_t, s0 > 12 AS rejected, CASE WHEN s0 <= 12 THEN s0 END AS speed, CASE WHEN s0 <= 12 THEN d0 END AS step FROM st WHERE end_t IS NOT NULL),
 ac AS (SELECT *, (speed - lag(speed) OVER (PARTITION BY video, segment ORDER BY start_t)) / greatest(end_t - start_t, 1e-6) AS a0 FROM iv),
 iw AS (SELECT video, segment, start_t, end_t, speed, step, CASE WHEN abs(a0) <= 8 THEN a0 END AS acceleration, rejected FROM ac)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    part = F.sum(F.when(i % 29 == 0, 1).otherwise(0)).over(Window.partitionBy("video").orderBy("f"))
    t = _frames(spark, sf_dir).select(
        "video", part.alias("segment"), "f", (F.col("f") * F.lit(0.5)).cast("double").alias("t"), ((i * 37 % 1050).cast("double") / 10).alias("px"), ((i * 53 % 680).cast("double") / 10).alias("py"),
        ((i % 140).cast("double") / 10).alias("v"),
    )
    return motion.intervals(t, ["video", "segment"], ["f"], "t", "px", "py", "v")


@query(MOTION + " SELECT video, segment, start_t, end_t, round(speed, 6) AS speed, round(step, 6) AS step, round(acceleration, 6) AS acceleration, rejected FROM iw")
def motion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, step and acceleration between samples, impossible ones unknown."""
    out = _steps(spark, sf_dir)
    return out.select("video", "segment", "start_t", "end_t", *(r(c).alias(c) for c in ("speed", "step", "acceleration")), "rejected")


@query(MOTION + """, fast AS (SELECT *, coalesce(speed >= 7, false) AS up FROM iw), edge AS (SELECT *, up <> coalesce(lag(up) OVER (PARTITION BY video, segment ORDER BY start_t), false) AS turn FROM fast),
 runs AS (SELECT *, sum(turn::INT) OVER (PARTITION BY video, segment ORDER BY start_t) AS run FROM edge),
 sr AS (SELECT video, segment, run, sum(step) AS d FROM runs WHERE up GROUP BY 1, 2, 3 HAVING max(end_t) - min(start_t) >= 0.7),
 sprint AS (SELECT video, count(*) AS n_sprints, sum(d) AS sprint_distance FROM sr GROUP BY 1),
 whole AS (SELECT video, count(*) AS n_rows, count(x) AS n_usable, (max(f) - min(f)) * 0.5::DOUBLE AS duration FROM fr GROUP BY 1),
 agg AS (SELECT video, sum(step) AS distance, sum(step) FILTER (speed < 2) AS walking_m, sum(step) FILTER (speed >= 2 AND speed < 4) AS jogging_m, sum(step) FILTER (speed >= 4 AND speed < 5.5) AS running_m,
   sum(step) FILTER (speed >= 5.5 AND speed < 7) AS high_speed_m, sum(step) FILTER (speed >= 7) AS sprinting_m, avg(speed) AS mean_speed,
   CASE WHEN count(speed) > 10 THEN quantile_cont(speed, 0.99) ELSE max(speed) END AS top_speed, count_if(acceleration > 2) AS n_accelerations, count_if(acceleration < -2) AS n_decelerations, count_if(rejected) AS n_rejected FROM iw GROUP BY 1)
 SELECT video, n_rows, n_usable, duration, n_accelerations, n_decelerations, n_rejected, coalesce(n_sprints, 0) AS n_sprints, round(coalesce(sprint_distance, 0), 4) AS sprint_distance, round(distance, 4) AS distance,
  round(coalesce(walking_m, 0), 4) AS walking_m, round(coalesce(jogging_m, 0), 4) AS jogging_m, round(coalesce(running_m, 0), 4) AS running_m, round(coalesce(high_speed_m, 0), 4) AS high_speed_m,
  round(coalesce(sprinting_m, 0), 4) AS sprinting_m, round(mean_speed, 8) AS mean_speed, round(top_speed, 8) AS top_speed, round(n_usable / n_rows, 6) AS coverage,
  round(n_usable / n_rows * least(1, duration / 5), 6) AS confidence
 FROM whole JOIN agg USING (video) LEFT JOIN sprint USING (video)""")
def motion_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, speed zones, top speed, efforts and sprints of every track."""
    tracks = _frames(spark, sf_dir).groupBy("video").agg(F.count("*").alias("n_rows"), F.count("x").alias("n_usable"), ((F.max("f") - F.min("f")) * F.lit(0.5)).cast("double").alias("duration"))
    out = motion.profiles(tracks, _steps(spark, sf_dir), ["video"], ["video", "segment"])
    fine = {"sprint_distance", "distance", *(f"{z[0]}_m" for z in motion.ZONES)}
    return out.select(*(r(c, 4).alias(c) if c in fine else r(c).alias(c) if c in ("coverage", "confidence") else r(c, 8).alias(c) if c.endswith("_speed") else c for c in out.columns))


@query()
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed places and speeds; tested against the posterior mean of the same Gaussian model."""
    t = _frames(spark, sf_dir).where("x is not null").select("video", F.col("f").cast("double").alias("t"), "x", "y")
    return motion.smooth_tracks(t, ["video"], "t", "x", "y").select("video", "t", r("smooth_x").alias("smooth_x"), r("smooth_y").alias("smooth_y"), r("speed").alias("speed"))


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True and found boxes: found ones are moved, renumbered in parts of a sequence, and some are left out."""
    b = boxes(spark, sf_dir).select((F.col("frame") % 200).alias("sequence"), "frame", "id", "x1", "y1", "x2", "y2", "part")
    moved = b.where("part % 7 <> 0").select("sequence", "frame", F.when(F.col("frame") % 3 == 0, F.col("id") % 4 + 10).otherwise(F.col("id")).alias("id"), F.col("x1") + F.col("part") % 5, "y1", F.col("x2") + F.col("part") % 5, "y2", "part")
    moved = moved.toDF(*b.columns).groupBy("sequence", "frame", "id").agg(*(F.max_by(c, "part").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return b.drop("part"), moved


@query()
def tracking_hota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HOTA, DetA and AssA per sequence; tested against a plain version."""
    out = scoring.hota(*_two_sides(spark, sf_dir), ["sequence"], "frame")
    return out.select("sequence", *(r(c).alias(c) for c in ("hota", "det_a", "ass_a")))


@query()
def tracking_idf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity F1 per sequence; tested against all pairings."""
    return scoring.identity_f1(*_two_sides(spark, sf_dir), ["sequence"], "frame").withColumn("idf1", r("idf1"))


@query()
def tracking_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOTA, MOTP, switches and fragments per sequence; tested on scripted sequences."""
    out = scoring.clear_scores(*_two_sides(spark, sf_dir), ["sequence"], "frame")
    return out.withColumn("mota", r("mota")).withColumn("motp", r("motp"))


@query()
def event_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event precision, recall, F1 and time errors by type at several tolerances; tested against all assignments."""
    e = states(spark, sf_dir)
    a = e.where("id % 2 = 0").select(F.col("state").alias("kind"), "id", "t")
    b = e.where("id % 2 = 1").select(F.col("state").alias("kind"), "id", "t")
    return scoring.event_scores(a, b, ["kind"], "t", [3600.0, 14400.0])


@query(""" SELECT o.o_orderkey AS id, coalesce(CASE WHEN c.c_custkey % 2 = 0 THEN c.c_mktsegment END, o.o_orderpriority) AS role, CASE WHEN c.c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS sure,
  o.o_orderstatus AS status, coalesce(c.c_custkey % 2 = 0, false) AS corrected FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey < 5""")
def merged_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by track merged into rows, their confidence set to 1."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("role"), F.lit(0.5).alias("sure"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("role"))
    return edits.apply_overrides(rows, new, ["key"], {"role": "sure"}).drop("key")


@query(""" SELECT id, action, concat_ws(',', CASE WHEN action IS NULL THEN 'action' END, CASE WHEN action <> 'add_missed' AND event_id IS NULL THEN 'event_id' END,
   CASE WHEN action = 'add_missed' AND v < 20 THEN 'corrected_start_s' END) AS errors
 FROM (SELECT id, v, CASE state WHEN 'view' THEN 'add_missed' WHEN 'error' THEN NULL ELSE state END AS action, CASE WHEN id % 4 <> 0 THEN id END AS event_id FROM ev)""")
def correction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a correction from being appended."""
    e = states(spark, sf_dir)
    action = F.when(F.col("state") == "view", "add_missed").when(F.col("state") != "error", F.col("state"))
    rows = e.select("id", action.alias("action"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("event_id"), F.when(F.col("v") >= 20, F.col("v")).alias("corrected_start_s"))
    return edits.correction_errors(rows).select("id", "action", F.array_join("errors", ",").alias("errors"))


@query(""", v AS (SELECT id // 3 AS e, arg_max(CASE state WHEN 'error' THEN 'reject' ELSE 'relabel' END, id) AS action, max(id) AS last FROM ev GROUP BY 1),
 w AS (SELECT v.e, v.action, CASE WHEN ev.id % 3 = 0 THEN NULL ELSE ev.state END AS new_type FROM v JOIN ev ON ev.id = v.last)
 SELECT ev.id AS event, ev.state AS event_type, w.action, CASE WHEN w.action = 'reject' THEN 'none' ELSE coalesce(w.new_type, ev.state) END AS label,
  sha256(concat_ws('|', ev.id::VARCHAR, CASE WHEN w.action = 'reject' THEN 'none' ELSE coalesce(w.new_type, ev.state) END)) AS fingerprint FROM ev JOIN w ON w.e = ev.id""")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed events with their latest label and a fingerprint."""
    e = states(spark, sf_dir)
    action = F.when(F.col("state") == "error", "reject").otherwise("relabel")
    reviews = e.select(F.floor(F.col("id") / 3).alias("event"), action.alias("action"), F.when(F.col("id") % 3 != 0, F.col("state")).alias("corrected_type"), F.col("id").alias("revision"))
    return edits.training_examples(e.select(F.col("id").alias("event"), F.col("state").alias("event_type")), reviews, ["event"])


LABELS = """, lb AS (SELECT id, CASE id % 4 WHEN 0 THEN 'visible' WHEN 1 THEN 'not_visible' WHEN 2 THEN 'outside_frame' ELSE 'ambiguous' END AS vis, CASE WHEN id % 3 <> 0 THEN CAST(id % 130 AS DOUBLE) END AS cx,
   CASE WHEN id % 5 <> 0 THEN CAST(id % 70 AS DOUBLE) END AS cy, CASE WHEN id % 6 = 0 THEN CAST(id % 90 AS DOUBLE) END AS radius, CASE WHEN id % 7 = 0 THEN 1.0 END AS x1, CAST(id % 9 AS DOUBLE) AS x2, id % 11 AS y2,
   CASE WHEN id % 2 = 0 THEN 'blur' END AS reason, CAST(id % 12 AS DOUBLE) / 10 AS sure FROM ev)"""
_LABEL_SQL = {
    "visible_without_centre": "vis = 'visible' AND (cx IS NULL OR cy IS NULL)", "centre_without_ball": "vis IN ('outside_frame', 'not_visible') AND cx IS NOT NULL AND cy IS NOT NULL",
    "x_outside": "cx IS NOT NULL AND cy IS NOT NULL AND cx > 120", "y_outside": "cx IS NOT NULL AND cy IS NOT NULL AND cy > 60", "radius_without_ball": "radius IS NOT NULL AND vis <> 'visible'",
    "radius_too_small": "radius < 1", "radius_too_large": "radius > 60", "empty_box": "x1 IS NOT NULL AND (x2 <= x1 OR y2 <= 1)", "box_without_ball": "x1 IS NOT NULL AND vis <> 'visible'",
    "ambiguous_without_reason": "vis = 'ambiguous' AND reason IS NULL", "confidence_out_of_range": "sure > 1",
}


@query(LABELS + " UNION ALL ".join(f" SELECT '{n}' AS rule, count(*) AS n_rows, count_if({c}) AS n_broken FROM lb" for n, c in _LABEL_SQL.items()))
def label_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ball labels break each integrity rule."""
    i = F.col("id")
    d = lambda n: (i % n).cast("double")
    rows = states(spark, sf_dir).select(
        F.element_at(F.array(*map(F.lit, ("visible", "not_visible", "outside_frame", "ambiguous"))), (i % 4 + 1).cast("int")).alias("visibility"), F.when(i % 3 != 0, d(130)).alias("centre_x"),
        F.when(i % 5 != 0, d(70)).alias("centre_y"), F.lit(120).alias("width"), F.lit(60).alias("height"), F.when(i % 6 == 0, d(90)).alias("radius"), F.when(i % 7 == 0, 1.0).alias("x1"), F.lit(1.0).alias("y1"),
        d(9).alias("x2"), d(11).alias("y2"), F.when(i % 2 == 0, "blur").alias("reason"), (d(12) / 10).alias("sure"),
    )
    return edits.broken_rules(rows, edits.label_rules())


@query(""", b AS (SELECT *, id % 5 AS k, count(*) OVER (PARTITION BY frame, id % 5) AS same, x2 - part % 60 AS xx FROM bx)
 SELECT 'missing_id' AS rule, count(*) AS n_rows, count_if(k = 4) AS n_broken FROM b UNION ALL SELECT 'duplicate_id', count(*), count_if(same > 1) FROM b
 UNION ALL SELECT 'degenerate', count(*), count_if(xx <= x1 OR y2 <= y1) FROM b UNION ALL SELECT 'aspect', count(*), count_if(xx > x1 AND y2 > y1 AND NOT ((xx - x1) / (y2 - y1) BETWEEN 0.15::DOUBLE AND 3)) FROM b""")
def truth_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, repeated and degenerate true boxes."""
    b = boxes(spark, sf_dir).withColumn("k", F.col("id") % 5).withColumn("x2", F.col("x2") - F.col("part") % 60)
    b = b.withColumn("same", F.count("*").over(Window.partitionBy("frame", "k"))).withColumn("id", F.when(F.col("k") != 4, F.col("k")))
    return edits.broken_rules(b, edits.box_rules())
