"""From observations to events on one chain of canonical tables: game state, context, possession, spans, events, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import game_state, match_events, profiles
from touchline.operators.staging import materialise
from touchline.plans.registry import query
from touchline.plans.tracking import _calibration, _observations
from touchline.sources.tables import states

KEY = ["video_id", "frame_idx"]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Observations, labels, ball, calibration and frames: tracklets of the event table, a ball near one of them, 25 frames a second."""
    f, t = F.col("frame_idx"), F.col("track_id")
    o = _observations(spark, sf_dir).withColumnRenamed("frame", "frame_idx").withColumn("video_id", F.concat(F.lit("v"), "video"))
    people = o.select(*KEY, "track_id", *(F.col(c).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")), F.lit(0.8).alias("det_confidence"), F.lit(0.7).alias("track_confidence"), "interpolated")
    e = states(spark, sf_dir)
    team = F.when(F.col("u") % 7 == 0, "unknown").when(F.col("u") % 2 == 0, "A").otherwise("B")
    labels = e.select(
        F.concat(F.lit("v"), F.col("u") % 40).alias("video_id"), F.col("id").alias("track_id"), F.when(F.col("u") % 5 == 0, "referee").otherwise("player").alias("object_class"), team.alias("team_id"), F.lit(0.9).alias("team_confidence"),
        F.when(F.col("u") % 11 == 0, "goalkeeper").otherwise("outfield").alias("role"), F.lit(None).cast("int").alias("jersey_number"), F.lit(0.0).alias("jersey_confidence"),
    )
    w = Window.partitionBy(*KEY).orderBy("track_id")
    near = people.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    off = (f % 13 * 4).cast("double")
    ball = near.select(*KEY, ((F.col("bbox_x1") + F.col("bbox_x2")) / 2 + off).alias("x"), F.col("bbox_y2").alias("y"), (f % 10 / 10).alias("confidence"), F.when(f % 4 == 0, "interpolated").otherwise("observed").alias("method")).where(f % 9 != 0)
    frames = people.select("video_id", F.explode(F.array(f, f + 1)).alias("frame_idx")).distinct().select(*KEY, (f * 0.04).alias("timestamp_s"))
    solves = _calibration(o.withColumnRenamed("frame_idx", "frame")).withColumnRenamed("frame", "frame_idx").withColumn("video_id", F.concat(F.lit("v"), "video"))
    solves = solves.select(*KEY, "homography", "valid", "confidence", F.when(f % 17 == 0, "replay").otherwise("live").alias("segment_kind"), F.lit(False).alias("smoothed"))
    return {"observations": people, "labels": labels, "ball": ball, "calibration": solves, "frames": frames}


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = _tables(spark, sf_dir)
    state = materialise(game_state.assemble(t["observations"], t["labels"], t["ball"], t["calibration"], t["frames"]), "game-state")
    return state, materialise(game_state.frame_table(t["frames"], state, t["calibration"]), "frames")


STATE = """, o AS (SELECT 'v' || (u % 40) AS video_id, id AS track_id, t // 60 + k AS f, u, CASE WHEN u % 5 = 0 THEN 'referee' ELSE 'player' END AS cls, k = 1 AS interpolated, u * 53 % 1200 + id % 11 + k * (id % 5 - 2) AS cx,
   u * 31 % 700 + id % 7 + CAST(60 + u % 4 * 15 + id % 5 AS DOUBLE) / 2 AS foot FROM (SELECT *, unnest(range(3 + id % 5)) AS k FROM ev)
), cl AS (SELECT DISTINCT video_id, f, f % 5 <> 0 AS valid, f % 8 / 10 + 0.2 AS sure, CASE WHEN f % 17 = 0 THEN 'replay' ELSE 'live' END AS kind FROM o
), bl AS (SELECT video_id, f, cx + f % 13 * 4 AS cx, foot, f % 4 = 0 AS interpolated, f % 10 / 10 AS conf FROM o WHERE f % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY video_id, f ORDER BY track_id) = 1
), al AS (SELECT video_id, f, cls, track_id, CASE WHEN u % 7 = 0 THEN 'unknown' WHEN u % 2 = 0 THEN 'A' ELSE 'B' END AS team, interpolated, cx, foot FROM o UNION ALL SELECT video_id, f, 'ball', NULL, 'none', interpolated, cx, foot FROM bl
), gs AS (SELECT al.*, CASE WHEN valid THEN 0.08::DOUBLE * cx + 1 END AS px, CASE WHEN valid THEN 0.08::DOUBLE * foot + 2 END AS py, CASE WHEN interpolated THEN 'interpolated' WHEN NOT valid THEN 'no_calibration' WHEN kind = 'replay' THEN 'non_live'
   WHEN sure < 0.5 THEN 'low_calibration' ELSE 'valid' END AS status FROM al JOIN cl USING (video_id, f)
), fr AS (SELECT DISTINCT video_id, unnest([f, f + 1]) AS f FROM o)"""


@query(STATE + " SELECT video_id, f AS frame_idx, cls AS object_class, track_id, team AS team_id, interpolated, round(px, 6) AS pitch_x, round(py, 6) AS pitch_y, status AS validation_status FROM gs")
def game_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and the ball of every frame, on the pitch where a solve allows it, with the reason where it doesn't."""
    state, _ = _state(spark, sf_dir)
    return state.select(*KEY, "object_class", "track_id", "team_id", "interpolated", F.round("pitch_x", 6).alias("pitch_x"), F.round("pitch_y", 6).alias("pitch_y"), "validation_status")


@query(STATE + """, fc AS (SELECT fr.video_id, fr.f, count(*) FILTER (cls <> 'ball') AS n, count(*) FILTER (cls = 'ball') AS b, coalesce(bool_or(cls = 'ball' AND NOT interpolated), false) AS seen FROM fr LEFT JOIN gs USING (video_id, f) GROUP BY ALL)
 SELECT fc.video_id, fc.f AS frame_idx, n AS n_persons, b AS n_ball_rows, seen AS ball_observed, round(coalesce(sure, 0), 6) AS calibration_confidence, coalesce(valid, false) AS calibration_valid, coalesce(kind, 'unknown') AS segment_kind
 FROM fc LEFT JOIN cl USING (video_id, f)""")
def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every processed frame, empty ones too, with what was found in it and how it was calibrated."""
    _, frames = _state(spark, sf_dir)
    return frames.select(*KEY, "n_persons", "n_ball_rows", "ball_observed", F.round("calibration_confidence", 6).alias("calibration_confidence"), "calibration_valid", "segment_kind")


@query(STATE + """, bf AS (SELECT fr.video_id, fr.f, CASE WHEN px IS NULL OR py IS NULL THEN 'unknown' WHEN interpolated THEN 'interpolated' ELSE 'observed' END AS bs FROM fr LEFT JOIN (SELECT * FROM gs WHERE cls = 'ball') USING (video_id, f)),
 pc AS (SELECT video_id, count(*) AS n, count(*) FILTER (status = 'valid' AND px IS NOT NULL) AS ok FROM gs WHERE cls <> 'ball' GROUP BY 1)
 SELECT video_id, count(*) AS frames, round((max(f) - min(f)) * 0.04::DOUBLE, 4) AS duration_s, any_value(n) AS player_rows, any_value(ok) AS valid_player_rows, round(avg((bs <> 'unknown')::INT), 6) AS ball_coverage,
  round(avg((bs = 'observed')::INT), 6) AS ball_observed_coverage FROM bf JOIN pc USING (video_id) GROUP BY 1""")
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each video offers to analytics: frames, usable rows and how often the ball is known."""
    out = game_state.context_summary(*_state(spark, sf_dir))
    return out.select("video_id", "frames", F.round("duration_s", 4).alias("duration_s"), "player_rows", "valid_player_rows", *(F.round(c, 6).alias(c) for c in ("ball_coverage", "ball_observed_coverage")))


@query(STATE + """, st AS (SELECT video_id, status, count(*) AS n FROM gs GROUP BY ALL), q AS (SELECT video_id, count(*) AS rows, count(DISTINCT f) AS frames, count(*) FILTER (cls <> 'ball') AS p, count(px) AS on_pitch, count(*) FILTER (interpolated) AS i FROM gs GROUP BY 1)
 SELECT video_id, rows, frames, p AS person_rows, rows - p AS ball_rows, round(on_pitch / rows, 6) AS pitch_ratio, round(i / rows, 6) AS interpolated_ratio, round(p / frames, 6) AS people_per_frame,
  (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM st WHERE st.video_id = q.video_id) AS statuses FROM q""")
def game_state_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts, shares and validation statuses of each video's game state."""
    out = game_state.quality_report(_state(spark, sf_dir)[0])
    text = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("video_id", "rows", "frames", "person_rows", "ball_rows", *(F.round(c, 6).alias(c) for c in ("pitch_ratio", "interpolated_ratio", "people_per_frame")), text.alias("statuses"))


@query()
def possession_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has the ball in every frame, from the game state; tested against a plain fold."""
    return game_state.possession_by_frame(*_state(spark, sf_dir))


@query()
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possession spans from the game state; tested against a plain fold."""
    return game_state.possession_spans(game_state.possession_by_frame(*_state(spark, sf_dir)))


def _events(state: DataFrame, frames: DataFrame, spans: DataFrame) -> DataFrame:
    ball = game_state.ball_by_frame(state, frames).select(F.col("video_id").alias("video"), "frame_idx", F.col("ball_state").alias("state"))
    videos = frames.select(F.col("video_id").alias("video")).distinct()
    way = F.when(F.crc32(F.col("video").cast("binary")) % 2 == 0, 1).otherwise(-1)
    directions = videos.select("video", F.lit("A").alias("team_id"), way.alias("direction")).unionByName(videos.select("video", F.lit("B").alias("team_id"), (-way).alias("direction")))
    return match_events.detect(spans, ball, directions)


@query()
def match_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every family from the game state: ladder, carry, spans, detection on one chain; its parts are tested."""
    state, frames = _state(spark, sf_dir)
    spans = materialise(game_state.possession_spans(game_state.possession_by_frame(state, frames)), "spans")
    return _events(state, frames, spans)


def _chain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Everything that profiles and maps are read from."""
    state, frames = _state(spark, sf_dir)
    spans = materialise(game_state.possession_spans(game_state.possession_by_frame(state, frames)), "spans")
    out = {"state": state, "frames": frames, "spans": spans, "labels": _tables(spark, sf_dir)["labels"], "ball": game_state.ball_by_frame(state, frames)}
    out |= {"events": materialise(_events(state, frames, spans), "events"), "physical": materialise(game_state.physical_profiles(state), "physical")}
    out["coverage"] = materialise(profiles.track_coverage(state, out["ball"], out["physical"], out["labels"]), "coverage")
    return out


@query()
def player_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every tracked person with its coverage and confidence; tested against plain counts."""
    m = _chain(spark, sf_dir)
    return profiles.player_metrics(m["coverage"], m["physical"], m["events"], m["spans"])


@query()
def keeper_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goalkeepers faced and did with the ball; tested against plain counts."""
    m = _chain(spark, sf_dir)
    return profiles.keeper_metrics(profiles.player_metrics(m["coverage"], m["physical"], m["events"], m["spans"]), m["labels"], m["events"])


@query()
def team_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a team's tracks and its pass accuracy; tested against plain counts."""
    m = _chain(spark, sf_dir)
    return profiles.team_metrics(profiles.player_metrics(m["coverage"], m["physical"], m["events"], m["spans"]), m["labels"], m["coverage"])


@query()
def team_heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine kinds of heatmap of each team while it holds the ball; tested against plain counts."""
    m = _chain(spark, sf_dir)
    points = profiles.heatmap_points(m["state"], m["frames"], m["ball"], m["events"], m["spans"], game_state.track_speeds(m["state"]).select("video_id", "track_id", "frame_idx", "speed"), "in_possession")
    return profiles.heatmap_grids(points, ["video_id", "kind", "team_id"])


@query()
def physical_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, speeds and sprints of every track from the game state: segments, smoothing, intervals, profile on one chain; tested against a plain version."""
    return game_state.physical_profiles(_state(spark, sf_dir)[0])
