"""The canonical game state: every stage's rows joined into one table, and possession read off it frame by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators import motion, possession, sequence
from touchline.operators.ordered import around
from touchline.operators.staging import materialise, shuffled

#: Metres around the pitch beyond which a projection is broken, and the extrapolation beyond which a row says so. Fixed values.
FAR, MAX_RISK, MIN_CALIBRATION = 60.0, 0.35, 0.5
#: Statuses of rows that physical measures may use.
PHYSICAL = ("valid",)


def support_region(points: DataFrame, by: list[str], width: float, height: float, expand: float = 0.35) -> DataFrame:
    """(by, region): the image box that a frame's three landmarks or more span, wider by `expand` on every side, cut at the picture.

    points: by + x, y. Frames with fewer landmarks have no region.
    """
    box = points.where("x is not null and y is not null").groupBy(*by).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n")).where("n >= 3")
    sx, sy = expand * F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), expand * F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    sides = [F.greatest(F.lit(0.0), F.col("x1") - sx), F.greatest(F.lit(0.0), F.col("y1") - sy), F.least(F.lit(float(width)), F.col("x2") + sx), F.least(F.lit(float(height)), F.col("y2") + sy)]
    return box.select(*by, F.struct(*(s.alias(n) for s, n in zip(sides, ("x1", "y1", "x2", "y2"), strict=True))).alias("region"))


def extrapolation_risk(x: Column, y: Column, region: Column) -> Column:
    """0 inside the region to 1 a region's size outside; 0 where there is none."""
    beyond = lambda v, lo, hi: F.greatest(lo - v, F.lit(0.0), v - hi) / F.greatest(F.lit(1.0), hi - lo)
    return F.when(region.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.hypot(beyond(x, region["x1"], region["x2"]), beyond(y, region["y1"], region["y2"]))))


def assemble(observations: DataFrame, labels: DataFrame, ball: DataFrame, calibration: DataFrame, frames: DataFrame, regions: DataFrame | None = None, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Game-state rows of the frames: every tracked person's and the ball's, on the pitch where the frame's solve allows it.

    All tables have video_id and frame_idx but labels (video_id, track_id, object_class, team_id, team_confidence, role, jersey_number,
    jersey_confidence): observations + track_id, corners bbox_x1 ..., det_confidence, track_confidence, interpolated; ball + x, y,
    confidence, method (as ball_states() says it; unknown ones give no row); calibration + homography, valid, confidence,
    segment_kind; frames + timestamp_s; regions + region. Rows of frames that aren't there are left out. A point that goes to
    infinity or further than 60 m from the pitch has no place. Columns are those of the canonical table `game_state`.
    """
    c = F.col
    key = ["video_id", "frame_idx"]
    person = observations.join(shuffled(labels), ["video_id", "track_id"], "left").select(
        *key, F.coalesce("object_class", F.lit("player")).alias("object_class"), "track_id", F.coalesce("team_id", F.lit("unknown")).alias("team_id"), F.coalesce("role", F.lit("unknown")).alias("role"),
        "jersey_number", F.coalesce("jersey_confidence", F.lit(0.0)).alias("jersey_confidence"), *(f"bbox_{s}" for s in ("x1", "y1", "x2", "y2")), ((c("bbox_x1") + c("bbox_x2")) / 2).alias("image_x"), c("bbox_y2").alias("image_y"),
        c("det_confidence").alias("detection_confidence"), c("track_confidence").alias("tracking_confidence"), F.coalesce("team_confidence", F.lit(0.0)).alias("team_confidence"), "interpolated", F.lit("tracker").alias("source"),
    )
    nothing = lambda t: F.lit(None).cast(t)
    known = ball.where("x is not null and y is not null")
    ball_rows = known.select(
        *key, F.lit("ball").alias("object_class"), nothing("long").alias("track_id"), F.lit("none").alias("team_id"), F.lit("ball").alias("role"), nothing("int").alias("jersey_number"), F.lit(0.0).alias("jersey_confidence"),
        c("x").alias("bbox_x1"), c("y").alias("bbox_y1"), c("x").alias("bbox_x2"), c("y").alias("bbox_y2"), c("x").alias("image_x"), c("y").alias("image_y"),
        F.when(c("method") == "observed", c("confidence")).otherwise(0.0).alias("detection_confidence"), c("confidence").alias("tracking_confidence"), F.lit(0.0).alias("team_confidence"),
        (c("method") != "observed").alias("interpolated"), F.lit("ball_trajectory").alias("source"),
    )
    solve = calibration.select(*key, "homography", "valid", c("confidence").alias("__sure"), "segment_kind")
    rows = shuffled(frames.select(*key, "timestamp_s")).join(person.unionByName(ball_rows), key).join(shuffled(solve), key, "left")
    rows = rows.join(shuffled(regions), key, "left") if regions is not None else rows.withColumn("region", nothing("struct<x1:double,y1:double,x2:double,y2:double>"))
    solved = F.coalesce(c("valid"), F.lit(False)) & c("homography").isNotNull()
    px, py = expr.project([c("homography")[i] for i in range(9)], c("image_x").cast("double"), c("image_y").cast("double"))
    rows = rows.withColumn("__x", F.when(solved, px)).withColumn("__y", F.when(solved, py))
    on = c("__x").between(-FAR, length + FAR) & c("__y").between(-FAR, width + FAR)
    rows = rows.withColumn("pitch_x", F.when(on, c("__x"))).withColumn("pitch_y", F.when(on, c("__y")))
    risk = F.when(c("pitch_x").isNull(), 1.0).otherwise(extrapolation_risk(c("image_x"), c("image_y"), c("region")))
    status = (
        F.when(c("interpolated"), "interpolated").when(~solved, "no_calibration").when(c("segment_kind").isin("replay", "close_up"), "non_live").when(risk > MAX_RISK, "extrapolated")
        .when(c("__sure") < MIN_CALIBRATION, "low_calibration").otherwise("valid")
    )
    return rows.select(
        *key, "timestamp_s", nothing("double").alias("match_clock_s"), "object_class", "track_id", "team_id", "role", "jersey_number", "jersey_confidence", *(f"bbox_{s}" for s in ("x1", "y1", "x2", "y2")), "image_x", "image_y",
        "pitch_x", "pitch_y", (c("pitch_x") / length).alias("pitch_x_norm"), (c("pitch_y") / width).alias("pitch_y_norm"), "detection_confidence", "tracking_confidence", "team_confidence",
        F.coalesce("__sure", F.lit(0.0)).alias("calibration_confidence"), "interpolated", status.alias("validation_status"), F.coalesce("segment_kind", F.lit("unknown")).alias("segment_kind"), "source",
    )


def frame_table(frames: DataFrame, state: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row a processed frame, empty ones too: counts of its game-state rows and how it was calibrated.

    frames: video_id, frame_idx, timestamp_s and perhaps chunk_index; calibration: + valid, confidence, smoothed, segment_kind.
    """
    key = ["video_id", "frame_idx"]
    is_ball = F.col("object_class") == "ball"
    counts = state.groupBy(*key).agg(F.count_if(~is_ball).alias("n_persons"), F.count_if(is_ball).alias("n_ball_rows"), F.bool_or(is_ball & ~F.col("interpolated")).alias("ball_observed"))
    solve = calibration.select(*key, F.col("confidence").alias("calibration_confidence"), F.col("valid").alias("calibration_valid"), F.col("smoothed").alias("calibration_propagated"), "segment_kind")
    rows = frames.join(shuffled(counts), key, "left").join(shuffled(solve), key, "left").na.fill(0, ["n_persons", "n_ball_rows"]).na.fill(0.0, ["calibration_confidence"])
    rows = rows.na.fill(False, ["ball_observed", "calibration_valid", "calibration_propagated"]).na.fill("unknown", ["segment_kind"])
    chunk = F.col("chunk_index") if "chunk_index" in frames.columns else F.lit(None)
    names = ("n_persons", "n_ball_rows", "ball_observed", "calibration_confidence", "calibration_valid", "calibration_propagated", "segment_kind")
    return rows.select(*key, "timestamp_s", *names, chunk.cast("int").alias("chunk_index"))


def quality_report(state: DataFrame) -> DataFrame:
    """(video_id, rows, frames, person_rows, ball_rows, pitch_ratio, interpolated_ratio, people_per_frame, statuses) of a game state."""
    is_ball = F.col("object_class") == "ball"
    counts = state.groupBy("video_id", "validation_status").agg(F.count("*").alias("n")).groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("validation_status", "n")))).alias("statuses"))
    frames = state.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"), F.count_if(is_ball).alias("b"), F.count("pitch_x").alias("p"), F.count_if("interpolated").alias("i"))
    t = frames.groupBy("video_id").agg(F.sum("n").alias("rows"), F.count("*").alias("frames"), F.sum(F.col("n") - F.col("b")).alias("person_rows"), F.sum("b").alias("ball_rows"), F.sum("p").alias("p"), F.sum("i").alias("i"))
    ratio = lambda a, b: F.col(a) / F.col(b)
    return t.join(counts, "video_id").select("video_id", "rows", "frames", "person_rows", "ball_rows", ratio("p", "rows").alias("pitch_ratio"), ratio("i", "rows").alias("interpolated_ratio"), ratio("person_rows", "frames").alias("people_per_frame"), "statuses")


def ball_by_frame(state: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, timestamp_s, x, y, image_x, image_y, ball_state, confidence) of every frame of the frames table.

    A ball without a place on the pitch, or without a row, is unknown, so that shares of frames stay honest; its image place is kept.
    """
    key = ["video_id", "frame_idx"]
    ball = state.where("object_class = 'ball'").groupBy(*key).agg(F.max_by(F.struct("pitch_x", "pitch_y", "image_x", "image_y", "interpolated", "tracking_confidence"), F.struct("tracking_confidence", "image_x", "image_y")).alias("b"))
    rows = frames.select(*key, "timestamp_s").join(shuffled(ball), key, "left")
    d = lambda c: F.col(f"b.{c}").cast("double")
    placed = F.col("b.pitch_x").isNotNull() & F.col("b.pitch_y").isNotNull()
    kind = F.when(~F.coalesce(placed, F.lit(False)), "unknown").when(F.col("b.interpolated"), "interpolated").otherwise("observed")
    return rows.select(*key, "timestamp_s", F.when(placed, d("pitch_x")).alias("x"), F.when(placed, d("pitch_y")).alias("y"), d("image_x").alias("image_x"), d("image_y").alias("image_y"), kind.alias("ball_state"), F.coalesce(d("tracking_confidence"), F.lit(0.0)).alias("confidence"))


def context_summary(state: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frames, duration_s, player_rows, valid_player_rows, ball_coverage, ball_observed_coverage): what a run offers."""
    ball = ball_by_frame(state, frames)
    share = lambda *kinds: F.avg(F.col("ball_state").isin(*kinds).cast("double"))
    whole = ball.groupBy("video_id").agg(F.count("*").alias("frames"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("duration_s"), share("observed", "interpolated").alias("ball_coverage"), share("observed").alias("ball_observed_coverage"))
    usable = F.col("validation_status").isin(*PHYSICAL) & F.col("pitch_x").isNotNull()
    people = state.where("object_class <> 'ball'").groupBy("video_id").agg(F.count("*").alias("player_rows"), F.count_if(usable).alias("valid_player_rows"))
    return whole.join(people, "video_id", "left").na.fill(0, ["player_rows", "valid_player_rows"]).select("video_id", "frames", "duration_s", "player_rows", "valid_player_rows", "ball_coverage", "ball_observed_coverage")


def half_of(time: Column, switches: Column, fps: float) -> Column:
    """2 from the first switch of direction on, else 1; switches is an array of frames, null or empty for none."""
    return F.when(time >= F.array_min(switches) / fps, 2).otherwise(1)


def ball_speeds(state: DataFrame, ball: DataFrame, longest: int = 3, noise: float = 6.0, acceleration: float = 900.0) -> DataFrame:
    """(video_id, frame_idx, speed): the ball's image speed in heights of the frame's players a second.

    A run of frames that have an image place, at most `longest` apart, is smoothed; shorter runs than three and frames without players
    have no speed. A frame without a ball ends a run. The scale is the median height of the frame's tracked people.
    """
    key = ["video_id", "frame_idx"]
    has = F.col("image_x").isNotNull() & F.col("image_y").isNotNull()
    numbered = sequence.number_runs(ball.withColumn("__has", has), ["video_id"], ["frame_idx"], (F.col("__has") != F.lag("__has").over(sequence._w(["video_id"], ["frame_idx"]))) | (F.col("frame_idx") - F.lag("frame_idx").over(sequence._w(["video_id"], ["frame_idx"])) > longest), "__run")
    runs = numbered.where("__has").groupBy("video_id", "__run").agg(F.count("*").alias("__n")).where("__n >= 3")
    held = numbered.where("__has").join(shuffled(runs), ["video_id", "__run"]).select(*key, "__run", "timestamp_s", "image_x", "image_y")
    smooth = motion.smooth_tracks(held, ["video_id", "__run"], "timestamp_s", "image_x", "image_y", noise, acceleration)
    scale = people_heights(state).groupBy(*key).agg(F.median("height").alias("scale"))
    return smooth.join(shuffled(scale.where("scale > 0")), key).select(*key, (F.col("speed") / F.col("scale")).alias("speed"))


def people_heights(state: DataFrame) -> DataFrame:
    """(video_id, frame_idx, track_id, team_id, x, y, height) of tracked people taller than a pixel, in the image."""
    d = lambda c: F.col(c).cast("double")
    rows = state.where("object_class <> 'ball' and track_id is not null").select("video_id", "frame_idx", "track_id", "team_id", d("image_x").alias("x"), d("image_y").alias("y"), (d("bbox_y2") - d("bbox_y1")).alias("height"))
    return rows.where("height > 1")


def possession_by_frame(state: DataFrame, frames: DataFrame, fps: float = 25.0, length: float = 105.0, width: float = 68.0, rules: possession.Rules = possession.Rules(), out_margin: float = 1.5, out_time: float = 0.4) -> DataFrame:
    """Who has the ball in every frame of the frames table, from the game state alone.

    The state of a frame doesn't depend on the frames before, only its confidence does; so frames are decided first, the owner is then
    carried through unknown and contested ones, and the confidence of controlled frames follows. A ball is out if of the next
    known places, within twice out_time, most lie outside the pitch.
    """
    key = ["video_id", "frame_idx"]
    ball = materialise(ball_by_frame(state, frames).join(shuffled(frames.select(*key, F.col("calibration_confidence").cast("double").alias("calibration"))), key), "ball-frames")
    need = max(1, int(out_time * fps))
    off = lambda m: ~(F.col("x").between(-m, length + m) & F.col("y").between(-m, width + m))
    wide = around(ball, ["video_id"], "frame_idx", F.when(F.col("ball_state") != "unknown", off(out_margin) & ~off(rules.implausible_margin)), 0, 2 * need - 1, "ahead")
    first = F.slice("ahead", 1, need)
    outside = F.size(F.filter(first, lambda a: a["item"]))
    sustained = F.coalesce((F.size(first) > 0) & (outside >= F.greatest(F.lit(1), F.floor(0.7 * F.size(first)))), F.lit(False))
    rows = wide.withColumn("sustained_out", sustained).withColumn("plausible", F.coalesce(~off(rules.implausible_margin), F.lit(False))).drop("ahead")
    two = possession.two_nearest(people_heights(state), rows.where("image_x is not null").select(*key, F.col("image_x").alias("x"), F.col("image_y").alias("y")), key)
    rows = rows.join(shuffled(two.drop("x", "y")), key, "left").join(shuffled(ball_speeds(state, ball)), key, "left")
    rows = rows.withColumns({"previous_owner": F.lit(None).cast("long"), "held_for": F.lit(0.0)})
    decided = possession.decide(rows, rules).drop("previous_owner", "held_for")
    carried = sequence.owner_carry(decided, ["video_id"], ["frame_idx"], "state", "holder", "timestamp_s", "controlled", ("loose_ball", "out_of_play"))
    since = F.coalesce(F.col("timestamp_s") - F.col("held_since"), F.lit(0.0))
    held = possession.control_confidence(F.col("nearest"), F.col("contest"), F.col("speed"), F.col("ball_state") == "interpolated", F.coalesce(F.col("track_id") == F.col("previous_owner"), F.lit(False)), since, rules)
    sure = F.when(F.col("state") == "controlled", held).otherwise(F.col("confidence"))
    return carried.select(*key, "timestamp_s", "ball_state", "state", F.col("holder_team").alias("team_id"), F.col("holder").alias("track_id"), sure.alias("confidence"), "x", "y", "nearest", "contest", "speed")


def possession_spans(decided: DataFrame, shortest: float = 0.16) -> DataFrame:
    """Spans of possession_by_frame(), short ones taken up by the span before: the columns that match events are read from.

    (video, span, state, team_id, track_id, start_frame, end_frame, start_t, end_t, duration, confidence, ball_coverage, start_x, start_y,
    end_x, end_y). Confidence and coverage are those of the span before it took others up; places are the ball's at its ends.
    """
    w = sequence._w(["video_id"], ["frame_idx"])
    changed = F.lit(False)
    for c in ("state", "team_id", "track_id"):
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = sequence.number_runs(decided.withColumn("__changed", changed), ["video_id"], ["frame_idx"], F.col("__changed"))
    raw = runs.groupBy("video_id", "run", "state", "team_id", "track_id").agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.min("timestamp_s").alias("start_t"), F.max("timestamp_s").alias("end_t"), F.avg("confidence").alias("confidence"),
        F.avg((F.col("ball_state") != "unknown").cast("double")).alias("ball_coverage"), F.min_by(F.struct("x", "y"), "frame_idx").alias("first"), F.max_by(F.struct("x", "y"), "frame_idx").alias("last"),
    )
    r = sequence._w(["video_id"], ["run"])
    # Times are fractions that doubles round; a span of exactly `shortest` is not short.
    short = (F.col("end_t") - F.col("start_t") < shortest - 1e-9) & (F.col("state") != "unknown") & (F.lag("state").over(r) != "unknown")
    kept = ~F.coalesce(short, F.lit(False))
    marked = raw.withColumn("__kept", kept).withColumn("span", F.sum(kept.cast("long")).over(r))
    own = lambda c: F.max(F.when(F.col("__kept"), F.col(c))).alias(c)
    spans = marked.groupBy(F.col("video_id").alias("video"), "span").agg(
        *(own(c) for c in ("state", "team_id", "track_id", "start_frame", "start_t", "confidence", "ball_coverage", "first")), F.max("end_frame").alias("end_frame"), F.max("end_t").alias("end_t"), F.max_by("last", "run").alias("last")
    )
    return spans.select(
        "video", "span", "state", "team_id", "track_id", "start_frame", "end_frame", "start_t", "end_t", (F.col("end_t") - F.col("start_t")).alias("duration"), "confidence", "ball_coverage",
        F.col("first.x").alias("start_x"), F.col("first.y").alias("start_y"), F.col("last.x").alias("end_x"), F.col("last.y").alias("end_y"),
    )


def track_speeds(state: DataFrame, gap: float = 0.5) -> DataFrame:
    """(video_id, track_id, segment, frame_idx, timestamp_s, smooth_x, smooth_y, speed) of the rows of people that measures may use.

    Usable are valid rows with a place on the pitch. Rows further apart than `gap` seconds start a new segment, which is smoothed
    on its own; segments of fewer than three rows are at rest.
    """
    track = ["video_id", "track_id"]
    d = lambda c: F.col(c).cast("double").alias(c)
    rows = _people(state).where("usable").select(*track, "frame_idx", d("timestamp_s"), d("pitch_x"), d("pitch_y"))
    step = F.col("timestamp_s") - F.lag("timestamp_s").over(sequence._w(track, ["frame_idx"]))
    cut = sequence.number_runs(rows.withColumn("__step", step), track, ["frame_idx"], F.col("__step") > gap, "segment").drop("__step")
    smooth = motion.smooth_tracks(cut, [*track, "segment"], "timestamp_s", "pitch_x", "pitch_y")
    return smooth.select(*track, "segment", "frame_idx", "timestamp_s", "smooth_x", "smooth_y", "speed")


def _people(state: DataFrame) -> DataFrame:
    usable = F.col("validation_status").isin(*PHYSICAL) & F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()
    return state.where("object_class <> 'ball' and track_id is not null").withColumn("usable", usable)


def physical_profiles(state: DataFrame, gap: float = 0.5) -> DataFrame:
    """Distance, speeds and sprints of every tracked person: track_speeds() measured in intervals and summed.

    Segments of one row have no interval. Tracks without a usable row are there with zeros. Coverage is the usable share of a
    track's rows.
    """
    track = ["video_id", "track_id"]
    segment = [*track, "segment"]
    smooth = materialise(track_speeds(state, gap), "speeds")
    steps = materialise(motion.intervals(smooth, segment, ["frame_idx"], "timestamp_s", "smooth_x", "smooth_y", "speed"), "intervals")
    whole = _people(state).groupBy(*track).agg(F.count("*").alias("n_rows"), F.count_if("usable").alias("n_usable"))
    span = smooth.groupBy(*segment).agg((F.max("timestamp_s") - F.min("timestamp_s")).alias("t")).groupBy(*track).agg(F.sum("t").alias("duration"))
    tracks = whole.join(shuffled(span), track, "left").na.fill(0.0, ["duration"])
    return motion.profiles(tracks, steps, track, segment)
