"""Ball fusion and paths, homographies along a video, teams and roles, balanced and spread choices, on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import ball, calibration, observability, splits, teams
from touchline.plans.registry import query
from touchline.sources.tables import states, table

V = ["video"]


def d(c: Column) -> Column:
    return c.cast("double")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as one to three candidates in its half-hour, the frame of one of the videos."""
    i, k, f = F.col("id"), F.col("k"), F.floor(F.col("t") / 1800)
    c = states(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), i % 3)))
    return c.select(
        (F.col("u") % 10).alias("video"), f.cast("long").alias("frame"), (i * 3 + k).alias("id"), d(f % 80 * 9 + i % 12 + k * 13).alias("x"), d(f % 50 * 4 + i % 5 + k * 5).alias("y"), d(5 + i % 7).alias("radius"),
        ((i % 19 + 1 + k) / 25).alias("confidence"),
    )


def _lattice(candidates: DataFrame) -> DataFrame:
    """The frames of each video that have a candidate and those after them, with the camera's moves."""
    f = F.col("frame")
    every = candidates.select("video", F.explode(F.array(f, f + 1)).alias("frame")).distinct()
    shift = lambda m: F.when(f % 7 != 0, d(f % m * 4 - 8))
    hidden = F.when(f % 4 == 0, "likely_occluded").when(f % 4 == 1, "likely_outside_frame")
    return every.select("video", "frame", shift(5).alias("shift_x"), shift(3).alias("shift_y"), F.when(f % 11 != 0, d(f % 10) / 10).alias("camera"), hidden.alias("visibility"))


SEEN = """, cd AS (SELECT u % 10 AS video, t // 1800 AS frame, id * 3 + k AS id, t // 1800 % 80 * 9 + id % 12 + k * 13 AS x, t // 1800 % 50 * 4 + id % 5 + k * 5 AS y, CAST(5 + id % 7 AS DOUBLE) AS radius,
    (id % 19 + 1 + k) / 25 AS confidence FROM (SELECT *, unnest(range(1 + id % 3)) AS k FROM ev)
), lt AS (SELECT *, CASE WHEN frame % 7 <> 0 THEN frame % 5 * 4 - 8 END AS sx, CASE WHEN frame % 7 <> 0 THEN frame % 3 * 4 - 8 END AS sy, CASE WHEN frame % 11 <> 0 THEN frame % 10 / 10 END AS camera
    FROM (SELECT DISTINCT video, unnest([frame, frame + 1]) AS frame FROM cd)
), bs AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY confidence DESC, id) = 1
), jn AS (SELECT lt.*, bs.x, bs.y, bs.radius, bs.confidence, bs.x IS NOT NULL AS has FROM lt LEFT JOIN bs USING (video, frame)
), nb AS (SELECT *, list({'x': x, 'y': y, 'f': frame}) FILTER (has) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS near,
    lag(x) OVER w AS px, lag(y) OVER w AS py, lag(radius) OVER w AS pr, lag(frame) OVER w AS pf, lag(has) OVER w AS ph FROM jn WINDOW w AS (PARTITION BY video ORDER BY frame)
), jd AS (SELECT *, CASE WHEN has THEN len(list_filter(coalesce(near, []), lambda n: sqrt((n.x - x) ** 2 + (n.y - y) ** 2) <= 55)) ELSE 0 END AS support,
    ph AND sx IS NOT NULL AND coalesce(camera, 1) >= 0.35 AND sqrt(sx ** 2 + sy ** 2) >= 6 AS moving FROM nb
), rs AS (SELECT *, list_filter([CASE WHEN NOT (x BETWEEN 0 AND 700 AND y BETWEEN 0 AND 190) THEN 'outside_plausible_region' END,
    CASE WHEN ph AND sqrt((x - px) ** 2 + (y - py) ** 2) / greatest(1, frame - pf) > 90 THEN 'implausible_jump' END,
    CASE WHEN ph AND (radius / pr > 2.2 OR radius / pr < 1 / 2.2) THEN 'size_inconsistent' END,
    CASE WHEN moving AND sqrt((x - px) ** 2 + (y - py) ** 2) <= 2 THEN 'static_in_image_while_camera_moves' END,
    CASE WHEN moving AND sqrt((x - px + sx) ** 2 + (y - py + sy) ** 2) <= 3 THEN 'moves_with_background' END,
    CASE WHEN support < 2 AND confidence < 0.75 THEN CASE WHEN support = 0 THEN 'single_frame_only' ELSE 'no_neighbour_support' END END], lambda r: r IS NOT NULL) AS reasons FROM jd)"""


@query(SEEN + """ SELECT video, frame, CASE WHEN NOT has THEN 'unknown' WHEN len(reasons) > 0 THEN 'rejected' WHEN support >= 2 THEN 'temporally_verified' ELSE 'direct' END AS state,
  CAST(support AS INTEGER) AS support, CASE WHEN has THEN array_to_string(reasons, ',') ELSE '' END AS reasons FROM rs""")
def ball_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest candidate of each frame, judged by the frames around it and the camera's moves."""
    c = _candidates(spark, sf_dir)
    best = c.withColumn("__r", F.row_number().over(Window.partitionBy("video", "frame").orderBy(F.desc("confidence"), "id"))).where("__r = 1")
    return ball.verify(_lattice(c), best, V, region=(0.0, 0.0, 700.0, 190.0)).withColumn("reasons", F.concat_ws(",", "reasons"))


@query()
def ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a frame without duplicates, weighted by confidence; tested against a plain version for each method."""
    return ball.fuse(_candidates(spark, sf_dir), ["video", "frame"])


@query()
def fused_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the ball in every frame; tested against a plain version."""
    c = _candidates(spark, sf_dir)
    return ball.fused_states(c, _lattice(c), V)


@query()
def ball_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the path that took it or why none did; tested against a plain version."""
    return ball.paths(_candidates(spark, sf_dir), V, ball.PathRules(speed=40.0))


@query()
def ball_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, speed and certainty of the ball in every frame; tested against a plain version."""
    c = _candidates(spark, sf_dir)
    return ball.ball_states(ball.paths(c, V, ball.PathRules(speed=40.0)), _lattice(c), V, ball.PathRules(speed=40.0))


def _solves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solve for every half-hour of a video that has an event: a scale and a shift, invalid now and then, with cuts."""
    f, n = F.col("frame"), F.col("n")
    frames = states(spark, sf_dir).groupBy((F.col("u") % 10).alias("video"), F.floor(F.col("t") / 1800).cast("long").alias("frame")).agg(F.max("id").alias("n"))
    z = F.lit(0.0)
    h = F.array(0.08 + d(n % 5) / 1000, z, d(f % 9), z, 0.08 + d(n % 5) / 1000, d(n % 4), z, z, F.lit(1.0))
    return frames.select("video", "frame", (n % 6 != 0).alias("valid"), (d(n % 10) / 10).alias("confidence"), h.alias("homography"), (n % 31 == 0).alias("cut"))


@query(""", sv AS (SELECT u % 10 AS video, t // 1800 AS frame, max(id) AS n FROM ev GROUP BY ALL), pv AS (SELECT *, lag(frame) OVER w AS pf, lag(n) OVER w AS pn FROM sv WINDOW w AS (PARTITION BY video ORDER BY frame)),
 dl AS (SELECT video, (SELECT avg(sqrt((((n % 5) - (pn % 5)) / 1000::DOUBLE * 1280 * (0.1 + 0.8 * i / 3) + (frame % 9) - (pf % 9)) ** 2 + (((n % 5) - (pn % 5)) / 1000::DOUBLE * 720 * (0.55 + 0.2 * j) + (n % 4) - (pn % 4)) ** 2))
   FROM range(4) a(i), range(3) b(j)) AS x FROM pv WHERE n % 6 <> 0 AND pn % 6 <> 0)
 SELECT video, count(x) AS n_pairs, round(coalesce(avg(x), 0), 6) AS mean, round(coalesce(quantile_cont(x, 0.5), 0), 6) AS median, round(coalesce(quantile_cont(x, 0.9), 0), 6) AS p90, round(coalesce(quantile_cont(x, 0.95), 0), 6) AS p95,
   round(coalesce(max(x), 0), 6) AS largest, count(*) FILTER (x > 5) AS over FROM (SELECT DISTINCT video FROM sv) LEFT JOIN dl USING (video) GROUP BY video""")
def calibration_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the solves of neighbouring frames move the pitch, video by video."""
    out = calibration.stability(_solves(spark, sf_dir), V, 1280.0, 720.0)
    return out.select("video", "n_pairs", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p95", "largest")), "over")


@query()
def smoothed_solves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solves averaged over their shot's neighbours; tested against a plain version."""
    return calibration.smooth(_solves(spark, sf_dir), V, 9, 1280.0, 720.0)


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as the kit features of a crop; 40 of them in a row are a video, 16 tracks share them."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 5).alias("video"), (F.col("vec_id") % 80).alias("track_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("feature"))


@query()
def team_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team of each track by the votes of its crops; tested on separated kits and against a plain vote."""
    crops = _crops(spark, sf_dir)
    return teams.vote_teams(teams.predict_teams(crops, teams.fit_teams(crops, V), V), V)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks with votes, a kit and a team."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    team = F.when(i % 7 == 0, "unknown").when(i % 23 == 0, "none").when(i % 2 == 0, "A").otherwise("B")
    return p.select(
        (i % 9).alias("video"), i.alias("track_id"), F.when(i % 29 == 0, "ball").otherwise("player").alias("object_class"), (i * 13 % 97).alias("length"), team.alias("team_id"), (d(i % 11) / 10).alias("team_confidence"),
        F.when(i % 8 != 0, d(i % 17) + 1).alias("kit_distance"), d(i % 13).alias("referee_weight"), (i % 13 * 3).alias("referee_frames"), d(i % 6).alias("keeper_weight"), (i % 6 * 4).alias("keeper_frames"),
        (d(i % 13) + d(i % 6) + d(i % 5)).alias("weight"),
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select((i % 9).alias("video"), i.alias("track_id"), d((i * 7 + s) % 105).alias("x"))


@query(""", tk AS (SELECT p_partkey AS i, p_partkey % 9 AS video, CASE WHEN p_partkey % 29 = 0 THEN 'ball' ELSE 'player' END AS cls, p_partkey * 13 % 97 AS length,
   CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_partkey % 23 = 0 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS team, p_partkey % 11 / 10 AS sure, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 17 + 1 END AS kit FROM part),
 sh AS (SELECT *, coalesce((i % 13) / nullif(i % 13 + i % 6 + i % 5, 0), 0) AS ref, coalesce((i % 6) / nullif(i % 13 + i % 6 + i % 5, 0), 0) AS kp, i % 13 * 3 AS rf, i % 6 * 4 AS kf, team IN ('A', 'B') AS has,
   kit / (SELECT median(kit) FROM tk b WHERE b.video = tk.video) AS odd FROM tk),
 dc AS (SELECT *, CASE WHEN cls = 'ball' THEN 'ball' WHEN (ref < 0.55 OR rf < 15) AND rf >= 15 AND ref >= 0.4 THEN 'split_referee_vote' WHEN (ref < 0.55 OR rf < 15) AND rf > 0 THEN 'weak_referee_vote' WHEN ref < 0.55 OR rf < 15 THEN 'player'
   WHEN coalesce(odd >= 1.15, false) OR ref >= 0.85 THEN 'referee' WHEN has AND sure >= 0.7 THEN 'team_veto' ELSE 'referee_kit_fits' END AS dec FROM sh),
 pl AS (SELECT l_partkey AS i, median((l_partkey * 7 + l_suppkey) % 105) AS x, count(*) AS n FROM lineitem GROUP BY 1),
 kc AS (SELECT dc.*, dec IN ('weak_referee_vote', 'player', 'team_veto') AS person, kf > 0 AND dec IN ('weak_referee_vote', 'player', 'team_veto') AS called, kp >= 0.4 AND kf >= 12 AS voted,
   coalesce(n >= 8 AND least(x, 105 - x) <= 30, false) AS placed, least(x, 105 - x) AS goal FROM dc LEFT JOIN pl USING (i)),
 rk AS (SELECT *, CASE WHEN called AND voted AND placed THEN row_number() OVER (PARTITION BY video, team, called AND voted AND placed ORDER BY length DESC, goal, i) END AS r FROM kc)
 SELECT video, i AS track_id, CASE WHEN dec IN ('ball', 'referee') THEN 'none' WHEN dec = 'split_referee_vote' OR (dec = 'referee_kit_fits' AND NOT has) OR (person AND team = 'none') THEN 'unknown' ELSE team END AS team_id,
   round(CASE WHEN dec = 'referee' THEN 1 WHEN dec = 'split_referee_vote' OR (person AND team = 'none') THEN 0 ELSE sure END, 6) AS team_confidence,
   CASE WHEN dec IN ('ball', 'referee') THEN dec WHEN dec IN ('split_referee_vote', 'referee_kit_fits') THEN 'unknown' WHEN r <= 2 THEN 'goalkeeper' ELSE 'outfield' END AS role,
   round(CASE WHEN dec = 'ball' THEN 1 WHEN dec = 'referee' THEN ref WHEN dec IN ('split_referee_vote', 'referee_kit_fits') THEN 0 WHEN r <= 2 THEN least(1, kp + 0.2) WHEN has THEN 0.8 ELSE 0.4 END, 6) AS role_confidence,
   CASE WHEN called AND NOT voted THEN 'keeper_weak_vote' WHEN called AND NOT placed THEN 'keeper_position' WHEN r > 2 THEN 'keeper_surplus' WHEN r <= 2 THEN 'goalkeeper' ELSE dec END AS decision FROM rk""")
def resolved_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referee, keeper, outfield or unknown for each track, from votes, kit and place, with the rule that settled it."""
    out = teams.resolve_roles(_people(spark, sf_dir), V, _places(spark, sf_dir))
    return out.select("video", "track_id", "team_id", F.round("team_confidence", 6).alias("team_confidence"), "role", F.round("role_confidence", 6).alias("role_confidence"), "decision")


def _on_pitch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order's lines as players on the pitch in a frame, and its customer's keeper."""
    i, s, f = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    people = table(spark, sf_dir, "lineitem").select((f % 5).alias("video"), f.alias("frame"), d(i % 105).alias("x"), d(s % 68).alias("y"), F.when(i % 10 == 0, "unknown").when(i % 2 == 0, "A").otherwise("B").alias("team_id"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    keepers = table(spark, sf_dir, "orders").select(
        (o % 5).alias("video"), (c % 40).alias("track_id"), o.alias("frame"), d(c % 40 * 2).alias("x"), d(o % 68).alias("y"), F.when(c % 40 % 4 == 0, "A").otherwise("unknown").alias("team_id"), (d(c % 40 % 9) / 10).alias("team_confidence")
    )
    return people, keepers


@query(""", pp AS (SELECT l_orderkey % 5 AS video, l_orderkey AS frame, l_partkey % 105 AS x, l_suppkey % 68 AS y, CASE WHEN l_partkey % 10 = 0 THEN 'unknown' WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS team FROM lineitem),
 kp AS (SELECT o_orderkey % 5 AS video, o_custkey % 40 AS k, o_orderkey AS frame, o_custkey % 40 * 2 AS x, o_orderkey % 68 AS y FROM orders),
 ds AS (SELECT kp.video, k, kp.frame, team, avg(dist) AS m FROM (SELECT kp.video, k, kp.frame, pp.team, sqrt((kp.x - pp.x) ** 2 + (kp.y - pp.y) ** 2) AS dist FROM kp JOIN pp ON kp.video = pp.video AND kp.frame = pp.frame AND pp.team IN ('A', 'B')
   QUALIFY row_number() OVER (PARTITION BY kp.video, k, kp.frame, pp.team ORDER BY dist) <= 3) kp GROUP BY ALL),
 mn AS (SELECT video, k, avg(m) FILTER (team = 'A') AS a, avg(m) FILTER (team = 'B') AS b FROM ds GROUP BY ALL), al AS (SELECT DISTINCT video, k FROM kp),
 mg AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0 THEN (greatest(a, b) - least(a, b)) / greatest(a, b) ELSE 0 END AS margin, k % 4 = 0 AND k % 9 >= 5 AS prior FROM al LEFT JOIN mn USING (video, k))
 SELECT video, k AS track_id, CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN prior THEN 'A' WHEN margin < 0.05 THEN 'unknown' WHEN coalesce(a, 1e300) <= coalesce(b, 1e300) THEN 'A' ELSE 'B' END AS team_id,
  round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN prior THEN k % 9 / 10 WHEN margin < 0.05 THEN margin ELSE least(1, margin * 4) END, 6) AS team_confidence, CASE WHEN k * 2 < 52.5 THEN 'left' ELSE 'right' END AS side,
  round(a, 6) AS distance_a, round(b, 6) AS distance_b FROM mg""")
def keeper_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team each keeper stands with, by the nearest three of either team in every frame."""
    out = teams.keeper_teams(*_on_pitch(spark, sf_dir), V)
    return out.select("video", "track_id", "team_id", *(F.round(c, 6).alias(c) for c in ("team_confidence", "distance_a", "distance_b")), "side")


@query(""", gr AS (SELECT o_custkey AS shot, count(*) AS n FROM orders GROUP BY 1), od AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('seed/' || shot)) AS k FROM gr), tt AS (SELECT sum(n) AS total FROM gr),
 fo AS (SELECT list_reduce(list_prepend([0::BIGINT, 0, 0, 0], (SELECT list([n, 0::BIGINT, 0, 0] ORDER BY k) FROM od)), lambda a, e: CASE
   WHEN 0.7::DOUBLE * total - a[1] >= 0.15::DOUBLE * total - a[2] AND 0.7::DOUBLE * total - a[1] >= 0.15::DOUBLE * total - a[3] THEN [a[1] + e[1], a[2], a[3], a[4] + 1]
   WHEN 0.15::DOUBLE * total - a[2] >= 0.15::DOUBLE * total - a[3] THEN [a[1], a[2] + e[1], a[3], a[4] + 1] ELSE [a[1], a[2], a[3] + e[1], a[4] + 1] END) AS s, total FROM tt)
 SELECT split, rows FROM (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([s[1], s[2], s[3]]) AS rows FROM fo)""")
def balanced_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each split gets when whole groups are dealt largest first."""
    dealt = splits.balanced_splits(table(spark, sf_dir, "orders"), ["o_custkey"], {"train": 0.7, "validation": 0.15, "test": 0.15}, "seed")
    return dealt.groupBy("split").agg(F.sum("n").alias("rows"))


@query()
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every group; tested against the row-by-row choice."""
    return splits.balanced_splits(table(spark, sf_dir, "orders"), ["o_custkey"], {"train": 0.7, "validation": 0.15, "test": 0.15}, "seed")


@query(""", fr AS (SELECT DISTINCT u % 10 AS video, t // 1800 AS frame FROM ev), ls AS (SELECT video, list(frame ORDER BY sha256('5/' || video || '/' || frame)) AS fs FROM fr GROUP BY 1),
 sl AS (SELECT video, list_reduce(list_prepend([]::BIGINT[], [[f] for f in fs]), lambda a, e: CASE WHEN len(list_filter(a, lambda x: abs(x - e[1]) < 12)) = 0 THEN a || e ELSE a END) AS kept FROM ls)
 SELECT video, unnest(kept) AS frame FROM sl""")
def spread_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames kept in a seeded order, none within twelve of another."""
    f = states(spark, sf_dir).select((F.col("u") % 10).alias("video"), F.floor(F.col("t") / 1800).cast("long").alias("frame")).distinct()
    return splits.spread_apart(f, V, "frame", 12, splits.seeded(5, "video", "frame"))


@query()
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames for each stratum under its quota, what one can't fill going to the next; tested against the row-by-row choice."""
    f = F.floor(F.col("t") / 1800).cast("long")
    rows = states(spark, sf_dir).groupBy((F.col("u") % 10).alias("video"), f.alias("frame")).agg(F.min("state").alias("kind"))
    return splits.spread_sample(rows, V, "frame", "kind", {"purchase": 20, "error": 10, "click": 15, "view": 5}, 12, 5)


def _visibility(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Half-hours of a video with a sighting now and then, and its entities as players."""
    f, n = F.col("frame"), F.col("n")
    e = states(spark, sf_dir).select((F.col("u") % 10).alias("video"), F.floor(F.col("t") / 1800).cast("long").alias("frame"), "u", "id")
    at = e.groupBy("video", "frame").agg(F.max("id").alias("n"))
    seen = n % 3 == 0
    frames = at.select(
        "video", "frame", F.when(seen, d(n % 1280)).alias("x"), F.when(seen, d(n % 720)).alias("y"), (n % 41 == 0).alias("cut"), d(n % 20).alias("camera_motion"), F.when(n % 5 != 0, d(n % 10) / 10).alias("calibration"), (n % 12).alias("keypoints")
    )
    u = F.col("u")
    players = e.select("video", "frame", d(u * 61 % 1200).alias("x1"), d(u * 43 % 600).alias("y1"), d(u * 61 % 1200 + 90).alias("x2"), d(u * 43 % 600 + 150).alias("y2"))
    return frames, players


@query(""", e AS (SELECT u % 10 AS video, t // 1800 AS frame, u, id FROM ev), fr AS (SELECT video, frame, max(id) AS n FROM e GROUP BY ALL),
 er AS (SELECT *, n % 3 = 0 AS seen, sum(CASE WHEN n % 41 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS era FROM fr),
 ls AS (SELECT *, last_value(CASE WHEN seen THEN {'f': frame, 'x': n % 1280, 'y': n % 720, 'e': era} END IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM er),
 vl AS (SELECT *, CASE WHEN seen AND s.e = era THEN s END AS p FROM ls),
 pv AS (SELECT *, CASE WHEN s.e = era THEN s END AS l, last_value(CASE WHEN seen THEN {'has': p IS NOT NULL, 'vx': ((n % 1280) - p.x) / (frame - p.f), 'vy': ((n % 720) - p.y) / (frame - p.f)} END IGNORE NULLS)
   OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM vl),
 ex AS (SELECT *, frame - l.f AS age, CASE WHEN frame - l.f <= 12 AND (NOT v.has OR sqrt(v.vx ** 2 + v.vy ** 2) * (frame - l.f) <= 300) THEN l.x + CASE WHEN v.has THEN v.vx * (frame - l.f) ELSE 0 END END AS ex,
   CASE WHEN frame - l.f <= 12 AND (NOT v.has OR sqrt(v.vx ** 2 + v.vy ** 2) * (frame - l.f) <= 300) THEN l.y + CASE WHEN v.has THEN v.vy * (frame - l.f) ELSE 0 END END AS ey FROM pv),
 ct AS (SELECT video, frame, count(*) FILTER (ex BETWEEN u * 61 % 1200 AND u * 61 % 1200 + 90 AND ey BETWEEN u * 43 % 600 AND u * 43 % 600 + 150) AS inside,
   count(*) FILTER (sqrt((u * 61 % 1200 + 45 - ex) ** 2 + (u * 43 % 600 + 75 - ey) ** 2) <= 120) AS near FROM ex JOIN e USING (video, frame) GROUP BY ALL),
 st AS (SELECT *, CASE WHEN seen THEN 'likely_visible' WHEN n % 12 < 3 AND coalesce(CASE WHEN n % 5 <> 0 THEN n % 10 / 10 END, 1) < 0.1 THEN 'not_on_pitch' WHEN n % 20 >= 18 THEN 'likely_motion_blurred' WHEN ex IS NULL THEN 'uncertain'
   WHEN NOT (ex BETWEEN 24 AND 1256 AND ey BETWEEN 24 AND 696) THEN 'likely_outside_frame' WHEN inside > 0 THEN 'likely_occluded' WHEN near >= 5 THEN 'likely_hidden_by_players' ELSE 'likely_visible' END AS state FROM ex JOIN ct USING (video, frame))
 SELECT video, frame, state, CAST(CASE WHEN seen THEN 0 ELSE age END AS BIGINT) AS age, CASE WHEN NOT seen AND state IN ('likely_occluded', 'likely_hidden_by_players', 'likely_visible') THEN near END AS nearby FROM st""")
def ball_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ball could have been seen in each frame, from its last sightings in the shot, the camera and the players."""
    out = observability.label_frames(*_visibility(spark, sf_dir), V, 1280.0, 720.0)
    return out.select("video", "frame", "state", F.col("age").cast("long").alias("age"), "nearby")


@query(""", cd AS (SELECT u % 10 AS video, t // 7200 AS frame, max(id) AS n FROM ev GROUP BY ALL), ok AS (SELECT *, n % 200 / 4.0::DOUBLE AS x, n % 90 / 3.0::DOUBLE AS y, 3 + n % 9 AS ratio, n % 40 AS dev FROM cd WHERE 5 + n % 12 <= 15 AND n % 8 <> 0),
 lk AS (SELECT *, CASE WHEN lag(frame) OVER w = frame - 1 THEN sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) END AS step FROM ok WINDOW w AS (PARTITION BY video ORDER BY frame)),
 rn AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS run FROM lk),
 wh AS (SELECT *, count(*) OVER r AS k, min(frame) OVER r AS a, max(frame) OVER r AS b, row_number() OVER (PARTITION BY video, run ORDER BY frame) AS i FROM rn WINDOW r AS (PARTITION BY video, run)),
 cs AS (SELECT video, run, 1 / (1 + coalesce(stddev_pop(step) FILTER (i > 1), 0) / greatest(1, coalesce(avg(step) FILTER (i > 1), 0))) AS c FROM wh GROUP BY ALL)
 SELECT video, frame, round(least(0.45, 0.45::DOUBLE * least(1, ratio / 9) * (1 - least(1, dev / 36)) * c), 6) AS confidence, a AS first_frame, b AS last_frame, round(c, 6) AS consistency FROM wh JOIN cs USING (video, run) WHERE k >= 3""")
def recovered_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak candidates that runs of frames confirm, and how sure they make them."""
    n = F.col("n")
    c = states(spark, sf_dir).groupBy((F.col("u") % 10).alias("video"), F.floor(F.col("t") / 7200).cast("long").alias("frame")).agg(F.max("id").alias("n"))
    c = c.select("video", "frame", (n % 200 / 4.0).alias("x"), (n % 90 / 3.0).alias("y"), d(3 + n % 9).alias("ratio"), d(n % 40).alias("deviation"), (5 + n % 12).alias("gap_frames"), F.when(n % 8 == 0, "not_on_pitch").alias("visibility"))
    out = observability.confirmed(c, V)
    return out.select("video", "frame", F.round("confidence", 6).alias("confidence"), "first_frame", "last_frame", F.round("consistency", 6).alias("consistency"))
