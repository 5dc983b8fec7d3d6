"""Association, online tracking and detection scores on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import association, detection, tracker
from touchline.operators.staging import materialise
from touchline.plans.registry import query
from touchline.plans.streams import event_stream
from touchline.sources.tables import boxes, seconds, states
from touchline.streaming import tracking, windows

V = ["video"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tracklet of three to seven frames, a minute being a frame; entities share videos by their number."""
    i, k, u = F.col("id"), F.col("k"), F.col("u")
    cx, cy, h = u * 53 % 1200 + i % 11 + k * (i % 5 - 2), u * 31 % 700 + i % 7, 60 + u % 4 * 15 + i % 5
    o = states(spark, sf_dir).select("u", "id", F.floor(F.col("t") / 60).alias("f"), F.explode(F.sequence(F.lit(0), (2 + i % 5).cast("int"))).alias("k"))
    d = lambda c: c.cast("double")
    return o.select(
        (u % 40).alias("video"), i.alias("track_id"), (F.col("f") + k).alias("frame"), F.when(u % 5 == 0, "referee").otherwise("player").alias("object_class"), (k == 1).alias("interpolated"),
        d(cx - h / 4).alias("x1"), d(cy - h / 2).alias("y1"), d(cx + h / 4).alias("x2"), d(cy + h / 2).alias("y2"),
    )


def _calibration(observations: DataFrame) -> DataFrame:
    f = F.col("frame")
    h = F.array(*(F.lit(x) for x in (0.08, 0.0, 1.0, 0.0, 0.08, 2.0, 0.0, 0.0, 1.0)))
    return observations.select("video", "frame").distinct().select("video", "frame", (f % 5 != 0).alias("valid"), (f % 8 / 10 + 0.2).alias("confidence"), h.alias("homography"))


def _appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    look = F.when(F.col("id") % 4 != 0, F.array((1 + u % 3).cast("double"), (u % 2).cast("double"), (F.col("id") % 3 * 2).cast("double")))
    return states(spark, sf_dir).select((u % 40).alias("video"), F.col("id").alias("track_id"), look.alias("vector"))


#: Tracklets, and all ordered pairs of a video with the gate that refuses them or their cost.
PAIRS = """, o AS (
  SELECT u % 40 AS video, id AS track, t // 60 + k AS f, CASE WHEN u % 5 = 0 THEN 'referee' ELSE 'player' END AS cls, id, u, k, u * 53 % 1200 + id % 11 + k * (id % 5 - 2) AS cx,
    u * 31 % 700 + id % 7 AS cy, CAST(60 + u % 4 * 15 + id % 5 AS DOUBLE) AS h FROM (SELECT *, unnest(range(3 + id % 5)) AS k FROM ev)
), r AS (SELECT *, (f % 5 <> 0 AND f % 8 / 10 + 0.2 >= 0.5) AS solved, 0.08::DOUBLE * cx + 1 AS px, 0.08::DOUBLE * (cy + h / 2) + 2 AS py, max(f) OVER (PARTITION BY video, track) AS last,
    row_number() OVER (PARTITION BY video, track ORDER BY f DESC) AS back FROM o WHERE k <> 1
), ft AS (
  SELECT video, track, any_value(cls) AS cls, any_value(u) AS u, min(f) AS a, max(f) AS z, arg_min(cx, f) AS hx, arg_min(cy, f) AS hy, arg_max(cx, f) AS tx, arg_max(cy, f) AS ty, any_value(h) AS h,
    arg_min(cx, f) FILTER (back <= 6) AS bx, arg_min(cy, f) FILTER (back <= 6) AS by_, min(f) FILTER (back <= 6) AS bf,
    arg_min({'x': px, 'y': py, 'f': f}, f) FILTER (solved) AS hp, arg_max({'x': px, 'y': py, 'f': f}, f) FILTER (solved) AS tp FROM r GROUP BY video, track
), lk AS (SELECT *, (tx - bx) / greatest(1, z - bf) AS vx, (ty - by_) / greatest(1, z - bf) AS vy, CASE WHEN track % 4 <> 0 THEN 1 + u % 3 END AS l1, u % 2 AS l2, track % 3 * 2 AS l3 FROM ft
), q AS (
  SELECT a.video, a.track AS earlier, b.track AS later, b.a - a.z AS gap, a.cls = b.cls AS same, a.h / b.h AS size, a.tp IS NOT NULL AND b.hp IS NOT NULL AS pitch,
    sqrt((b.hp.x - a.tp.x) ** 2 + (b.hp.y - a.tp.y) ** 2) AS m, 9.5::DOUBLE * (greatest(1, b.hp.f - a.tp.f) / 25::DOUBLE) + 4 AS ml,
    sqrt((a.tx + a.vx * (b.a - a.z) - b.hx) ** 2 + (a.ty + a.vy * (b.a - a.z) - b.hy) ** 2) AS p, 120 + 6::DOUBLE * (b.a - a.z) AS pl,
    CASE WHEN a.l1 * b.l1 IS NOT NULL THEN least(1, greatest(0, 1 - (a.l1 * b.l1 + a.l2 * b.l2 + a.l3 * b.l3) / (sqrt(a.l1 ** 2 + a.l2 ** 2 + a.l3 ** 2) * sqrt(b.l1 ** 2 + b.l2 ** 2 + b.l3 ** 2)))) END AS unlike
  FROM lk a JOIN lk b ON a.video = b.video AND a.track <> b.track
), g AS (
  SELECT *, CASE WHEN gap <= 0 THEN 'temporal_overlap' WHEN gap > 90 THEN 'gap_too_long' WHEN NOT same THEN 'class_mismatch' WHEN NOT size BETWEEN 0.55 AND 1.8 THEN 'size_inconsistent'
    WHEN pitch AND m > ml THEN 'pitch_distance_exceeded' WHEN NOT pitch AND gap > 25 THEN 'long_gap_without_pitch_evidence' WHEN NOT pitch AND p > pl THEN 'image_distance_exceeded'
    WHEN unlike > 0.75 THEN 'appearance_mismatch' ELSE 'admitted' END AS reason FROM q)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _observations(spark, sf_dir)
    return materialise(association.features(association.track_ends(o, V, _calibration(o)), V), "features")


@query(PAIRS + """ SELECT video, earlier, later, CASE WHEN pitch THEN 'pitch' ELSE 'image' END AS evidence,
  round(0.55::DOUBLE * CASE WHEN pitch THEN m / ml ELSE p / pl END + 0.15::DOUBLE * coalesce(unlike, 0.5) + 0.2::DOUBLE * (gap / 90::DOUBLE) + 0.1::DOUBLE * abs(ln(size)), 6) AS cost FROM g WHERE reason = 'admitted'""")
def tracklet_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible pairs of tracklets with their cost from geometry, appearance, gap and size."""
    pairs = association.pair_costs(_tracks(spark, sf_dir), V, _appearance(spark, sf_dir), admitted=True)
    return pairs.select("video", "earlier", "later", "evidence", F.round("cost", 6).alias("cost"))


@query(PAIRS + " SELECT video, reason, count(*) AS n FROM g GROUP BY 1, 2")
def tracklet_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of tracklets each gate refuses; pairs outside the window of gaps are counted without being made."""
    tracks = _tracks(spark, sf_dir)
    return association.refusal_counts(tracks, association.pair_costs(tracks, V, _appearance(spark, sf_dir)), V)


@query()
def associated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every absorbed tracklet with the track that it ends in, matched over whole videos; tested against all matchings."""
    o = _observations(spark, sf_dir)
    return association.associate(o, V, _calibration(o), _appearance(spark, sf_dir)).survivors


def _sightings(events: DataFrame) -> DataFrame:
    """An event as a sighting of its entity, which drifts slowly through one of the videos; half an hour is a frame."""
    u, i, f = F.col("u"), F.col("id"), F.floor(F.col("t") / 1800)
    d = lambda c: c.cast("double")
    x, y = u * 61 % 1500 + f % 400 * 0.2 + i % 3, u * 43 % 800 + i % 4
    return events.select(
        (u % 10).alias("video"), f.cast("long").alias("frame"), F.timestamp_seconds(f * 1800).alias("ts"), d(x).alias("x1"), d(y).alias("y1"), d(x + 40).alias("x2"), d(y + 90).alias("y2"),
        (0.25 + i % 8 / 10).alias("score"), F.when(i % 9 == 0, "referee").otherwise("player").alias("object_class"),
    )


@query()
def online_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the sightings, frame by frame; tested against a plain tracker of single boxes."""
    return tracker.track(_sightings(states(spark, sf_dir)), V)


@query()
def streamed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks from a stream of sightings; tested against the batch form, across a restart too."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("t"))
    with tracking.state_store(spark):
        return windows.run_available(tracking.online_tracks(windows.closed(_sightings(e), "ts"), "video", "ts", idle="30 days"), "tracks")


def _truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as true boxes, all but some of them found a little off, and further boxes that nothing stands behind."""
    part, supp = F.col("part"), F.col("supp")
    b = boxes(spark, sf_dir).withColumns({"object_class": F.when(F.col("label") == "R", "ball").otherwise("player"), "id": (supp * 10_000_000 + part * 10 + F.col("id")) * 64 + (F.col("x2") - F.col("x1")).cast("long")})
    truth = b.select("frame", "object_class", "id", "x1", "y1", "x2", "y2")
    off = lambda m: part % m * 0.5
    seen = b.where(part % 11 != 0).select("frame", "object_class", "id", (F.col("x1") + off(7)).alias("x1"), F.col("y1"), (F.col("x2") + off(5)).alias("x2"), F.col("y2"), (supp % 50 / 50).alias("score"))
    ghost = b.where(supp % 4 == 0).select(
        "frame", "object_class", (-F.col("id")).alias("id"), F.col("x1"), (F.col("y1") + 2).alias("y1"), F.col("x2"), (F.col("y2") + 3).alias("y2"), (part % 40 / 50).alias("score")
    )
    return truth, seen.unionByName(ghost)


#: True and found boxes and their pairs that overlap by half.
MATCHED = """, ob AS (SELECT * REPLACE ((supp * 10000000 + part * 10 + id) * 64 + CAST(x2 - x1 AS BIGINT) AS id), CASE WHEN label = 'R' THEN 'ball' ELSE 'player' END AS cls FROM bx), tr AS (SELECT frame, cls, id, x1, y1, x2, y2 FROM ob
), fd AS (SELECT frame, cls, id, x1 + part % 7 * 0.5::DOUBLE AS x1, y1, x2 + part % 5 * 0.5::DOUBLE AS x2, y2, supp % 50 / 50 AS score FROM ob WHERE part % 11 <> 0
  UNION ALL SELECT frame, cls, -id, x1, y1 + 2, x2, y2 + 3, part % 40 / 50 FROM ob WHERE supp % 4 = 0
), rk AS (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY score DESC, id) AS k FROM fd
), pr AS (SELECT *, w * h / nullif(sa + sb - w * h, 0) AS iou FROM (SELECT f.frame, f.cls, f.k, t.id AS g, greatest(0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) AS w, greatest(0, least(f.y2, t.y2) - greatest(f.y1, t.y1)) AS h,
    greatest(0, f.x2 - f.x1) * greatest(0, f.y2 - f.y1) AS sa, greatest(0, t.x2 - t.x1) * greatest(0, t.y2 - t.y1) AS sb FROM rk f JOIN tr t USING (frame, cls)) WHERE w * h / nullif(sa + sb - w * h, 0) >= 0.5
), lv AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS thr)"""


def _matched_sql() -> str:
    """Greedy matching as a fold over a frame's pairs, by the found box's turn and then overlap: what is taken so far, box by box."""
    return MATCHED + """, ls AS (SELECT frame, cls, list({'k': k, 'g': g, 'iou': iou} ORDER BY k, iou DESC, g) AS pairs FROM pr GROUP BY ALL
), mt AS (SELECT frame, cls, thr, list_reduce(list_prepend([], [[e.k, e.g] for e in pairs if e.iou >= thr]), lambda a, e: CASE WHEN list_contains([a[i] for i in range(1, len(a) + 1, 2)], e[1])
    OR list_contains([a[i] for i in range(2, len(a) + 1, 2)], e[2]) THEN a ELSE a || e END) AS taken FROM ls, lv
), ht AS (SELECT frame, cls, thr, unnest([taken[i] for i in range(1, len(taken) + 1, 2)]) AS k, unnest([taken[i] for i in range(2, len(taken) + 1, 2)]) AS g FROM mt
), sc AS (SELECT rk.cls, thr, score, frame, id, ht.k IS NOT NULL AS hit FROM rk CROSS JOIN lv LEFT JOIN ht USING (frame, cls, thr, k)
), nt AS (SELECT cls, count(*) AS n_truth, count(*) FILTER ((x2 - x1) * (y2 - y1) < 1024) AS n_small FROM tr GROUP BY 1
), cm AS (SELECT cls, thr, n_truth, sum(hit::INT) OVER w AS tp, row_number() OVER w AS r FROM sc JOIN nt USING (cls) WINDOW w AS (PARTITION BY cls, thr ORDER BY score DESC, frame, id)
), pt AS (SELECT cls, thr, i, coalesce(max(tp / r) FILTER (tp / n_truth >= i * 0.01::DOUBLE), 0) AS best FROM cm, range(101) x(i) GROUP BY ALL
), ap AS (SELECT cls, thr, avg(best) AS ap FROM pt GROUP BY ALL
), hp AS (SELECT ht.cls, count(*) AS tp, count(*) FILTER ((x2 - x1) * (y2 - y1) < 1024) AS small FROM ht JOIN tr ON tr.frame = ht.frame AND tr.cls = ht.cls AND tr.id = ht.g WHERE thr = 0.5 GROUP BY 1
), nf AS (SELECT cls, count(*) AS n_found FROM fd GROUP BY 1)"""


@query(_matched_sql() + """ SELECT cls AS object_class, n_truth, n_found, tp, n_found - tp AS fp, n_truth - tp AS fn, tp / n_found AS "precision", tp / n_truth AS recall, 2 * tp / (n_found + n_truth) AS f1,
  (SELECT ap FROM ap WHERE ap.cls = nt.cls AND thr = 0.5) AS ap50, (SELECT avg(ap) FROM ap WHERE ap.cls = nt.cls) AS ap50_95, n_small, small / n_small AS small_recall FROM nt JOIN nf USING (cls) JOIN hp USING (cls)""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and average precision over ten thresholds from boxes, class by class."""
    return detection.evaluate_detection(*_truth_and_found(spark, sf_dir), ["frame"])


@query(_matched_sql() + """, fc AS (SELECT frame, cls, count(*) AS tp FROM ht WHERE thr = 0.5 GROUP BY ALL)
 SELECT frame, object_class, coalesce(tp, 0) AS tp, n_p - coalesce(tp, 0) AS fp, n_g - coalesce(tp, 0) AS fn FROM (SELECT frame, cls AS object_class, count(*) AS n_g FROM tr GROUP BY ALL)
  JOIN (SELECT frame, cls AS object_class, count(*) AS n_p FROM fd GROUP BY ALL) USING (frame, object_class) LEFT JOIN (SELECT frame, cls AS object_class, tp FROM fc) USING (frame, object_class)""")
def detection_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, false and missed boxes of the frames that have both true and found ones, at an overlap of one half."""
    truth, found = _truth_and_found(spark, sf_dir)
    key = ["frame", "object_class"]
    both = truth.select(*key).distinct().join(found.select(*key).distinct(), key)
    return detection.frame_counts(truth, found, key, both)


@query()
def detection_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of the mean recall and precision of a frame, resampled by frame; tested against the normal approximation."""
    truth, found = _truth_and_found(spark, sf_dir)
    frames = truth.select("frame", "object_class").unionByName(found.select("frame", "object_class"))
    counts = detection.frame_counts(truth, found, ["frame", "object_class"], frames)
    tp = F.col("tp")
    rates = F.array(F.struct(F.lit("recall").alias("metric"), (tp / F.nullif(tp + F.col("fn"), F.lit(0))).alias("value")), F.struct(F.lit("precision").alias("metric"), (tp / F.nullif(tp + F.col("fp"), F.lit(0))).alias("value")))
    return detection.bootstrap_means(counts.select("frame", "object_class", F.inline(rates)), ["frame"], ["object_class", "metric"], "value")
