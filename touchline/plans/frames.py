"""Queries over objects in frames: lattices, projection, pairs, overlap, fusion, grids, chunks, detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators import detection, joins, neighbours, sequence
from touchline.plans.registry import query
from touchline.sources.tables import boxes, table

r = lambda c, n=4: F.round(c, n)
H = [1.2, 0.1, 3.0, 0.05, 0.9, 1.0, 0.001, 0.002, 1.0]


@query(""" SELECT o.o_orderkey AS frame, count(bx.id) AS n_rows, coalesce(count_if(bx.label = 'A'), 0) AS n_a, coalesce(bool_or(bx.label = 'R'), false) AS observed
 FROM orders o LEFT JOIN bx ON bx.frame = o.o_orderkey GROUP BY o.o_orderkey""")
def frame_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on every processed frame, frames without rows included."""
    lattice = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    label = F.col("label")
    out = joins.on_lattice(lattice, boxes(spark, sf_dir), ["frame"], {"n_rows": F.lit(True), "n_a": label == "A", "n_r": label == "R"})
    return out.select("frame", "n_rows", "n_a", (F.col("n_r") > 0).alias("observed"))


@query(""", p AS (SELECT frame, id, (x1 + x2) / 2 AS x, y2 AS y FROM bx), w AS (SELECT *, 0.001 * x + 0.002 * y + 1.0 AS w FROM p)
 SELECT frame, id, round((1.2 * x + 0.1 * y + 3.0) / w, 4) AS pitch_x, round((0.05 * x + 0.9 * y + 1.0) / w, 4) AS pitch_y FROM w""")
def ground_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground contact points of boxes on the pitch."""
    x, y = expr.project([F.lit(v) for v in H], (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return boxes(spark, sf_dir).select("frame", "id", r(x).alias("pitch_x"), r(y).alias("pitch_y"))


@query(""" SELECT frame, id, CASE WHEN a < 150 THEN 'tiny' WHEN a < 400 THEN 'small' WHEN a < 2000 THEN 'medium' ELSE 'large' END AS bucket,
  CASE WHEN x1 BETWEEN -2 AND 107 AND y1 BETWEEN -2 AND 70 THEN CAST(least(2, greatest(0, floor(y1 / (68.0 / 3)))) * 3 + least(2, greatest(0, floor(x1 / 35.0))) AS INTEGER) END AS zone
 FROM (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM bx)""")
def size_and_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes(spark, sf_dir).select("frame", "id", expr.size_bucket(area).alias("bucket"), expr.zone(F.col("x1"), F.col("y1")).alias("zone"))


@query(""" SELECT frame, id, CASE WHEN label = 'N' THEN 'interpolated' WHEN score = 0 THEN 'no_calibration' WHEN supp % 10 = 0 THEN 'non_live' WHEN x2 > 120 THEN 'extrapolated'
  WHEN score < 0.04 THEN 'low_calibration' ELSE 'valid' END AS status FROM bx""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per row by fixed priority."""
    status = (
        F.when(F.col("label") == "N", "interpolated").when(F.col("score") == 0, "no_calibration").when(F.col("supp") % 10 == 0, "non_live")
        .when(F.col("x2") > 120, "extrapolated").when(F.col("score") < 0.04, "low_calibration").otherwise("valid")
    )
    return boxes(spark, sf_dir).select("frame", "id", status.alias("status"))


PAIRS = """, pr AS (SELECT a.frame, a.id AS a, b.id AS b, a.score AS sa, b.score AS sb, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s, a.label AS la, b.label AS lb, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS d
  FROM bx a JOIN bx b ON a.frame = b.frame)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects of one frame, an equi-join on the frame; a frame holds few objects."""
    rows = joins.spread(boxes(spark, sf_dir), "frame")
    side = lambda c: rows.select("frame", *(F.col(x).alias(f"{x}_{c}") for x in ("id", "x1", "y1", "x2", "y2", "score", "label")))
    p = side("a").join(side("b"), "frame")
    over = expr.iou(*(tuple(F.col(f"{x}_{c}") for x in ("x1", "y1", "x2", "y2")) for c in "ab"))
    return p.withColumn("iou", over).withColumn("d", F.hypot(F.col("x1_a") - F.col("x1_b"), F.col("y1_a") - F.col("y1_b")))


@query(PAIRS + " SELECT frame, a, b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM pr WHERE a < b AND i > 0")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("id_a < id_b and iou > 0").select("frame", F.col("id_a").alias("a"), F.col("id_b").alias("b"), r("iou", 6).alias("iou"))


@query(PAIRS + """, k AS (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY d, b) AS n, lead(d) OVER (PARTITION BY frame, a ORDER BY d, b) AS nd FROM pr WHERE a <> b)
 SELECT frame, a AS id, b AS nearest, round(d, 4) AS distance, round(nd - d, 4) AS margin, CASE WHEN d > 40 THEN 'loose' WHEN nd - d < 3 THEN 'contested' ELSE 'controlled' END AS state FROM k WHERE n = 1""")
def nearest_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest candidate, margin to the second, and the state they give."""
    p = _pairs(spark, sf_dir).where("id_a <> id_b").select("frame", F.col("id_a").alias("id"), F.col("id_b").alias("nearest"), "d")
    two = joins.closest_two(p, ["frame", "id"], "d", "nearest")
    state = F.when(F.col("d") > 40, "loose").when(F.col("margin") < 3, "contested").otherwise("controlled")
    return two.select("frame", "id", "nearest", r("d").alias("distance"), r("margin").alias("margin"), state.alias("state"))


@query(PAIRS + """, k AS (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY d, b) AS n FROM pr WHERE a <> b)
 SELECT DISTINCT frame, least(a, b) AS a, greatest(a, b) AS b FROM k WHERE n <= 2""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("frame", "id_a").orderBy("d", "id_b")
    p = _pairs(spark, sf_dir).where("id_a <> id_b").withColumn("n", F.row_number().over(w)).where("n <= 2")
    return p.select("frame", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


@query(PAIRS + """, m AS (SELECT frame, a, sa, max(CASE WHEN lb <> 'A' AND i / nullif(s - i, 0) > 0.3 THEN sb END) AS partner FROM pr WHERE la = 'A' GROUP BY frame, a, sa)
 SELECT frame, a AS id, round(least(1.0, sa + 0.15 * coalesce(partner, 0)), 6) AS fused FROM m""")
def fused_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specialist detections (label A) lifted by their best partner of another source."""
    p = _pairs(spark, sf_dir).where("label_a = 'A'")
    best = p.groupBy("frame", F.col("id_a").alias("id"), "score_a").agg(F.max(F.when((F.col("label_b") != "A") & (F.col("iou") > 0.3), F.col("score_b"))).alias("partner"))
    return best.select("frame", "id", r(F.least(F.lit(1.0), F.col("score_a") + 0.15 * F.coalesce("partner", F.lit(0.0))), 6).alias("fused"))


@query(""", g AS (SELECT CAST(least(11, greatest(0, floor(x1 / 97 * 12))) AS BIGINT) AS cx, CAST(least(7, greatest(0, floor(y1 / 89 * 8))) AS BIGINT) AS cy, 1 + score * 10 AS w FROM bx)
 SELECT cx, cy, count(*) AS n, round(sum(w) / sum(sum(w)) OVER (), 6) AS weight FROM g GROUP BY cx, cy""")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted 12 by 8 occupancy grid that sums to 1."""
    cell = lambda c, size, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) / size * n))).cast("long")
    g = boxes(spark, sf_dir).groupBy(cell("x1", 97, 12).alias("cx"), cell("y1", 89, 8).alias("cy")).agg(F.count("*").alias("n"), F.sum(1 + F.col("score") * 10).alias("w"))
    return g.select("cx", "cy", "n", r(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("weight"))


@query(""", f AS (SELECT DISTINCT frame FROM bx), c AS (SELECT *, CAST(floor(frame / 300) AS BIGINT) AS chunk FROM f)
 SELECT chunk, chunk * 300 AS first_owned, chunk * 300 + 300 AS end_owned, greatest(0, chunk * 300 - 50) AS first_read, count(*) AS owned FROM c GROUP BY chunk""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that own every frame once, with a lead-in before."""
    c = boxes(spark, sf_dir).select("frame").distinct().groupBy(F.floor(F.col("frame") / 300).alias("chunk")).agg(F.count("*").alias("owned"))
    start = F.col("chunk") * 300
    return c.select("chunk", start.alias("first_owned"), (start + 300).alias("end_owned"), F.greatest(F.lit(0), start - 50).cast("long").alias("first_read"), "owned")


@query(""", o AS (SELECT a.supp AS a, b.supp AS b, count(*) AS shared, avg(sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) AS d FROM bx a JOIN bx b ON a.frame = b.frame AND a.label = 'A' AND b.label = 'R' GROUP BY 1, 2)
 SELECT a, b, shared, round(d - 0.5 * shared, 4) AS cost FROM o WHERE shared >= 2 AND d <= 40""")
def identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track pairs that meet in several frames, with the cost of calling them one."""
    side = lambda c, label: boxes(spark, sf_dir).where(F.col("label") == label).select("frame", F.col("supp").alias(c), F.col("x1").alias(f"x1_{c}"), F.col("x2").alias(f"x2_{c}"))
    d = F.hypot(F.col("x1_a") - F.col("x1_b"), F.col("x2_a") - F.col("x2_b"))
    o = side("a", "A").join(side("b", "R"), "frame").groupBy("a", "b").agg(F.count("*").alias("shared"), F.avg(d).alias("d"))
    return o.where("shared >= 2 and d <= 40").select("a", "b", "shared", r(F.col("d") - 0.5 * F.col("shared")).alias("cost"))


@query(""", s AS (SELECT label AS class, score, CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS tp, frame, id FROM bx), c AS (SELECT *, sum(tp) OVER w AS hits, row_number() OVER w AS n, sum(tp) OVER (PARTITION BY class) AS total FROM s
   WINDOW w AS (PARTITION BY class ORDER BY score DESC, frame, id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT class, hits / CAST(total AS DOUBLE) AS recall, max(hits / CAST(n AS DOUBLE)) OVER (PARTITION BY class ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM c),
 g AS (SELECT class, k, coalesce(max(CASE WHEN recall >= k / 100.0 - 1e-12 THEN best END), 0) AS pr FROM p, range(101) t(k) GROUP BY class, k) SELECT class, round(avg(pr), 6) AS ap FROM g GROUP BY class""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """101-point interpolated average precision per class, ranked over range partitions."""
    s = boxes(spark, sf_dir).select(F.col("label").alias("class"), "score", (F.col("part") % 3 == 0).alias("hit"), "frame", "id")
    sizes = s.groupBy("class").agg(F.count_if("hit").alias("n_truth"))
    return detection.average_precisions(s, sizes, ["class"], ["frame", "id"]).select("class", r(F.col("ap"), 6).alias("ap"))


@query(""" SELECT supp % 5 AS domain, count_if(part % 3 = 0) AS tp, count_if(part % 3 = 1) AS fp, count_if(part % 3 = 2) AS fn,
 round(2 * count_if(part % 3 = 0) / nullif(2 * count_if(part % 3 = 0) + count_if(part % 3 = 1) + count_if(part % 3 = 2), 0), 6) AS f1 FROM bx GROUP BY supp % 5""")
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part") % 3
    d = boxes(spark, sf_dir).groupBy((F.col("supp") % 5).alias("domain")).agg(*(F.count_if(kind == i).alias(c) for i, c in enumerate(("tp", "fp", "fn"))))
    return d.select("*", r(expr.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query(""", d AS (SELECT supp % 5 AS domain, count_if(part % 3 = 0) AS tp, count_if(part % 3 = 1) AS fp, count_if(part % 3 = 2) AS fn FROM bx GROUP BY 1), f AS (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM d)
 SELECT round(avg(f1), 6) AS macro_f1, round(min(f1), 6) AS worst_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM f""")
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("part") % 3
    d = boxes(spark, sf_dir).groupBy((F.col("supp") % 5).alias("domain")).agg(*(F.count_if(kind == i).alias(c) for i, c in enumerate(("tp", "fp", "fn"))))
    f = d.withColumn("f1", expr.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return f.agg(r(F.avg("f1"), 6).alias("macro_f1"), r(F.min("f1"), 6).alias("worst_f1"), r(expr.f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro_f1"))


@query(""", c AS (SELECT label, count(*) AS n, count_if(part % 4 = 0) AS k FROM bx GROUP BY label), p AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM c)
 SELECT label, k, n, round(p, 6) AS rate, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with Wilson intervals."""
    c = boxes(spark, sf_dir).groupBy("label").agg(F.count_if(F.col("part") % 4 == 0).alias("k"), F.count("*").alias("n"))
    low, high = expr.wilson(F.col("k"), F.col("n"))
    return c.select("*", r(expr.ratio(F.col("k"), F.col("n")), 6).alias("rate"), r(low, 6).alias("low"), r(high, 6).alias("high"))


@query(""", f AS (SELECT frame, unnest(list_filter([CASE WHEN score = 0 THEN 'no_score' END, CASE WHEN x2 > 120 THEN 'off_pitch' END, CASE WHEN label = 'N' THEN 'interpolated' END], lambda x: x IS NOT NULL)) AS flag FROM bx)
 SELECT flag, count(*) AS n, count(DISTINCT frame) AS frames FROM f GROUP BY flag""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"no_score": F.col("score") == 0, "off_pitch": F.col("x2") > 120, "interpolated": F.col("label") == "N"}
    f = boxes(spark, sf_dir).select("frame", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))).alias("flag"))
    return f.groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


@query(""" SELECT supp AS track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, max(CASE WHEN label <> 'N' THEN frame END) AS last_real FROM bx GROUP BY supp HAVING count_if(label <> 'N') >= 20""")
def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track with enough real observations, trailing interpolated ones trimmed in last_real."""
    real = F.col("label") != "N"
    t = boxes(spark, sf_dir).groupBy(F.col("supp").alias("track")).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"), F.max(F.when(real, F.col("frame"))).alias("last_real"), F.count_if(real).alias("k")
    )
    return t.where("k >= 20").drop("k")


@query()
def suppressed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects left after greedy suppression within each frame."""
    return joins.keep_apart(boxes(spark, sf_dir), ["frame"], "x1", "y1", "score", 20.0)


@query(""" SELECT e.vec_id AS query_id, f.vec_id AS vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 5) AS cosine
 FROM embeddings e JOIN embeddings f ON e.label = f.label AND e.vec_id <> f.vec_id QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) DESC, f.vec_id) <= 3""")
def appearance_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most alike of each vector's own class; pairs are formed within a class only, as the appearance cost gate does."""
    p = neighbours.nearest_in_class(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 3)
    return p.select("query_id", "vec_id", r("cosine", 5).alias("cosine"))


@query(""" SELECT frame, id, CASE WHEN part % 50 <> 0 THEN round(x1, 4) END AS x, CASE WHEN part % 50 <> 0 THEN round(y1, 4) END AS y FROM bx""")
def inverse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a homography and its inverse; where the matrix is singular there is no way back."""
    h = [F.lit(v) for v in H]
    broken = F.col("part") % 50 == 0
    matrix = [F.when(broken, F.lit(1.0)).otherwise(v) for v in h]
    back = expr.project(expr.invert(matrix), *expr.project(h, F.col("x1"), F.col("y1")))
    return boxes(spark, sf_dir).select("frame", "id", r(back[0]).alias("x"), r(back[1]).alias("y"))


@query(""", p AS (SELECT 1280 * (0.1::DOUBLE + 0.8::DOUBLE * i / 3) AS px, 720 * (0.55::DOUBLE + 0.2::DOUBLE * j) AS py FROM range(4) a(i), range(3) b(j)),
 k AS (SELECT DISTINCT part FROM bx),
 q AS (SELECT part, 1.0::DOUBLE + part % 10 / 100 AS s, 0.001::DOUBLE * px + 0.002::DOUBLE * py + 1 AS w, px, py FROM k, p)
 SELECT part, round(avg(sqrt(power((1.2::DOUBLE * px + 0.1::DOUBLE * py + 3) / w * (s - 1), 2) + power((0.05::DOUBLE * px + 0.9::DOUBLE * py + 1) / w * (s - 1), 2))), 6) AS distance FROM q GROUP BY part""")
def homography_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart two homographies map the lower image."""
    parts = boxes(spark, sf_dir).select("part").distinct()
    a = [F.lit(v) for v in H]
    scale = 1 + F.col("part") % 10 / 100
    b = [v * scale if i < 6 else v for i, v in enumerate(a)]
    return parts.select("part", r(expr.homography_distance(a, b, 1280.0, 720.0), 6).alias("distance"))


@query(""", f AS (SELECT DISTINCT frame FROM bx), c AS (SELECT range AS chunk, range * 1000 AS own_from, range * 1000 + 999 AS own_to FROM range(200)),
 j AS (SELECT c.chunk, f.frame, f.frame BETWEEN own_from AND own_to AS own FROM f JOIN c ON f.frame BETWEEN own_from - 50 AND own_to + 50)
 SELECT chunk, count_if(own) AS kept, count_if(NOT own) AS dropped FROM j GROUP BY chunk""")
def owned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that each of the overlapping chunks keeps and drops."""
    f = boxes(spark, sf_dir).select("frame").distinct()
    chunk = F.floor(F.col("frame") / 1000)
    near = F.array_distinct(F.array(F.floor((F.col("frame") - 50) / 1000), chunk, F.floor((F.col("frame") + 50) / 1000)))
    rows = f.select("frame", F.explode(near).alias("chunk")).where("chunk >= 0 and chunk < 200")
    chunks = spark.range(200).select(F.col("id").alias("chunk"), (F.col("id") * 1000).alias("own_from"), (F.col("id") * 1000 + 999).alias("own_to"))
    kept, dropped = sequence.keep_owned(rows, chunks, [], "frame")
    return dropped.join(kept.groupBy("chunk").agg(F.count("*").alias("kept")), "chunk", "left").select("chunk", F.coalesce("kept", F.lit(0)).alias("kept"), "dropped")
