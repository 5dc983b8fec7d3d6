"""Tracklets, trajectories and calibrations on the test tables, set forms and SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import tracklets
from touchline.plans.registry import query
from touchline.sources.tables import states, table

PIECES = """, pc AS (SELECT u, id AS track_id, row_number() OVER (PARTITION BY u ORDER BY t, id) * 10 AS first_frame, id % 300 AS head_x, id % 200 AS head_y, 20 + id % 10 AS height, id % 9 AS len FROM ev)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's events as tracklets that start every tenth frame and last up to nine."""
    i, d = F.col("id"), lambda c: c.cast("double")
    first = F.row_number().over(Window.partitionBy("u").orderBy("t", "id")) * 10
    return states(spark, sf_dir).select(
        "u", i.alias("track_id"), F.lit("person").alias("object_class"), first.alias("first_frame"), (first + i % 9).alias("last_frame"), d(i % 300).alias("head_x"), d(i % 200).alias("head_y"),
        d(i % 300 + 5).alias("tail_x"), d(i % 200).alias("tail_y"), F.lit(1.0).alias("speed_x"), F.lit(0.0).alias("speed_y"), d(20 + i % 10).alias("head_height"), d(20 + i % 10).alias("tail_height"),
    )


@query(PIECES + """, pr AS (SELECT a.u, a.track_id AS earlier, b.track_id AS later, b.first_frame - a.first_frame - a.len AS gap,
   sqrt((a.head_x + 5 + (b.first_frame - a.first_frame - a.len) - b.head_x) ** 2 + (a.head_y - b.head_y) ** 2) AS d, a.height / b.height AS q
  FROM pc a JOIN pc b ON a.u = b.u AND a.track_id <> b.track_id AND b.first_frame - a.first_frame - a.len BETWEEN 1 AND 30)
 SELECT u, earlier, later, round(d + 2 * gap, 6) AS cost FROM pr WHERE d <= 120 AND q BETWEEN 0.6 AND 1.67""")
def stitch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tracklets that one object may have made, with their cost."""
    return tracklets.stitch_pairs(_pieces(spark, sf_dir), ["u"]).select("u", "earlier", "later", F.round("cost", 6).alias("cost"))


@query()
def stitched_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitched tracklets and the first one of their chain; tested against a plain version."""
    links = tracklets.stitch(tracklets.stitch_pairs(_pieces(spark, sf_dir), ["u"]), ["u"])
    return tracklets.chain_heads(links, ["u"])


@query(""", k AS (SELECT u, id AS later, lag(id) OVER (PARTITION BY u ORDER BY t, id) AS before_, t FROM ev), c AS (SELECT *, before_ IS NULL OR later % 6 = 0 AS starts FROM k),
 g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY u ORDER BY t, later) AS g FROM c)
 SELECT u, later, first_value(later) OVER (PARTITION BY u, g ORDER BY t, later) AS head FROM g QUALIFY NOT starts""")
def identity_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities linked from chunk to chunk, each with the first of its chain."""
    w = Window.partitionBy("u").orderBy("t", "id")
    links = states(spark, sf_dir).select("u", F.col("id").alias("later"), F.lag("id").over(w).alias("earlier")).where("earlier is not null and later % 6 <> 0")
    return tracklets.chain_heads(links, ["u"])


@query()
def best_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path through each stretch of ball candidates; tested against all paths."""
    i = F.col("id")
    frame = F.floor(F.row_number().over(Window.partitionBy("u").orderBy("t", "id")) / 2) + F.floor(i / 40) * 5
    c = states(spark, sf_dir).select("u", frame.alias("frame"), "id", (i * 37 % 200).cast("double").alias("x"), (i * 53 % 100).cast("double").alias("y"), (i % 10 / 10).alias("confidence"))
    return tracklets.trajectories(c, ["u"])


@query(""", f AS (SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY t, id) AS p, id % 7 = 0 AS valid, CAST(id % 10 AS DOUBLE) / 10 AS c, CASE WHEN id % 31 <> 0 THEN CAST(id % 5 AS DOUBLE) END AS dx FROM ev),
 g AS (SELECT *, sum(coalesce(dx, 0)) OVER w AS far, count(*) FILTER (dx IS NULL) OVER w AS gone FROM f WINDOW w AS (PARTITION BY u ORDER BY p)),
 b AS (SELECT x.u, x.p, a.p AS anchor_frame, CAST(abs(x.p - a.p) AS INTEGER) AS step, a.c * greatest(0, 1 - 0.02::DOUBLE * abs(x.p - a.p)) AS sure, a.far - x.far AS moved,
   EXISTS (SELECT 1 FROM g v WHERE v.u = x.u AND v.valid AND v.p > least(a.p, x.p) AND v.p < greatest(a.p, x.p)) AS hidden, a.c AS c, x.gone <> a.gone AS broken
  FROM g x JOIN g a ON a.u = x.u AND a.valid AND NOT x.valid AND abs(x.p - a.p) BETWEEN 1 AND 45)
 SELECT u, p AS frame, anchor_frame, step, round(sure, 6) AS confidence, round(moved, 6) AS shift FROM b WHERE NOT hidden AND NOT broken AND c >= 0.5 AND sure >= 0.1
  QUALIFY row_number() OVER (PARTITION BY u, p ORDER BY step, anchor_frame) = 1""")
def propagated_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a solve that a sure one nearby reaches, moved by the warps between."""
    i, p = F.col("id"), F.row_number().over(Window.partitionBy("u").orderBy("t", "id"))
    line = lambda *v: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in v))
    f = states(spark, sf_dir).select(
        "u", p.cast("long").alias("frame"), (i % 7 == 0).alias("valid"), ((i % 10).cast("double") / 10).alias("confidence"), line(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0).alias("homography"),
        F.when(i % 31 != 0, line(1.0, 0.0, (i % 5).cast("double"), 0.0, 1.0, 0.0)).alias("warp"),
    )
    out = tracklets.propagate_calibration(f, ["u"])
    return out.select("u", "frame", "anchor_frame", "step", F.round("confidence", 6).alias("confidence"), F.round(F.col("homography")[2], 6).alias("shift"))


@query(""", sp AS (SELECT u, CASE WHEN id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM ev)
 SELECT 'both' AS part, count(*) AS n FROM (SELECT u FROM sp WHERE split = 'train' INTERSECT SELECT u FROM sp WHERE split = 'test')
 UNION ALL SELECT 'train_only', count(*) FROM (SELECT u FROM sp WHERE split = 'train' EXCEPT SELECT u FROM sp WHERE split = 'test')""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that two splits share, and those that only one has."""
    sp = states(spark, sf_dir).select("u", F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"))
    train, test = (sp.where(F.col("split") == s).select("u") for s in ("train", "test"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(train.intersect(test), "both").unionByName(count(train.subtract(test), "train_only"))


@query(" SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL over tables that it is handed."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    return spark.sql(
        """SELECT n_name AS nation, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""",
        **tables,
    )
