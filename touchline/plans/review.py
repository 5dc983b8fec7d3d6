"""Queries of the measuring side: splits, leakage, corrections, review queues, gates, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import expr
from touchline.operators import joins
from touchline.operators.ordered import quantiles
from touchline.plans.registry import query
from touchline.sources.tables import states, table

r = lambda c, n=4: F.round(c, n)


@query(""", f AS (SELECT o_orderkey AS id, CAST(concat('0x', substr(sha256(concat('7/', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 AS x FROM orders)
 SELECT id, CASE WHEN x < 0.55 THEN 'train' WHEN x < 0.75 THEN 'valid' ELSE 'test' END AS split FROM f""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that depends only on the key and the seed."""
    x = expr.hash_fraction(F.lit("7"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(x < 0.55, "train").when(x < 0.75, "valid").otherwise("test").alias("split"))


@query(""", f AS (SELECT o_custkey, CAST(concat('0x', substr(sha256(concat('7/', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 AS x FROM orders),
 s AS (SELECT o_custkey, CASE WHEN x < 0.55 THEN 'train' WHEN x < 0.75 THEN 'valid' ELSE 'test' END AS split FROM f)
 SELECT o_custkey AS grp, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY o_custkey HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a split by row would tear apart."""
    s = hash_split(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp")), "id")
    return s.groupBy("grp").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query(""" SELECT conv_id, turn, role, length(coalesce(text, '')) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    return joins.latest(c, ["conv_id"], ["turn", "role"])


@query(""", l AS (SELECT u, id, t, state, v FROM ev WHERE state = 'error' QUALIFY row_number() OVER (PARTITION BY u ORDER BY t DESC, id DESC) = 1)
 SELECT p.s_suppkey AS id, coalesce(CAST(l.v AS DOUBLE), p.s_acctbal) AS value, p.s_acctbal AS raw, CASE WHEN l.u IS NULL THEN 'unreviewed' WHEN l.v > 100 THEN 'rejected' ELSE 'corrected' END AS status
 FROM supplier p LEFT JOIN l ON l.u = p.s_suppkey""")
def corrected_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their latest correction laid over; the raw value stays beside it."""
    last = joins.latest(states(spark, sf_dir).where("state = 'error'"), ["u"], ["t", "id"]).select(F.col("u").alias("id"), "v")
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("raw"))
    status = F.when(F.col("v").isNull(), "unreviewed").when(F.col("v") > 100, "rejected").otherwise("corrected")
    return p.join(last, "id", "left").select("id", F.coalesce("v", "raw").alias("value"), "raw", status.alias("status"))


@query(""" SELECT u, id, state, v FROM ev WHERE state <> 'view' ORDER BY (state = 'click'), v, t, id LIMIT 100""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred events most in need of a look: unreviewed first, then least confidence."""
    return states(spark, sf_dir).where("state <> 'view'").orderBy(F.col("state") == "click", "v", "t", "id").limit(100).select("u", "id", "state", "v")


@query(""", q AS (SELECT state, greatest(0, (count(*) * 15 + 99) // 100 - count_if(v >= 100)) AS deficit FROM ev GROUP BY state), k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY v DESC, id) AS n FROM ev WHERE v < 100)
 SELECT k.state, id, CAST(n AS BIGINT) AS place FROM k JOIN q ON k.state = q.state WHERE n <= deficit""")
def quota_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category as many candidates as its quota, 15 in a hundred, still lacks, the best first."""
    e = states(spark, sf_dir)
    q = e.groupBy("state").agg(F.greatest(F.lit(0), F.floor((F.count("*") * 15 + 99) / 100) - F.count_if(F.col("v") >= 100)).alias("deficit"))
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("v"), "id"))
    return e.where("v < 100").withColumn("place", place.cast("long")).join(F.broadcast(q), "state").where("place <= deficit").select("state", "id", "place")


@query(""" SELECT round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.6), 4) AS p60, round(quantile_cont(v, 0.85), 4) AS p85, round(quantile_cont(v, 0.9), 4) AS p90 FROM ev WHERE state <> 'error'""")
def sampling_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a whole table, searched by counts in ranges; no task holds all values."""
    shares = {"p10": 0.1, "p60": 0.6, "p85": 0.85, "p90": 0.9}
    q = quantiles(states(spark, sf_dir).where("state <> 'error'"), [], "v", list(shares.values()))
    return q.agg(*(r(F.max(F.when(F.abs(F.col("share") - s) < 1e-9, F.col("quantile")))).alias(c) for c, s in shares.items()))


@query(""", g AS (SELECT u, list_filter([CASE WHEN row_number() OVER w % 3 = 1 THEN 'stride' END, CASE WHEN state IS DISTINCT FROM lag(state) OVER w THEN 'transition' END, CASE WHEN v > 90 THEN 'hard' END], lambda x: x IS NOT NULL) AS f, id
   FROM ev WINDOW w AS (PARTITION BY u ORDER BY t, id)) SELECT u, id, array_to_string(f, ',') AS reasons FROM g WHERE len(f) > 0""")
def sampling_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row is picked, all reasons that hold."""
    w = Window.partitionBy("u").orderBy("t", "id")
    picks = {"stride": F.row_number().over(w) % 3 == 1, "transition": ~F.col("state").eqNullSafe(F.lag("state").over(w)), "hard": F.col("v") > 90}
    out = states(spark, sf_dir).select("u", "id", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in picks.items()))).alias("f"))
    return out.where(F.size("f") > 0).select("u", "id", F.array_join("f", ",").alias("reasons"))


@query(""", a AS (SELECT doc_id, toxic AS truth FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS said FROM documents)
 SELECT coalesce(CAST(truth AS VARCHAR), 'unknown') AS truth, coalesce(CAST(said AS VARCHAR), 'unknown') AS said, count(*) AS n FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id GROUP BY 1, 2""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference against prediction over the union of their keys; a missing side counts as unknown."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("truth"))
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("said"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return a.join(b, "doc_id", "full_outer").groupBy(name("truth"), name("said")).agg(F.count("*").alias("n"))


@query(""", m AS (SELECT p_size % 5 AS domain, avg(p_retailprice) AS candidate, median(p_retailprice) AS incumbent, count(*) AS n FROM part GROUP BY 1)
 SELECT domain, coalesce(candidate >= incumbent - 5, false) AS recall_gate, n >= 50 AS size_gate, coalesce(candidate >= incumbent - 5, false) AND n >= 50 AS passed FROM m""")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates must pass; what wasn't measured fails."""
    m = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("domain")).agg(
        F.avg("p_retailprice").alias("candidate"), F.median("p_retailprice").alias("incumbent"), F.count("*").alias("n")
    )
    good, large = F.coalesce(F.col("candidate") >= F.col("incumbent") - 5, F.lit(False)), F.col("n") >= 50
    return m.select("domain", good.alias("recall_gate"), large.alias("size_gate"), (good & large).alias("passed"))


@query(""" SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure out of the JSON evidence column."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k int").getField("k").alias("k"))


@query(""" SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'Referee' WHEN s_suppkey % 3 = 0 THEN concat('#', CAST(s_suppkey % 99 + 1 AS VARCHAR)) ELSE concat('Player ', lpad(CAST(s_suppkey AS VARCHAR), 3, '0')) END AS display_name FROM supplier""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name from role, then number, then the padded track; a number is never made up."""
    k = F.col("s_suppkey")
    name = F.when(F.col("s_nationkey") % 5 == 0, "Referee").when(k % 3 == 0, F.concat(F.lit("#"), (k % 99 + 1).cast("string"))).otherwise(F.concat(F.lit("Player "), F.lpad(k.cast("string"), 3, "0")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("display_name"))
