"""Queries that run as streams over the event table. A closing row far in the future lets the watermark pass every window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.registry import query
from touchline.sources.tables import seconds, table
from touchline.streaming import windows


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{sf_dir}/events.parquet"
    shape = table(spark, sf_dir, "events").schema
    found = [f for f in table(spark, sf_dir, "events").inputFiles()]
    folder, pattern = (sf_dir, "events.parquet") if len(found) == 1 and found[0].endswith("events.parquet") else (name, "*.parquet")
    e = spark.readStream.schema(shape).option("pathGlobFilter", pattern).parquet(folder)
    return e.withColumn("ts", F.timestamp_seconds(seconds(F.col("ts"))))


@query(""" SELECT t - t % 86400 AS start_t, state, count(*) AS n FROM ev GROUP BY 1, 2""")
def streamed_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by state."""
    w = windows.tumbling(windows.closed(event_stream(spark, sf_dir).withColumnRenamed("event_type", "state"), "ts"), "ts", "1 day", "0 seconds", ["state"], "value")
    return windows.run_available(w, "tumbling").select(F.unix_seconds("start").alias("start_t"), "state", "n")


@query(""", g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, id) < 21600 THEN 0 ELSE 1 END AS opens FROM ev),
 n AS (SELECT *, sum(opens) OVER (PARTITION BY u ORDER BY t, id) AS k FROM g) SELECT u, min(t) AS start_t, max(t) + 21600 AS end_t, count(*) AS n FROM n GROUP BY u, k""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an entity: rows less than six hours apart."""
    e = windows.closed(event_stream(spark, sf_dir).select(F.col("user_id").alias("u"), "ts"), "ts")
    w = windows.run_available(windows.sessions(e, "ts", "6 hours", "0 seconds", ["u"]), "sessions")
    return w.select("u", F.unix_seconds("start").alias("start_t"), F.unix_seconds("end").alias("end_t"), "n")


@query(""" SELECT event_id AS id, user_id AS u FROM events""")
def streamed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, kept once."""
    e, again = (event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), "ts") for _ in "12")
    return windows.run_available(windows.first_of_each(e.unionByName(again), "ts", "1 day", ["id"]), "first").select("id", "u")


@query()
def streamed_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an entity's link switches on and off; tested against a plain fold."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("u"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("proposed"), "ts")
    return windows.run_available(windows.hysteresis(e, ["u"], "at", "proposed", "ts"), "hysteresis")
