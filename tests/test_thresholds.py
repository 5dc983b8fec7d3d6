"""Rows that meet a threshold exactly, which larger tables have and the smallest do not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from touchline.operators import association, match_events
from touchline.plans import entities, streams


def _events(path, rows):
    """(event_id, user_id, seconds, event_type) as the event table of a folder; a row's value is its id."""
    e = pd.DataFrame(rows, columns=["event_id", "user_id", "t", "event_type"])
    e["ts"], e["value"] = pd.to_datetime(1704067200 + e.pop("t"), unit="s").astype("datetime64[us]"), e["event_id"].astype(float)
    e.to_parquet(f"{path}/events.parquet")
    return str(path)


def test_a_pass_of_exactly_the_least_length_is_a_pass(spark):
    names = "video long, span long, state string, team_id string, track_id long, start_frame long, end_frame long, start_t double, end_t double, duration double, confidence double, start_x double, start_y double, end_x double, end_y double"
    spans = spark.createDataFrame([(1, 0, "controlled", "A", 3, 1, 2, 0.0, 1.0, 1.0, 0.9, 0.1, 0.0, 0.1, 0.0), (1, 1, "controlled", "A", 5, 3, 4, 2.0, 3.0, 1.0, 0.8, 1.9, 2.4, 1.9, 2.4)], names)
    ball = spark.createDataFrame([(1, f, "observed") for f in range(1, 5)], "video long, frame_idx long, state string")
    found = match_events.pass_and_turnover(spans, ball, spark.createDataFrame([(1, "A", 0), (1, "B", 0)], "video long, team_id string, direction int"))
    assert sorted(r.event_type for r in found.collect()) == ["pass", "pass_successful"]


def test_a_pair_of_tracklets_is_refused_beyond_the_limit_of_the_root_of_squares(spark):
    ends = "video long, track_id long, object_class string, frame long, cx double, cy double, height double, px double, py double"
    rows = [(1, 1, "player", 5, 0.0, 0.0, 60.0, 0.1, 0.0), (1, 2, "player", 8, 0.0, 0.0, 60.0, 1.9, 2.4)]
    tracks = association.features(spark.createDataFrame(rows, ends), ["video"])
    # The root of the sum of squares is 3.0, what hypot gives is one step below and would be admitted.
    for slack, refused in ((2.9999999999999996, "pitch_distance_exceeded"), (3.0, None)):
        pairs = association.pair_costs(tracks, ["video"], None, association.Rules(max_speed_m_s=0.0, slack_m=slack))
        assert [(r.earlier, r.later, r.refused) for r in pairs.collect()] == [(1, 2, refused)]


def test_streamed_sessions_end_where_the_next_row_is_exactly_the_gap_away(spark, tmp_path):
    rows = [(0, 7, 0, "view"), (1, 7, 21599, "view"), (2, 7, 21599 + 21600, "view"), (3, 8, 5, "view")]
    found = sorted((r.u, r.start_t - 1704067200, r.end_t - 1704067200, r.n) for r in streams.streamed_sessions(spark, _events(tmp_path, rows)).collect())
    assert found == [(7, 0, 43199, 2), (7, 43199, 64799, 1), (8, 5, 21605, 1)]


def test_purchases_of_one_second_come_as_often_as_the_sql_joins_them(spark, tmp_path):
    import duckdb

    from touchline.plans import registry

    rows = [(0, 7, 10, "purchase"), (1, 7, 10, "purchase"), (2, 7, 40, "error"), (3, 7, 90, "purchase"), (4, 8, 10, "purchase"), (5, 8, 10, "purchase")]
    where = _events(tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{where}/events.parquet')")
    want = con.execute(registry.oracle_sql()["nearest_event"]).fetchall()
    found = [tuple(r) for r in entities.nearest_event(spark, where).select("u", "id", F.col("nearest").cast("double")).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert len(found) == 7
