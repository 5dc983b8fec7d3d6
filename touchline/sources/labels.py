"""Ground-truth files of matches as tables: annotation, sequence and event JSON, one document a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOXES = "array<struct<object_class:string,track_id:bigint,bbox:array<double>>>"


def _documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, fps, frame_idx, object_class, track_id, x1, y1, x2, y2); a frame without objects has one row of nulls."""
    d = _documents(spark, path, f"video_id string, fps double, frames map<string, {_BOXES}>").where("frames is not null")
    frames = d.select("video_id", "fps", F.explode("frames").alias("frame", "objects"))
    rows = frames.select("video_id", "fps", F.col("frame").cast("int").alias("frame_idx"), F.explode_outer("objects").alias("o"))
    return rows.select("video_id", "fps", "frame_idx", "o.object_class", "o.track_id", *(F.get(F.col("o.bbox"), F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def write_annotations(rows: DataFrame, path: str) -> None:
    """read_annotations() rows as one JSON document a video, in lines; a document holds one video."""
    one = F.struct("object_class", "track_id", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    frames = rows.groupBy("video_id", "fps", "frame_idx").agg(F.array_sort(F.collect_list(F.when(F.col("object_class").isNotNull(), one))).alias("objects"))
    whole = frames.groupBy("video_id", "fps").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame_idx").cast("string"), "objects")))).alias("frames"))
    whole.repartition("video_id").write.mode("overwrite").json(path)


def summary(rows: DataFrame) -> DataFrame:
    """(video_id, n_frames, n_objects, n_tracks, and objects by class as a map) of read_annotations() rows."""
    by_class = rows.where("object_class is not null").groupBy("video_id", "object_class").agg(F.count("*").alias("n"))
    classes = by_class.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("object_class", "n")))).alias("by_class"))
    whole = rows.groupBy("video_id").agg(F.count_distinct("frame_idx").alias("n_frames"), F.count("object_class").alias("n_objects"), F.count_distinct("track_id").alias("n_tracks"))
    return whole.join(classes, "video_id", "left")


def read_sequence_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, fps, frame_idx, track_id, role, team, x1, y1, x2, y2, pitch_x, pitch_y) of sequence-label JSON.

    The frame is the number in its file's name; the sequence is the document's folder. Objects of unknown images are left
    out.
    """
    image = "array<struct<image_id:string,file_name:string>>"
    box, pitch = "struct<x:double,y:double,w:double,h:double>", "struct<x_bottom_middle:double,y_bottom_middle:double>"
    note = f"array<struct<image_id:string,track_id:bigint,attributes:struct<role:string,team:string>,bbox_image:{box},bbox_pitch:{pitch}>>"
    d = _documents(spark, path, f"info struct<frame_rate:double>, images {image}, annotations {note}").withColumn("sequence", F.element_at(F.split(F.input_file_name(), "/"), -2))
    frames = d.select("sequence", F.explode("images").alias("i")).select("sequence", "i.image_id", F.regexp_extract("i.file_name", r"([0-9]+)\D*$", 1).try_cast("int").alias("frame_idx"))
    notes = d.select("sequence", F.col("info.frame_rate").alias("fps"), F.explode("annotations").alias("a"))
    b = F.col("a.bbox_image")
    rows = notes.select(
        "sequence", "fps", "a.image_id", "a.track_id", "a.attributes.role", F.coalesce("a.attributes.team", F.lit("unknown")).alias("team"), b["x"].alias("x1"), b["y"].alias("y1"),
        (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"), F.col("a.bbox_pitch.x_bottom_middle").alias("pitch_x"), F.col("a.bbox_pitch.y_bottom_middle").alias("pitch_y"),
    )
    return rows.join(frames, ["sequence", "image_id"]).drop("image_id")


#: Event labels of action files and the event types they stand for; a goal can't be scored, others are unknown. Fixed values.
ACTIONS = {
    "PASS": "pass_start", "HIGH PASS": "pass_start", "CROSS": "cross", "SHOT": "shot", "OUT": "ball_out", "THROW IN": "restart", "FREE KICK": "restart", "DRIVE": "carry_start",
    "HEADER": "header", "BALL PLAYER BLOCK": "interception", "PLAYER SUCCESSFUL TACKLE": "turnover", "GOAL": "ambiguous",
}


def read_actions(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(path, label, event_type, half, t, team, visibility): action JSON; positions are milliseconds, the type of other labels is `unknown`."""
    note = "array<struct<gameTime:string,position:string,label:string,team:string,visibility:string>>"
    d = _documents(spark, path, f"annotations {note}").select(F.input_file_name().alias("path"), F.explode("annotations").alias("a"))
    pairs = [F.lit(x) for kv in (kinds or ACTIONS).items() for x in kv]
    named: Column = F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim("a.label"))), F.lit("unknown"))
    half = F.regexp_extract("a.gameTime", r"^\s*([0-9]+)", 1).try_cast("int")
    return d.select("path", "a.label", named.alias("event_type"), half.alias("half"), (F.col("a.position").try_cast("double") / 1000).alias("t"), F.lower("a.team").alias("team"), F.lower("a.visibility").alias("visibility"))
