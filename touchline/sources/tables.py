"""Table sources and sinks: declared schemas, checked casts, parquet and JSON, and views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column lists of the canonical tables; `!` marks columns that are never null. Fixed values.
SCHEMAS = {
    "detections": "video_id string!, frame_idx int!, timestamp_s double!, object_class string!, bbox_x1 float!, bbox_y1 float!, bbox_x2 float!, bbox_y2 float!, "
    "confidence float!, source string!",
    "frames": "video_id string!, frame_idx int!, timestamp_s double!, n_persons int!, n_ball_rows int!, ball_observed boolean!, calibration_confidence float!, "
    "calibration_valid boolean!, calibration_propagated boolean!, segment_kind string!, chunk_index int",
    "tracks": "video_id string!, track_id int!, object_class string!, first_frame int!, last_frame int!, n_observations int!, team_id string!, "
    "team_confidence float!, role string!, role_confidence float!, jersey_number int, jersey_confidence float!, display_name string!",
    "calibration": "video_id string!, frame_idx int!, timestamp_s double!, homography array<double>, confidence float!, reprojection_error_m float!, n_keypoints int!, n_inliers int!, "
    "smoothed boolean!, segment_kind string!",
    "game_state": "video_id string!, frame_idx int!, timestamp_s double!, match_clock_s double, object_class string!, track_id int, team_id string!, role string!, jersey_number int, "
    "jersey_confidence float!, bbox_x1 float!, bbox_y1 float!, bbox_x2 float!, bbox_y2 float!, image_x float!, image_y float!, pitch_x float, pitch_y float, pitch_x_norm float, pitch_y_norm float, "
    "detection_confidence float!, tracking_confidence float!, team_confidence float!, calibration_confidence float!, interpolated boolean!, validation_status string!, segment_kind string!, source string!",
    "possession": "start_frame int!, end_frame int!, start_time_s double!, end_time_s double!, duration_s double!, state string!, team_id string!, "
    "track_id int, player_name string!, confidence float!, ball_coverage float!",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name].replace("!", " not null"))


def conform(df: DataFrame, name: str) -> DataFrame:
    """df cast to a canonical table: missing nullable columns are null, a null in a required one stops the query and is named."""
    out = []
    for field in schema(name).fields:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name}.{field.name} is null")).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


#: Version of the canonical tables; readers refuse another first number.
VERSION = "1.0.0"


def write_table(df: DataFrame, name: str, path: str, partition_by: tuple[str, ...] = ("video_id",), rows_per_file: int = 5_000_000, form: str = "parquet") -> None:
    """Canonical table as zstd parquet or gzipped JSON lines, partitioned where it has the columns, files of bounded length.

    The version of the tables goes into the metadata of every parquet column.
    """
    df = conform(df, name)
    keys = [c for c in partition_by if c in df.columns]
    if form == "parquet":
        df = df.select(*(F.col(c).alias(c, metadata={"table_version": VERSION}) for c in df.columns))
    writer = df.write.mode("overwrite").option("compression", "zstd" if form == "parquet" else "gzip").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).format(form).save(path)


def read_table(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    """A canonical table read back under its declared schema; parquet of another main version, or without one, stops with an error."""
    if form == "parquet":
        found = {f.metadata.get("table_version") for f in spark.read.parquet(path).schema if f.name != "video_id"}  # folders keep no metadata
        if {str(v).split(".")[0] for v in found} != {VERSION.split(".")[0]}:
            raise ValueError(f"{path} has table version {sorted(map(str, found))}, not {VERSION}")
    return spark.read.format(form).schema(schema(name)).load(path)


def homographies(calibration: DataFrame) -> DataFrame:
    """Canonical calibration rows with `valid`: whether a frame has a homography; one that hasn't nine entries stops the query."""
    h = F.col("homography")
    checked = F.when(h.isNull() | (F.size(h) == 0), None).when(F.size(h) == 9, h).otherwise(F.raise_error(F.lit("a homography has not nine entries")).cast("array<double>"))
    return calibration.withColumn("homography", checked).withColumn("valid", F.col("homography").isNotNull())


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines under a declared schema; broken lines come out in `_corrupt_record`."""
    return spark.read.schema(f"{ddl}, _corrupt_record string").json(path)


def read_box_labels(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Normalised `class cx cy w h` text lines (column value) as pixel corner boxes; degenerate boxes are left out."""
    part = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    cx, cy, w, h = (num(i) for i in (2, 3, 4, 5))
    boxes = lines.select(
        F.try_element_at(part, F.lit(1)).try_cast("int").alias("class_id"),
        ((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2"),
    )
    return boxes.where("class_id is not null and x2 > x1 and y2 > y1")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as entity states: u, id, t, state, v."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("t"), F.col("event_type").alias("state"), F.col("value").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as objects in frames: frame, id, x1, y1, x2, y2, score, label. An order is a frame, its lines the objects."""
    l = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey") % 89
    return l.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("label"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )
