"""Structured Streaming forms of the windowed operators; each runs until the input that is there is used up."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='touchline-')}"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all there is, into parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    job = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Rows less than `gap` apart; the end is the last row and the gap.

    session_window joins sessions that touch, so it gets a gap shorter by the least step of a timestamp.
    """
    w = events.withWatermark(time, late).groupBy(F.session_window(time, f"{gap} -1 microseconds"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("end"), *keys, "n")


def first_of_each(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def closed(stream: DataFrame, time: str) -> DataFrame:
    """The stream with one row far in the future, null but for its time; its own window stays open and is never emitted."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/closing-{uuid.uuid4().hex}"
    cells = [(F.timestamp_seconds(F.lit(4102444800)) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*cells).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def fold_links(rows: list[tuple], on: bool, run: int, switch_on: int, switch_off: int) -> tuple[list[tuple], bool, int]:
    """(switches, on, run) after rows of (place, proposed): on after `switch_on` proposals in a row, off after as many gaps."""
    out = []
    for at, proposed in rows:
        run = run + 1 if proposed != on else 0
        if run >= (switch_off if on else switch_on):
            on, run = not on, 0
            out.append((at, on))
    return out, on, run


def hysteresis(stream: DataFrame, keys: list[str], order: str, proposed: str, time: str, switch_on: int = 3, switch_off: int = 8, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(keys, order, is_on): the rows at which a key's link switches. State is two numbers a key.

    A key without rows for `idle` after the watermark is forgotten, so a later row starts it anew. Rows of a micro-batch
    are taken in their order.
    """
    types = dict(stream.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{order} {types[order]}", "is_on boolean"])
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        on, run = state.get if state.exists else (False, 0)
        out, on, run = fold_links(list(zip(rows[order].tolist(), rows[proposed].tolist(), strict=True)), on, run, switch_on, switch_off)
        state.update((on, run))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows[time].max().timestamp() * 1000)) + wait)
        yield pd.DataFrame([(*key, at, v) for at, v in out], columns=[*keys, order, "is_on"])

    marked = stream.withWatermark(time, late).select(*keys, order, proposed, time)
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, "on boolean, run int", "append", GroupStateTimeout.EventTimeTimeout)
