"""The online tracker as a stateful stream: a video's live tracks are its state, frames are taken once the watermark has passed them."""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from touchline.operators.tracker import TYPES, Settings, Tracks, stretches

#: The state store that keeps timers and large values on disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with STORE while a stream is started."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Frames whose waiting rows are kept together, and rows that are gathered before they are put there.
STRETCH, GATHERED = 16, 1 << 18


class OnlineTracker(StatefulProcessor):
    """State of a video: its live tracks, the rows whose frame the watermark hasn't passed, and the time of its last row.

    Rows wait for the watermark, so how the input is cut into micro-batches, and a restart between them, changes nothing. They
    wait in the state store, stretch of frames by stretch, and are taken in that order: a task holds one stretch, the live tracks
    and some ROWS of the result, however many rows a video has waiting.
    A timer after the last waiting row lets them pass when no later row of the video comes, one `idle` later forgets the video.
    Timers that newer ones have overtaken find nothing ripe.
    """

    def __init__(self, by: str, time: str, settings: Settings, idle_ms: int):
        self.by, self.time, self.settings, self.idle_ms = by, time, settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("tracks", "state binary, parts long, last long")
        #: A part's rows; its key says which frames and times they have.
        self.waiting = handle.getMapState("waiting", "stretch long, part long, opens long, last long", "rows binary")

    def _wait(self, rows: pd.DataFrame, part: int) -> int:
        """Put rows (frame, __ms and so on) into the store, a part for each stretch of frames; returns the next part's number."""
        stretch = np.floor_divide(rows["frame"].to_numpy(np.int64), STRETCH)
        order = np.argsort(stretch, kind="stable")
        stretch, ms = stretch[order], rows["__ms"].to_numpy(np.int64)[order]
        columns = {c: rows[c].to_numpy()[order] for c in rows.columns}
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False) if len(rows) else ():
            self.waiting.updateValue((int(stretch[a]), part, int(ms[a:b].min()), int(ms[a:b].max())), (pickle.dumps({c: v[a:b] for c, v in columns.items()}),))
            part += 1
        return part

    def _pass(self, key: tuple, tracks: Tracks, part: int, last: int, watermark: int) -> Iterator[pd.DataFrame]:
        keys = sorted(self.waiting.keys())
        ripe = {k[0] for k in keys if k[2] <= watermark}
        latest = max((k[3] for k in keys if k[0] not in ripe), default=None)
        stretch: list[tuple] = []
        for at, k in enumerate(keys):
            if k[0] not in ripe:
                continue
            stretch.append(k)
            if at + 1 < len(keys) and keys[at + 1][0] == k[0]:
                continue
            rows = pd.concat([pd.DataFrame(pickle.loads(self.waiting.getValue(k)[0])) for k in stretch], ignore_index=True)
            for k in stretch:
                self.waiting.removeKey(k)
            stretch = []
            # A frame is taken whole: its first row's time decides.
            now = rows.groupby("frame")["__ms"].transform("min") <= watermark
            for out in stretches(tracks, rows[now], self.settings):
                out.insert(0, self.by, [key[0]] * len(out))
                yield out
            if not now.all():
                part = self._wait(rows[~now], part)
                latest = max(latest or 0, int(rows["__ms"][~now].max()))
        if latest is None and last + self.idle_ms <= watermark:
            self.held.clear()
            return
        self.held.update((pickle.dumps(tracks), part, last))
        self.handle.registerTimer(latest + 1 if latest is not None else last + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # such rows, unlike filtered ones, still move the watermark
            return
        state, part, last = self.held.get() if self.held.exists() else (None, 0, 0)
        gathered: list[pd.DataFrame] = []
        for fresh in rows:
            ms = fresh[self.time].astype("int64") // (10**6 if str(fresh[self.time].dtype).startswith("datetime64[ns") else 10**3)
            last = max(last, int(ms.max()))
            gathered.append(fresh.assign(__ms=ms).drop(columns=[self.time, self.by])[fresh["frame"].notna()])
            if sum(map(len, gathered)) >= GATHERED:
                part, gathered = self._wait(pd.concat(gathered), part), []
        if gathered:
            part = self._wait(pd.concat(gathered), part)
        yield from self._pass(key, Tracks() if state is None else pickle.loads(state), part, last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            state, part, last = self.held.get()
            yield from self._pass(key, pickle.loads(state), part, last, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def online_tracks(detections: DataFrame, by: str, time: str, late: str = "0 seconds", idle: str = "1 hour", settings: Settings = Settings()) -> DataFrame:
    """(by, observations) as a stream. detections: by, time, frame, corners, score, object_class; frames rise with time.

    Rows later than the watermark allows are dropped, as are rows of frames that have been taken and rows without a video. The session needs the
    state store of STORE. Observations come out at a sighting, with the predicted ones since the one before.
    """
    types = dict(detections.dtypes)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = [c for c in (by, time, "frame", "x1", "y1", "x2", "y2", "score", "object_class", "look", "warp") if c in detections.columns]
    stream = detections.withWatermark(time, late).select(*columns)
    schema = StructType.fromDDL(f"{by} {types[by]}, {TYPES}")
    return stream.groupBy(by).transformWithStateInPandas(OnlineTracker(by, time, settings, wait), schema, "Append", "EventTime")
