"""Shared helpers: table access, materialisation in the shared folder, word fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = f"file://{tempfile.mkdtemp(prefix='touchline-')}"
    return shared_dir.own


#: Bytes of an Arrow batch while a table is written. A task holds a few copies of a batch on both sides, outside the heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    try:
        if int(before.rstrip("bB")) > BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores at its end until no column of a table is called so, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if more than this part of all rows, and more than 1,000 rows, have it; so at most this many keys are hot.
HOT_PART = 1000


def hot_bar(rows: int) -> int:
    """Number of rows above which a key of a table of `rows` rows is hot; at most HOT_PART keys can be."""
    return max(1000, rows // HOT_PART)


def hot_keys(many: DataFrame, key: str, rows: int) -> DataFrame:
    """The hot keys of many, HOT_PART at most, one row each; counted with a partial aggregation before the shuffle."""
    return many.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_bar(rows)).select(key)


def split_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """many inner-joined with `one`, which has one narrow row for each key.

    Rows of hot keys stay where they are and meet a broadcast of these keys' rows, at most HOT_PART; the others are
    shuffled. Both inputs are read more than once, so they should be written tables.
    """
    few = one.join(F.broadcast(hot), key, "left_semi")
    cold = many.join(F.broadcast(hot), key, "left_anti")
    return many.join(F.broadcast(few), key).unionByName(cold.join(one, key))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(256, dtype=np.uint64) * _GOLDEN + np.uint64(1))
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_PLACE = mix(np.arange(1 << 12, dtype=np.uint64) + _GOLDEN) | np.uint64(1)


def _slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; one row at least."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word fingerprints, word offsets by row) for runs of rows; words are runs of anything but space and \\x09-\\x0D, A-Z lower-cased; nulls have none.

    A word's fingerprint is the sum over its bytes of one random number for the byte times one for the place, and then mixed:
    two different words have the same one with a chance of about 2**-64.
    """
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32  # no copy of the texts
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for first, last in _slices(offsets, size):
        ends = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        word = ~_SPACE[raw]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        at = ends[:-1][ends[:-1] < len(raw)]
        opens[at] = word[at]
        starts = np.flatnonzero(opens)
        if len(starts):
            place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
            if int(place.max()) < len(_PLACE):
                weight = _PLACE[place]
            else:
                weight = mix(place.astype(np.uint64) + _GOLDEN) | np.uint64(1)
            hashes = mix(np.add.reduceat(_BYTE[raw[starts[0] :]] * weight, starts - starts[0]))
        else:
            hashes = np.empty(0, np.uint64)
        yield first, hashes, np.searchsorted(starts, ends)


def shingle_slices(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, fingerprints, offsets by row): each row's distinct k-word shingles, sorted.

    A text of fewer words is one shingle, one without words has none.
    """
    for first, h, at in word_slices(texts):
        n = np.diff(at)
        kept = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        to = np.concatenate([[0], np.cumsum(kept)])
        rolled = np.full(max(0, len(h) - k + 1), k, np.uint64)
        for j in range(k):
            rolled = mix(rolled * _GOLDEN + h[j : len(h) - k + 1 + j])
        out = np.empty(to[-1], np.uint64)
        for i in np.flatnonzero(n):
            part = out[to[i] : to[i + 1]]
            if n[i] >= k:
                part[:] = rolled[at[i] : at[i] + kept[i]]
                part.sort()
            else:
                whole = np.full(1, n[i], np.uint64)
                for x in h[at[i] : at[i + 1]]:
                    whole = mix(whole * _GOLDEN + x)
                part[:] = whole
        fresh = np.ones(len(out), bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[to[:-1][kept > 0]] = True
        sizes = np.add.reduceat(np.append(fresh, False).astype(np.int64), to[:-1]) * (kept > 0)
        yield first, out[fresh], np.concatenate([[0], np.cumsum(sizes)])
