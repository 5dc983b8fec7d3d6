"""Line deduplication by range-partitioned line hashes, decided in one streaming pass and returned as keep bitmaps.

A line's key is hashed to 128 bits. Lines are range-partitioned and sorted by (hash, document, position), so a frequent line
spreads over as many partitions as its rows need. A task streams its rows: a hash found in enough documents loses its lines
(all of them, or all but the first occurrence) as soon as that is known, and only dropped positions leave the task. Of the
two hashes at a partition's edges a summary leaves it too, and rows that these alone can decide; their totals are summed
afterwards. Texts are read once to be hashed and once to apply a bitmap, and never take part in the sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialise

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
#: Columns by which lines are sorted: hash, document, position.
ORDER = ["h1", "h2", "d", "k", "pos"]
#: What a task says of a row: it is dropped; its hash's total decides; it leads its hash's rows in the task; a summary.
DROPPED, OPEN, LEAD, SUMMARY = range(4)
_FIELDS = ("h1", "h2", "d", "k", "pos", "kind", "last_d", "last_k", "docs", "head_docs")
_MARK = "h1 long, h2 long, d long, k long, pos int, kind int, last_d long, last_k long, docs long, head_docs long"
_ROWS = 100_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (empty if null) and the document's key: d and k stand for the id and the text. Other columns are left behind."""
    text, number = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(0)).alias("d"), F.xxhash64(text, number.isNull()).alias("k"), text.alias("text"))


def _hash_lines(least: int):
    """(h1, h2, d, k, pos) for every line whose key has `least` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        places: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if digests:
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                d, k, pos = (np.array(c) for c in zip(*places, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[:, 0], h[:, 1], d, k, pos.astype(np.int32))], ORDER)
                digests.clear()
                places.clear()

        for batch in batches:
            for d, k, text in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text")), strict=True):
                for pos, line in enumerate(text.translate(_LOWER).split(b"\n")):
                    key = line.strip(_SPACE)
                    if len(key) >= least and (least <= 1 or len(key.decode()) >= least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append((d, k, pos))
                if len(digests) >= _ROWS:
                    yield from flush()
        yield from flush()

    return run


def _batch(kind: int, rows: np.ndarray, more: tuple = (0, 0, 0, 0)) -> pa.RecordBatch:
    n = len(rows)
    arrays = [pa.array(rows[:, i]) for i in range(4)] + [pa.array(rows[:, 4].astype(np.int32)), pa.array(np.full(n, kind, np.int32))]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(np.full(n, x, np.int64)) for x in more], list(_FIELDS))


class _Run:
    """The rows of one hash in a task, as far as they have been read."""

    def __init__(self, head: np.ndarray, edge: bool):
        self.head, self.edge, self.last = head, edge, head
        self.docs = self.head_docs = 0
        self.first = None  # the place where the current document opened
        self.one_doc = True
        self.waiting: list[np.ndarray] = []

    def take(self, rows: np.ndarray, min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
        """rows: further rows of this hash. Rows wait only until min_docs documents are known."""
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, 2:4] != rows[:-1, 2:4]).any(1)
        fresh[0] = self.first is None or (rows[0, 2:4] != self.last[2:4]).any()
        # A document counts once, or as often as rows repeat both its id and text: then its first place repeats.
        opened = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), -1))
        place = np.where(opened >= 0, rows[opened, 4], self.first if self.first is not None else 0)
        counts = rows[:, 4] == place
        if self.one_doc:
            others = np.flatnonzero(fresh[1:] if self.first is None else fresh)
            upto = len(rows) if not len(others) else int(others[0]) + (1 if self.first is None else 0)
            self.head_docs += int(counts[:upto].sum())
            self.one_doc = not len(others)
        # The leading row stays; a row that repeats its document stands for the same line.
        rows_left = rows[(rows[:, 2:5] != self.head[2:5]).any(1)] if keep_first else rows
        self.docs += int(counts.sum())
        self.first, self.last = int(place[-1]), rows[-1]
        if self.docs >= min_docs:
            for part in (*self.waiting, rows_left):
                if len(part):
                    yield _batch(DROPPED, part)
            self.waiting = []
        elif len(rows_left):
            self.waiting.append(rows_left)

    def close(self, edge: bool, keep_first: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or edge:
            if keep_first:
                yield _batch(LEAD, self.head[None])
            for part in self.waiting:
                yield _batch(OPEN, part)
            yield _batch(SUMMARY, self.head[None], (self.last[2], self.last[3], self.docs, self.head_docs))


def _decide(min_docs: int, keep_first: bool):
    """Stream a task's sorted lines. Runs inside are decided; of the first and the last one the summary goes on.

    Whole runs of a batch are counted at once; a run that a batch's end cuts is carried as a _Run, whose rows wait in
    memory while fewer than min_docs documents hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Run | None = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(rows))
            # Most hashes are found once: of the inner runs only those long enough to lose a line are looked at one by one.
            long = ends - starts >= max(min_docs, 2 if keep_first else 1)
            long[0] = long[-1] = True
            for a, b in zip(starts[long], ends[long], strict=True):
                if current is not None and a == 0 and (rows[0, :2] == current.head[:2]).all():
                    yield from current.take(rows[a:b], min_docs, keep_first)
                    continue
                if current is not None:
                    yield from current.close(False, keep_first)
                current = _Run(rows[a], edge=current is None)
                yield from current.take(rows[a:b], min_docs, keep_first)
        if current is not None:
            yield from current.close(True, keep_first)

    return run


def _dropped(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(d, k, at): the sorted positions that each document loses; documents that lose none are not there."""
    lines = docs.select("d", "k", F.col("text").cast("binary").alias("text")).mapInArrow(_hash_lines(min_chars), "h1 long, h2 long, d long, k long, pos int")
    marks = materialise(lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_decide(min_docs, keep_first), _MARK), "line-marks")
    # At most two summaries a task: a hash's are in the order of its rows, and a document cut in two counts in the earlier one.
    w = Window.partitionBy("h1", "h2").orderBy("d", "k", "pos")
    cut = (F.lag("last_d").over(w) == F.col("d")) & (F.lag("last_k").over(w) == F.col("k"))
    parts = marks.where(F.col("kind") == SUMMARY).withColumn("mine", F.col("docs") - F.when(cut, F.col("head_docs")).otherwise(0))
    totals = parts.groupBy("h1", "h2").agg(F.sum("mine").alias("total"), F.min(F.struct("d", "k", "pos")).alias("earliest"))
    edges = marks.where(F.col("kind").isin(OPEN, LEAD)).join(totals.where(F.col("total") >= min_docs), ["h1", "h2"])
    edges = edges.where((F.col("kind") == OPEN) | (F.struct("d", "k", "pos") != F.col("earliest")))
    gone = marks.where(F.col("kind") == DROPPED).select("d", "k", "pos").unionByName(edges.select("d", "k", "pos"))
    return gone.groupBy("d", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def pack_bits(n_lines: int, gone: list[int] | None) -> bytes:
    """The keep bitmap of a document, bit i standing for line i from the high end, deflated."""
    bits = np.ones(n_lines, np.uint8)
    bits[gone or []] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) for every row of docs; no text comes out.

    Texts are split at \\n; null and empty ones are one empty line. A line's key is the line without [\\x20\\x09-\\x0D] at its
    ends and with A-Z lower-cased; keys under min_chars code points are left alone. A key found in min_docs documents or
    more loses its lines in every document, or with keep_first all but the first by doc_id (null as 0), text_key and
    position. Rows are documents, also where they repeat an id; rows that repeat both id and text count each and share one
    bitmap. Hashes of 128 bits stand for keys. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _keyed(docs, id_col, text_col)
    narrow = rows.select("doc_id", "d", "k", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_pylist()
            keep = [pack_bits(n, gone) for n, gone in zip(b.column("n_lines").to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), b.column("n_lines"), pa.array([len(g or ()) for g in at], pa.int64()), pa.array(keep, pa.binary())],
                ["doc_id", "text_key", "n_lines", "n_dropped", "keep"],
            )

    joined = narrow.join(_dropped(rows, min_docs, min_chars, keep_first), ["d", "k"], "left").select("doc_id", "k", "n_lines", "at")
    return joined.mapInArrow(pack, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row's text without the lines that its bitmap leaves out, joined by \\n.

    Only bitmaps that leave out something are joined; the planner broadcasts them while they are small.
    """
    some = bitmaps.where("n_dropped > 0").select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_key").alias("k"), "keep").dropDuplicates(["d", "k"])
    rows = _keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).join(some, ["d", "k"], "left").select("doc_id", "text", "keep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, lost, kept = [], [], []
            for text, keep in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                total.append(n)
                if keep is not None:
                    bits = unpack_bits(keep, n)
                    lost.append(n - int(bits.sum()))
                    text = b"\n".join([line for line, stays in zip(text.split(b"\n"), bits.tolist(), strict=True) if stays])
                else:
                    lost.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept binary").withColumn("kept", F.col("kept").cast("string"))
