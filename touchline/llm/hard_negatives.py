"""Hard-negative mining over a vector-approximation file.

Every dimension is cut into cells, between quantiles of a bounded sample and, at the ends, the extremes of all rows. The file
holds a row's cell in each dimension, a byte. An anchor's tables give, for each dimension and cell, the least and the largest
product its component can have with a value in the cell; their sums over a row's cells bound its score from below and above.
Only rows whose bounds admit a place among the first ones, or in a window that isn't full of better ones, are scored
exactly. Rows never move: blocks of them meet anchors that are broadcast in chunks of bounded size, and only a task's best
leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialise


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies between these shares, in hundredths, of the positive's.
    low: int = 50
    high: int = 95
    #: A component x becomes floor(scale * x).
    scale: int = 256
    #: Cells of a dimension, 256 at most.
    cells: int = 64
    #: Rows, by the least hash of their id, whose quantiles place the cells; a documented bound. Bounds hold for every row.
    sample: int = 20_000
    #: Rows of a block, and about the most rows of a task.
    block: int = 4096
    task: int = 524_288
    #: Anchors that are broadcast together, about; and those whose bounds are summed together.
    chunk: int = 16_384
    together: int = 64


@dataclass(frozen=True)
class Cells:
    low: np.ndarray  # dimension, cell: least value in it
    high: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, least: np.ndarray, largest: np.ndarray, cells: int) -> Cells:
        inner = np.ceil(np.quantile(sample, np.arange(1, cells) / cells, axis=0)).astype(np.int64).T
        low = np.concatenate([least[:, None], np.clip(inner, least[:, None], None)], axis=1)
        high = np.concatenate([low[:, 1:] - 1, largest[:, None]], axis=1)
        return Cells(low, high)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(dimension, row) cells; a value is in the last cell whose least value it reaches."""
        return np.stack([np.searchsorted(low[1:], col, "right") for low, col in zip(self.low, x.T, strict=True)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, anchor) least and largest products."""
        a, b = self.low[:, :, None] * q.T[:, None, :], self.high[:, :, None] * q.T[:, None, :]
        return np.minimum(a, b), np.maximum(a, b)


def bounds(codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) lower and upper bounds of scores, sums of one table entry for each dimension."""
    out = []
    for table in tables:
        total = np.zeros((codes.shape[1], table.shape[2]), np.int64)
        for one, code in zip(table, codes, strict=True):
            total += one.take(code, axis=0)
        out.append(np.ascontiguousarray(total.T))
    return out[0], out[1]


def _merge(best: np.ndarray, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """The first `top` of best, rows of (score, id, row), and further ones: higher scores, then smaller ids."""
    both = np.concatenate([best, np.stack([scores, ids, rows], axis=1)])
    return both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:top]]


_NONE = np.empty((0, 3), np.int64)


@dataclass
class Block:
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    codes: np.ndarray

    def between(self, label: int) -> tuple[int, int]:
        """The range of rows with this label; a block is sorted by label."""
        return tuple(np.searchsorted(self.labels, [label, label + 1]))


def near_same(block: Block, cells: Cells, q: np.ndarray, row: np.ndarray, label: np.ndarray, best: list[np.ndarray], top: int, together: int) -> int:
    """Take the block's rows of each anchor's label into best, its first `top` other rows. Returns how many were scored exactly."""
    scored = 0
    for value in np.unique(label):
        a, b = block.between(value)
        mine = np.flatnonzero(label == value)
        if a == b:
            continue
        for part in (mine[i : i + together] for i in range(0, len(mine), together)):
            lower, upper = bounds(block.codes[:, a:b], cells.tables(q[part]))
            for i, lo, hi in zip(part, lower, upper, strict=True):
                other = block.rows[a:b] != row[i]
                lo, hi = lo[other], hi[other]
                bar = best[i][-1, 0] if len(best[i]) == top else np.iinfo(np.int64).min
                if len(lo) > top:
                    bar = max(bar, np.partition(lo, len(lo) - top)[len(lo) - top])
                take = np.flatnonzero(other)[hi >= bar] + a
                scored += len(take)
                best[i] = _merge(best[i], block.ids[take], block.x[take] @ q[i], block.rows[take], top)
    return scored


def in_windows(block: Block, cells: Cells, q: np.ndarray, label: np.ndarray, windows: list[np.ndarray], best: list[list[np.ndarray]], top: int, together: int) -> int:
    """Take the block's rows of other labels into best, the first `top` in each of an anchor's windows (least and largest score).

    A row is scored exactly only if its bounds reach a window's scores, and of those that might, only if its upper bound reaches
    the `top`-th best that is sure: of the rows taken so far, or the lower bounds of rows that lie in the window whole.
    """
    scored = 0
    for part in (range(i, min(i + together, len(q))) for i in range(0, len(q), together)):
        lower, upper = bounds(block.codes, cells.tables(q[part.start : part.stop]))
        for i, lo, hi in zip(part, lower, upper, strict=True):
            a, b = block.between(label[i])
            wanted = np.zeros(len(lo), bool)
            for (least, largest), found in zip(windows[i], best[i], strict=True):
                if least > largest:
                    continue
                bar = max(least, found[-1, 0]) if len(found) == top else least
                may = (hi >= bar) & (lo <= largest)
                may[a:b] = False
                sure = lo[may & (lo >= bar) & (hi <= largest)]
                if len(sure) > top:
                    may &= hi >= np.partition(sure, len(sure) - top)[len(sure) - top]
                wanted |= may
            take = np.flatnonzero(wanted)
            if not len(take):
                continue
            scored += len(take)
            scores, ids, rows = block.x[take] @ q[i], block.ids[take], block.rows[take]
            for k, (least, largest) in enumerate(windows[i]):
                fits = (scores >= least) & (scores <= largest)
                if fits.any():
                    best[i][k] = _merge(best[i][k], ids[fits], scores[fits], rows[fits], top)
    return scored


def usable(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part, v being integers: id and label are there, and a vector of finite components of the commonest length."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(finite & F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * s.scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


_BLOCK = "n int, ids binary, rows binary, labels binary, x binary, codes binary"


def approximation_file(rows: DataFrame, s: Settings) -> tuple[DataFrame, Cells] | None:
    """The file, one record a block of rows sorted by label, and its cells; None without rows. rows: row, id, label, v."""
    chosen = rows.orderBy(F.xxhash64("id"), "id", "row").limit(s.sample).select("v")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.min(0), x.max(0), len(x)) for x in (_matrix(b.column(0)) for b in batches) if len(x)]
        if parts:
            lows, highs, counts = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([np.min(lows, axis=0).tobytes()]), pa.array([np.max(highs, axis=0).tobytes()]), pa.array([sum(counts)])], ["low", "high", "n"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([np.quantile(x, np.arange(s.cells + 1) / s.cells, axis=0).tobytes()])], ["q"])

    ends = rows.select("v").mapInArrow(extremes, "low binary, high binary, n long").collect()  # one small row a task
    if not ends:
        return None
    low = np.min([np.frombuffer(e["low"], np.int64) for e in ends], axis=0)
    high = np.max([np.frombuffer(e["high"], np.int64) for e in ends], axis=0)
    if len(low) * float(max(high.max(), -low.min(), 1)) ** 2 >= 2.0**62:
        raise ValueError("components are too large for integer scores of 64 bits")
    points = np.frombuffer(chosen.coalesce(1).mapInArrow(sample, "q binary").first()["q"]).reshape(s.cells + 1, -1)
    cells = Cells.fit(points, low, high, s.cells)
    shared, total = rows.sparkSession.sparkContext.broadcast(cells), sum(e["n"] for e in ends)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.int32 if max(high.max(), -low.min()) < 2**31 else np.int64
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            for at in range(0, t.num_rows, s.block):
                b = t.slice(at, s.block).combine_chunks().to_batches()[0]
                label = b.column("label").to_numpy()
                order = np.argsort(label, kind="stable")
                x = _matrix(b.column("v"))[order]
                parts = [b.column("id").to_numpy()[order], b.column("row").to_numpy()[order], label[order], x.astype(small), shared.value.encode(x)]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["n", "ids", "rows", "labels", "x", "codes"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8 * s.block:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    tasks = max(-(-total // s.task), min(-(-total // s.block), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    file = rows.select("row", "id", "label", "v").repartition(tasks).mapInArrow(pack, _BLOCK)
    return materialise(file, "approximation-file"), cells


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for n, *parts in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "rows", "labels", "x", "codes")), strict=True):
            ids, rows, labels = (np.frombuffer(p, np.int64) for p in parts[:3])
            codes = np.frombuffer(parts[4], np.uint8).reshape(-1, n)
            wide = np.int32 if len(parts[3]) == 4 * codes.size else np.int64
            yield Block(ids, rows, labels, np.frombuffer(parts[3], wide).reshape(n, -1).astype(np.int64), codes)


def _first(found: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


_FOUND = "anchor int, slot int, score long, id long, row long"


def _found(anchors, slots, best: list[np.ndarray]) -> pa.RecordBatch:
    n = [len(b) for b in best]
    all_ = np.concatenate(best) if best else _NONE
    arrays = [pa.array(np.repeat(np.asarray(v, np.int32), n)) for v in (anchors, slots)] + [pa.array(all_[:, i]) for i in range(3)]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "slot", "score", "id", "row"])


def mine(vectors: DataFrame, is_anchor, s: Settings = Settings(), id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's hard negatives for each positive.

    is_anchor is a condition on `id`, the id column's value. A score is the integer inner product with the anchor; higher
    scores come first, ties by smaller id. An anchor's positives are its first s.positives other rows of its label; the
    negatives of one are the first s.negatives rows of other labels with low% <= score / positive's score <= high%; a
    positive without any gives no row. Rows that lack the id, the label or the vector, or whose vector holds null or
    non-finite components or is of another length than most, take no part. Of rows that repeat an id each is an anchor and
    a candidate of the others. Other columns are ignored; without anchors or rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, s, id_col, label_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = approximation_file(rows, s)
    anchors = rows.where(is_anchor)
    count = anchors.count() if built else 0
    if not count:
        return spark.createDataFrame([], schema)
    file, cells = built
    chunks = -(-count // s.chunk)
    parts = []
    for chunk in range(chunks):
        mine_ = anchors.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).select("row", "id", "label", "v")
        found = materialise(_mine_chunk(file, cells, mine_, s), "hard-negatives")
        parts.append(found)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _mine_chunk(file: DataFrame, cells: Cells, anchors: DataFrame, s: Settings) -> DataFrame:
    spark = file.sparkSession
    got = anchors.toArrow()  # about s.chunk anchors
    q, row, label, ids = _matrix(got.column("v").combine_chunks()), *(got.column(c).to_numpy() for c in ("row", "label", "id"))
    order = np.argsort(label, kind="stable")
    shared = spark.sparkContext.broadcast((cells, q[order], row[order], label[order]))
    ids = ids[order]

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_, q_, row_, label_ = shared.value
        best = [_NONE] * len(q_)
        for block in _blocks(batches):
            near_same(block, cells_, q_, row_, label_, best, s.positives, s.together)
        yield _found(range(len(q_)), [0] * len(q_), best)

    positives = _first(file.mapInArrow(same, _FOUND), ["anchor"], s.positives).select("anchor", "place", "id", "score").toArrow()
    anchor, place, positive, score = (positives.column(c).to_numpy() for c in ("anchor", "place", "id", "score"))
    # For each anchor and place the window of scores; without a positive it is empty.
    windows = np.tile(np.array([1, 0], np.int64), (len(ids), s.positives, 1))
    windows[anchor, place - 1, 0] = -((-s.low * score) // 100)
    windows[anchor, place - 1, 1] = s.high * score // 100
    wanted = spark.sparkContext.broadcast(windows)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_, q_, _, label_ = shared.value
        best = [[_NONE] * s.positives for _ in q_]
        for block in _blocks(batches):
            in_windows(block, cells_, q_, label_, wanted.value, best, s.negatives, s.together)
        yield _found(np.repeat(np.arange(len(q_)), s.positives), np.tile(np.arange(1, s.positives + 1), len(q_)), [b for of in best for b in of])

    found = _first(file.mapInArrow(others, _FOUND), ["anchor", "slot"], s.negatives)
    known = spark.createDataFrame(
        pa.table({"anchor": pa.array(anchor, pa.int32()), "slot": pa.array(place, pa.int32()), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score})
    )
    return found.join(known, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
