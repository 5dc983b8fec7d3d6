"""Maximum inner product search: anisotropic four-bit codes, table scans, exact reranking.

A bounded sample fits coarse centroids and, on residuals scaled to unit length, one codebook of 16 words for every
subspace. Words and codes minimise a score-aware loss: the residual error along the vector counts `parallel` times as
much as the error across it, as that part moves large inner products. Every vector is encoded; none is left out by the
sample. Blocks of vectors meet blocks of queries on a grid: each cell scans its codes by tables of 16 entries a
subspace, takes the best `rerank` of each query, and scores these exactly on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialise


@dataclass(frozen=True)
class Settings:
    #: Most vectors that fitting reads, by the least hash of their id; a documented bound.
    sample: int = 20_000
    centroids: int = 64
    subspace: int = 2
    parallel: float = 4.0
    rounds: int = 8
    #: Vectors and queries in a cell of the grid.
    block: int = 8192
    queries: int = 16_384
    #: Candidates that a cell scores exactly for each query.
    rerank: int = 200


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray
    words: np.ndarray  # subspace, 16, dims of the subspace
    subspace: int
    parallel: float

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, length of the residual, codes) of each row; two codes to a byte are packed by pack()."""
        near = _nearest(x, self.centroids)
        residual = x - self.centroids[near]
        length = np.linalg.norm(residual, axis=1)
        unit = residual / np.where(length > 0, length, 1)[:, None]
        along = x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
        return near, length, _assign(_pad(unit, self.subspace), _pad(along, self.subspace), self.words, self.parallel)


def _pad(x: np.ndarray, sub: int) -> np.ndarray:
    """Rows cut into subspaces of `sub` dimensions, the last one filled with zeros."""
    extra = -x.shape[1] % sub
    return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, sub)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _assign(unit: np.ndarray, along: np.ndarray, words: np.ndarray, parallel: float, passes: int = 2) -> np.ndarray:
    """Codes by coordinate descent on |e|^2 + (parallel - 1) <e, along>^2, e being the residual's error.

    Rows are taken in runs whose distances to all words fit in about 64 MB.
    """
    n, m, _ = unit.shape
    run = max(1, (1 << 22) // unit[0].size // 16) if n else 1
    if n > run:
        return np.concatenate([_assign(unit[i : i + run], along[i : i + run], words, parallel, passes) for i in range(0, n, run)])
    diff = unit[:, :, None, :] - words[None]
    across = (diff * diff).sum(-1)
    toward = (diff * along[:, :, None, :]).sum(-1)
    codes = across.argmin(-1)
    rows = np.arange(n)
    total = np.take_along_axis(toward, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(passes):
        for j in range(m):
            other = total - toward[rows, j, codes[:, j]]
            best = (across[:, j] + (parallel - 1) * (other[:, None] + toward[:, j]) ** 2).argmin(1)
            codes[:, j], total = best, other + toward[rows, j, best]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, s: Settings) -> Model:
    """Centroids by k-means, then words by alternating score-aware assignment and weighted least squares."""
    rng = np.random.default_rng(5)
    k = max(1, min(s.centroids, len(x) // 32))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(s.rounds):
        near = _nearest(x, centroids)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    residual = x - centroids[_nearest(x, centroids)]
    length = np.linalg.norm(residual, axis=1)
    used = length > 0
    unit = _pad(residual[used] / length[used, None], s.subspace)
    along = _pad(x[used] / np.linalg.norm(x[used], axis=1)[:, None], s.subspace)
    m = _pad(x[:1], s.subspace).shape[1]
    words = rng.normal(size=(m, 16, s.subspace)) / np.sqrt(max(1, x.shape[1]))
    if len(unit) >= 16:
        words = unit[rng.choice(len(unit), 16, replace=False)].transpose(1, 0, 2).copy()
        for turn in range(s.rounds):
            codes = _assign(unit, along, words, s.parallel if turn else 1.0)
            error = (unit - words[np.arange(m), codes]) * along
            rest = error.sum((1, 2))[:, None] - error.sum(2)
            for j in range(m):
                for c in range(16):
                    mine = codes[:, j] == c
                    if mine.any():
                        # Least squares of sum |u - w|^2 + (h - 1)(<u - w, a> + rest)^2 for the word w.
                        a, u = along[mine, j], unit[mine, j]
                        left = mine.sum() * np.eye(s.subspace) + (s.parallel - 1) * a.T @ a
                        right = u.sum(0) + (s.parallel - 1) * (a * ((u * a).sum(1) + rest[mine, j])[:, None]).sum(0)
                        words[j, c] = np.linalg.solve(left, right)
    return Model(centroids, words, s.subspace, s.parallel)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte; an odd last one is paired with code 0."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def tables(queries: np.ndarray, model: Model) -> np.ndarray:
    """(query, pair of subspaces, 256) sums of inner products with the words that a byte of codes names."""
    t = np.einsum("qms,mcs->qmc", _pad(queries, model.subspace), model.words)
    t = np.pad(t, ((0, 0), (0, t.shape[1] % 2), (0, 0)))
    if t.shape[1] > model.words.shape[0]:
        t[:, -1] = 0
    return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), -1, 256).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: a vector of the commonest length, finite, not all zero, and with an id."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(finite & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def search(vectors: DataFrame, is_query, top: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` rows of largest inner product, found among all rows but itself.

    is_query is a condition on vec_id. Scores are exact; ties go to the smaller vec_id. Of rows that repeat a vec_id each is a
    query of its own and a candidate of all others. Vectors that are null, zero, non-finite or of another length take no
    part; other columns are ignored, and an empty table gives an empty result.
    """
    s, spark = settings, vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).select("v")

    def fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([np.asarray(v) for v in b.column(0).to_pylist()]) for b in batches if b.num_rows]
        if parts:
            m = fit(np.concatenate(parts), s)
            arrays = [pa.array([x.astype(float).tobytes()]) for x in (m.centroids, m.words)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([m.centroids.shape[1]])], ["centroids", "words", "d"])

    fitted = chosen.coalesce(1).mapInArrow(fitter, "centroids binary, words binary, d long").collect()  # one model of fixed size
    result = "query_id long, rank int, vec_id long, score double"
    if not fitted:
        return spark.createDataFrame([], result)
    d = fitted[0]["d"]
    model = Model(
        np.frombuffer(fitted[0]["centroids"]).reshape(-1, d), np.frombuffer(fitted[0]["words"]).reshape(-1, 16, s.subspace), s.subspace, s.parallel
    )
    shared = spark.sparkContext.broadcast(model)

    n = rows.count()
    n_blocks = -(-n // s.block)
    n_queries = rows.where(is_query).count()
    groups = max(1, -(-n_queries // s.queries))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(v) for v in batch.column(1).to_pylist()])
            near, length, codes = m.encode(x)
            cols = [batch.column(0), pa.array([r.tobytes() for r in x]), pa.array(near.astype(np.int32)), pa.array(length), pa.array([r.tobytes() for r in pack(codes)])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "near", "length", "codes"])

    coded = rows.mapInArrow(encode, "vec_id long, v binary, near int, length double, codes binary")
    coded = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "coded")  # tells rows that repeat an id apart
    cell = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)).cast("int")
    left = coded.withColumn("block", cell).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = coded.where(is_query).select("vec_id", "row", "v").withColumn("qg", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(groups)).cast("int"))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qg = batch.column("qg").to_numpy()
            for g in np.unique(qg):
                mine = pa.array(qg == g)
                ids, own = (batch.column(c).filter(mine).to_numpy().tobytes() for c in ("vec_id", "row"))
                body = b"".join(batch.column("v").filter(mine).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([ids]), pa.array([own]), pa.array([body])], ["qg", "ids", "own", "body"])

    packed = queries.select("vec_id", "row", "v", "qg").mapInArrow(pack_queries, "qg int, ids binary, own binary, body binary")
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def scan(key, vectors_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        names = ("query_id", "query_row", "vec_id", "score")
        none = pd.DataFrame(dict(zip(names, (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0)), strict=True)))
        if vectors_.empty or queries_.empty:
            return none
        vectors_ = vectors_.sort_values("vec_id", kind="stable")
        ids, row, x = vectors_["vec_id"].to_numpy(), vectors_["row"].to_numpy(), np.frombuffer(b"".join(vectors_["v"])).reshape(-1, d)
        near, length = vectors_["near"].to_numpy(), vectors_["length"].to_numpy(np.float32)
        codes = np.frombuffer(b"".join(vectors_["codes"]), np.uint8).reshape(len(ids), -1).T.copy()
        out = []
        for qids, own, body in zip(queries_["ids"], queries_["own"], queries_["body"], strict=True):
            qids, own, q = np.frombuffer(qids, np.int64), np.frombuffer(own, np.int64), np.frombuffer(body).reshape(-1, d)
            coarse = (q @ m.centroids.T).astype(np.float32)
            for at in range(0, len(q), 256):
                lut = tables(q[at : at + 256], m)
                for i in range(len(lut)):
                    guess = np.zeros(len(ids), np.float32)
                    for j in range(len(codes)):
                        guess += lut[i, j].take(codes[j])
                    guess = guess * length + coarse[at + i, near]
                    take = np.arange(len(ids))
                    if len(ids) > s.rerank:
                        bar = np.partition(guess, len(ids) - s.rerank)[len(ids) - s.rerank]
                        above, level = np.flatnonzero(guess > bar), np.flatnonzero(guess == bar)
                        take = np.concatenate([above, level[: s.rerank - len(above)]])  # of equal codes the smaller ids
                    take = take[row[take] != own[at + i]]
                    exact = x[take] @ q[at + i]
                    best = np.lexsort((ids[take], -exact))[:top]
                    out.append((np.full(len(best), qids[at + i]), np.full(len(best), own[at + i]), ids[take][best], exact[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else none

    cells = left.groupBy("block", "qg").cogroup(right.groupBy("block", "qg"))
    found = cells.applyInPandas(scan, "query_id long, query_row long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
