"""Nearest vectors of the same class: exact cosines, formed block against block of a class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A class of n vectors is cut into about sqrt(n / CELL) parts, so a cell holds about sqrt(n * CELL) vectors of either side.
CELL = 1024
#: Elements of a block of similarities and of the vectors of pairs that are looked at exactly.
BLOCK = 4 << 20
#: More than rounding can move a product of unit vectors; what is this near to the k-th is looked at exactly.
SLACK = 1e-9


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products row by row, added in order as Spark's fold does, so that both give the same doubles."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _first(query: np.ndarray, ids: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k greatest cosines (NaN is greatest), ties to smaller ids."""
    order = np.lexsort((ids, -np.where(np.isnan(cosine), np.inf, cosine), query))
    opens = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1]))
    place = np.arange(len(order)) - np.repeat(opens, np.diff(np.append(opens, len(order))))
    return order[place < k]


def _cell(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, cosine) of each query row's k nearest candidates with another id."""
    out = []
    with np.errstate(invalid="ignore", over="ignore"):
        q_norm, c_norm = np.sqrt(_dots(q, q)), np.sqrt(_dots(c, c))
        unit = (c / c_norm[:, None]).T
        rows = max(1, BLOCK // len(c_id))
        for at in range(0, len(q_id), rows):
            mine = q_id[at : at + rows]
            near = (q[at : at + rows] / q_norm[at : at + rows, None]) @ unit
            near[np.isnan(near)] = np.inf
            near[mine[:, None] == c_id] = -np.inf
            least = np.full(len(mine), -2.0) if len(c_id) <= k else np.partition(near, len(c_id) - k, axis=1)[:, len(c_id) - k]
            i, j = np.nonzero(near >= np.maximum(least, -2.0)[:, None] - SLACK)
            kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            step = max(1, BLOCK // q.shape[1])
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                cosine = _dots(q[at + a], c[b]) / (q_norm[at + a] * c_norm[b])
                kept = [np.concatenate(x) for x in zip(kept, (a, b, cosine), strict=True)]
                top = _first(kept[0], c_id[kept[1]], kept[2], k)
                kept = [x[top] for x in kept]
            out.append((mine[kept[0]], c_id[kept[1]], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_in_class(rows: DataFrame, by: str, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, cosine): for each row the k rows of its class with other ids of largest cosine, ties to smaller ids.

    A cosine is null where either vector is null, zero, holds a null or the lengths differ; these come last. Rows without
    class or id take no part. All pairs of a class are looked at, as products of blocks in cells of its rows, and only k rows
    of a query leave a cell. Of equal vectors the k + 1 smallest ids are candidates, as no others can be among the k nearest.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    e = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by).alias("class"), F.col(key).alias("id"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    e = e.withColumn("dim", F.when(square > 0, F.size("v")).otherwise(-1))
    full = e.where("dim > 0")
    first = full.withColumn("n", F.dense_rank().over(Window.partitionBy("class", "v").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    parts = full.groupBy("class", "dim").agg(F.ceil(F.sqrt(F.count("*") / CELL)).cast("int").alias("parts"))
    own, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = lambda side, q, c, flag: side.join(parts, ["class", "dim"]).select("class", "dim", q.alias("q"), c.alias("c"), "id", "v", F.lit(flag).alias("asks"))
    cells = dealt(full, own, every, True).unionByName(dealt(first, every, own, False))
    kind = dict(rows.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        asks, ids = (table.column(n).to_numpy() for n in ("asks", "id"))
        flat = table.column("v").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        found = _cell(ids[asks], x[asks], ids[~asks], x[~asks], k) if 0 < asks.sum() < len(asks) else (ids[:0], ids[:0], np.empty(0))
        return pa.table({"query_id": pa.array(found[0]), "id": pa.array(found[1]), "cosine": pa.array(found[2], from_pandas=False)})

    found = cells.groupBy("class", "dim", "q", "c").applyInArrow(run, f"query_id {kind}, id {kind}, cosine double")
    # Pairs without a cosine only differ in their ids: the smallest ones of each length stand for all.
    mixed = e.groupBy("class").agg(F.min("dim").alias("least"), F.max("dim").alias("most")).where("least < most or most = -1")
    rest = e.join(mixed, "class", "left_semi").withColumn("n", F.dense_rank().over(Window.partitionBy("class", "dim").orderBy("id"))).where(F.col("n") <= k + 1)
    a = e.select("class", F.col("id").alias("query_id"), F.col("dim").alias("q_dim"))
    bare = a.join(rest, "class").where("(q_dim = -1 or q_dim <> dim) and query_id <> id").select("query_id", "id", F.lit(None).cast("double").alias("cosine"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.unionByName(bare).withColumn("n", n).where(F.col("n") <= k).select("query_id", F.col("id").alias(key), "cosine")
