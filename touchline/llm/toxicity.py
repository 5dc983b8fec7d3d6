"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs that skip one word, hashed into a fixed number of buckets.
Training reads a bounded sample of labelled rows and deals it to a fixed number of shards. Each shard's task makes its
features once and runs all rounds of FTRL-proximal over them, its sums of gradients and per-coordinate rates carried from
round to round; the shards' weights are averaged at the end. L1 leaves a few hundred to a few thousand weights, at most one
per bucket, which every scoring task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import materialise, mix, word_slices


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Most labelled rows that training reads, by the least hash of their id; a documented bound, not a scale limit.
    max_rows: int = 24_000
    #: Averaging the weights of several shards trades recall (0.87 against 0.98 with four of them) for shorter tasks.
    shards: int = 1
    rounds: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0


def feature_slices(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature numbers, row numbers within the slice), a feature for every word, pair and skip pair."""
    shift = np.uint64(64 - bits)
    for first, h, at in word_slices(texts):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        parts, rows = [h], [row]
        for gap, seed in ((1, np.uint64(0x51ED270B0A1F39C1)), (2, np.uint64(0xA0761D6478BD642F))):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                parts.append(mix(h[:-gap] * seed + h[gap:])[same])
                rows.append(row[gap:][same])
        yield first, len(at) - 1, (np.concatenate(parts) >> shift).astype(np.int64), np.concatenate(rows)


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    rate = (s.beta + np.sqrt(n)) / s.alpha + s.l2
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / rate)


def _ftrl(examples: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) after all rounds of FTRL-proximal; bucket 2**bits is the bias, which is not regularised.

    An example is its distinct features and its label.
    """
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    free = replace(s, l1=0.0, l2=0.0)
    for _ in range(s.rounds):
        for x, y in examples:
            x = np.append(x, 1 << s.bits)
            w = _weights(z[x], n[x], s)
            w[-1] = _weights(z[-1:], n[-1:], free)[0]
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / s.alpha
            z[x] += g - sigma * w
            n[x] += g * g
    w = _weights(z, n, s)
    w[-1] = _weights(z[-1:], n[-1:], free)[0]
    used = np.flatnonzero(w)
    return used, w[used]


def _shard_trainer(s: Settings):
    """Trains on one shard, a bounded group of doc_id, y, text rows.

    Texts stay in their Arrow buffers, and the features of a run of texts are one array of 32-bit numbers that its examples
    are cut from, so a shard needs about its texts and four bytes a feature.
    """

    def run(group: pa.Table) -> pa.Table:
        examples: list[np.ndarray] = []
        for texts in group.column("text").chunks:
            for _, count, f, row in feature_slices(texts, s.bits):
                pair = np.unique(row << s.bits | f)
                ends = np.cumsum(np.bincount(pair >> s.bits, minlength=count))
                features = (pair & ((1 << s.bits) - 1)).astype(np.int32)
                examples += np.split(features, ends[:-1])
        y = group.column("y").to_numpy()
        order = np.lexsort((y, group.column("doc_id").to_numpy()))[np.random.default_rng(11).permutation(len(y))]
        buckets, w = _ftrl([(examples[i], int(y[i])) for i in order], s)
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "w": pa.array(w, pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[int, float]:
    """Sparse weights {bucket: weight}, at most 2**bits + 1 of them. labels: doc_id, toxic; a null label isn't used.

    A document with contradicting labels counts once for each; of rows that repeat an id one text is read, that of the least
    content hash, so training reads max_rows texts at most. Without labels of both classes there is nothing to tell apart,
    and the weights are empty.
    """
    s = settings
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.max_rows), "labels")
    if known.agg(F.count_distinct("y")).first()[0] < 2:
        return {}
    ids = F.broadcast(known.select("doc_id").distinct())  # at most max_rows
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = texts.join(F.broadcast(known), "doc_id")
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(s.shards)))
    learned = sample.select("shard", "doc_id", "y", "text").groupBy("shard").applyInArrow(_shard_trainer(s), "bucket long, w double")
    found = learned.groupBy("bucket").agg((F.sum("w") / s.shards).alias("w")).collect()  # at most 2**bits + 1 rows
    return {r["bucket"]: r["w"] for r in found}


def _scorer(docs: DataFrame, weights: dict[int, float], bits: int):
    """A function that scores an Arrow array of texts inside a task."""
    buckets = np.array(sorted(b for b in weights if b < 1 << bits), np.int64)
    values = np.array([weights[int(b)] for b in buckets])
    shared = docs.sparkSession.sparkContext.broadcast((buckets, values, weights.get(1 << bits, 0.0) if weights else -np.inf))  # at most 2**bits weights

    def apply(texts: pa.Array) -> np.ndarray:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits)
        dense[at] = w
        live = dense != 0
        out = np.full(len(texts), bias)
        for first, _, f, row in feature_slices(texts, bits):
            hit = live[f]
            pair = np.unique(row[hit] << bits | f[hit])
            np.add.at(out, first + (pair >> bits), dense[pair & ((1 << bits) - 1)])
        return np.where(np.isinf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return apply


def score(docs: DataFrame, weights: dict[int, float], settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row; null and empty texts get the score of the bias alone. Without weights scores are 0."""
    apply = _scorer(docs, weights, settings.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apply(batch.column(1)))], [id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, score double")


def held_out(id_col: str = "doc_id"):
    """True for the rows that training never reads: crc32 of the id as text leaves 0 modulo 5, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, with a model that never saw a held-out label.

    Null texts are empty; rows that repeat an id are scored by their own texts, and null ids are held out. Without labels of
    both classes every score is 0. Other columns are ignored; an empty table gives an empty result.
    """
    weights = train(docs, labels.where(~held_out()), settings)
    return score(docs, weights, settings).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows scored 0.5 or more; nothing is shuffled for it.

    Without labels of both classes every row stays, null ids and null texts included; columns are kept as they are.
    """
    apply = _scorer(docs, train(docs, labels.where(~held_out()), settings), settings.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(apply(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
