"""Best-fit-decreasing packing of token pieces into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so best fit decreasing doesn't need the pieces, only how many there
are of each length. The plan is made on that histogram: open bins of equal room are one class, a segment tree over the
rooms finds the tightest class that still takes a length in logarithmic time, and as many equal pieces as possible are
placed at a time, each bin of the class filled before the next. The result is the packing that piece-by-piece best fit decreasing gives, in a time and space bounded
by the sequence length, whatever the number of documents. Tasks then give each piece its place by its rank among the
pieces of its length; ranks are sums of counts by task, so no length is gathered anywhere.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialise

TOKENIZER = "word_bpe_49k.json"


class RoomTree:
    """Segment tree over rooms 0..size: the least room of at least `need` that has open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing on counts: (length, first rank, first bin, offset) runs, in order of length and rank.

    The pieces of a run have consecutive ranks and lie in consecutive bins at the same offset.
    """
    tree, runs = RoomTree(size), []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    used = 0
    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, used, -(-left // (size // length))
                used += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            # Equal pieces fill a bin one after the other, as the bin used last is the tightest.
            per_bin = room // length
            full, part = divmod(min(left, n * per_bin), per_bin)
            for slot in range(per_bin):
                pieces = full + (slot < part)
                if pieces:
                    runs.append((length, rank, first, size - room + slot * length))
                    rank, left = rank + pieces, left - pieces
            begun = int(part > 0)
            for bins, at, rest in ((full, first, room - per_bin * length), (begun, first + full, room - part * length), (n - full - begun, first + full + begun, room)):
                if bins:
                    open_bins.setdefault(rest, []).append((at, bins))
                    tree.add(rest, bins)
    return runs


#: Characters for which the quick path is the tokenizer's own: composed, with simple lower case, spaces apart.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


class _PartIds(dict):
    """Token ids, as little-endian bytes, of the parts that the tokenizer never merges across; bounded in number."""

    LIMIT = 300_000

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        value = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= 64:
            self[part] = value
        return value


def _lowered(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


@lru_cache(maxsize=2)
def _encoder(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    parts = _PartIds(tokenizer)
    by_part = file == TOKENIZER
    # Added tokens are matched inside texts before any splitting; whatever might hold one goes the tokenizer's own way.
    added = re.compile("|".join(re.escape(_lowered(t.content)) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def encode(text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers, without special tokens."""
        if by_part and _PLAIN.fullmatch(text):
            low = _lowered(text)
            if not added.search(low):
                return b"".join(map(parts.__getitem__, _PARTS.findall(low)))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def token_pieces(docs: DataFrame, size: int, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `size` tokens: a document's ids and a final 0, cut only if longer. Null texts are empty.

    task and place number the pieces of each length within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                for number, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    length = len(part) // 4
                    rows.append((doc, number, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, size: int = 2048, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row of docs is packed, rows that repeat an id each on their own and null ids as null. An empty text is one
    piece, the final 0. Other columns are ignored, and an empty table gives an empty result.
    """
    pieces = materialise(token_pieces(docs, size, tokenizer, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    before = materialise(before, "counts")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = np.array(plan(histogram, size) or [(0, 0, 0, 0)], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by the sequence length, not by the documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = shared.value
        order = run[:, 0] * (1 << 44) - run[:, 1]
        ascending = np.argsort(order)
        run, order = run[ascending], order[ascending]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            hit = run[np.searchsorted(order, length * (1 << 44) - rank)]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
