"""Exact deduplication over a sharded cuckoo-filter index.

The index holds one live entry per distinct text: its content key, the id of the document that stays and the size of its
group. Entries are spread over shards by digest. A shard's task answers "is this digest live?" from a cuckoo filter
of 16-bit fingerprints, four to a bucket; only a hit looks at the bucket's stored content keys. When a document with a larger
id takes over, the old live entry is deleted from the filter and the new one inserted. A bucket path that overflows
doubles the filter and rebuilds it from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import fresh, materialise

_SLOTS = 4
_MAX_KICKS = 200
#: About the most distinct texts of a shard.
SHARD_ROWS = 200_000
ENTRY = "digest binary, keep_id long, group_size long"


class CuckooFilter:
    """Fingerprints in buckets of four slots; each slot also points at its entry, whose stored digest settles a hit."""

    def __init__(self, capacity: int = 1024):
        self.digests: list[bytes | None] = []
        self.values: list[tuple | None] = []
        self.free: list[int] = []
        self._clear(max(16, capacity // _SLOTS))

    def __len__(self) -> int:
        return len(self.digests) - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.mask = (1 << (buckets - 1).bit_length()) - 1
        self.buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.mask + 1)]

    def _place(self, digest: bytes) -> tuple[int, int]:
        head = int.from_bytes(digest[:10], "little")
        return head >> 64 or 1, head & self.mask

    def _other(self, at: int, fingerprint: int) -> int:
        return at ^ (fingerprint * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes) -> int | None:
        """Entry of a live digest. A fingerprint hit counts only if the bucket's stored digest is the same."""
        fingerprint, at = self._place(digest)
        for bucket in (at, self._other(at, fingerprint)):
            for held, entry in self.buckets[bucket]:
                if held == fingerprint and self.digests[entry] == digest:
                    return entry
        return None

    def _settle(self, digest: bytes, entry: int) -> bool:
        fingerprint, at = self._place(digest)
        if len(self.buckets[at]) >= _SLOTS:
            at = self._other(at, fingerprint)
        for kick in range(_MAX_KICKS):
            bucket = self.buckets[at]
            if len(bucket) < _SLOTS:
                bucket.append((fingerprint, entry))
                return True
            slot = kick % _SLOTS
            (fingerprint, entry), bucket[slot] = bucket[slot], (fingerprint, entry)
            at = self._other(at, fingerprint)
        return False

    def insert(self, digest: bytes, value: tuple) -> int:
        if self.free:
            entry = self.free.pop()
            self.digests[entry], self.values[entry] = digest, value
        else:
            entry = len(self.digests)
            self.digests.append(digest)
            self.values.append(value)
        if not self._settle(digest, entry):
            self._resize()
        return entry

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._settle(d, i) for i, d in enumerate(self.digests) if d is not None):
                return

    def delete(self, digest: bytes) -> tuple | None:
        """Value of the entry taken out; None if the digest isn't live."""
        entry = self.find(digest)
        if entry is None:
            return None
        fingerprint, at = self._place(digest)
        for bucket in (self.buckets[at], self.buckets[self._other(at, fingerprint)]):
            if (fingerprint, entry) in bucket:
                bucket.remove((fingerprint, entry))
                break
        value, self.digests[entry], self.values[entry] = self.values[entry], None, None
        self.free.append(entry)
        return value

    def entries(self) -> Iterator[tuple[bytes, tuple]]:
        return ((d, v) for d, v in zip(self.digests, self.values, strict=True) if d is not None)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: one row for each digest and run of about 200,000 rows, so that a hot text sends few rows."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            yield from t.group_by("digest").aggregate([("keep_id", "max"), ("group_size", "sum")]).rename_columns(["digest", "keep_id", "group_size"]).to_batches()
            held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 200_000:
            yield from flush()
    yield from flush()


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert a shard's rows into its filter. A row of negative size takes that many documents out."""
    live = CuckooFilter()
    for batch in batches:
        for digest, keep, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entry = live.find(digest)
            if entry is None:
                live.insert(digest, (keep, size))
                continue
            old = live.values[entry]
            if old[0] == keep or _larger(old[0], keep) == old[0]:
                live.values[entry] = (old[0], old[1] + size)
            else:
                live.delete(digest)
                live.insert(digest, (keep, old[1] + size))
    rows = list(live.entries())
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in part], pa.binary()), *(pa.array([v[j] for _, v in part], pa.int64()) for j in (0, 1))], ["digest", "keep_id", "group_size"]
        )


def content_key(text_col: str = "text"):
    """48 bytes that stand for a text: its SHA-256, its length in UTF-8 and its xxHash64; null counts as empty.

    Buckets store the whole key, and a hit compares all of it, so texts that shared a SHA-256 would still be told apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    word = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(F.sha2(text.cast("binary"), 256), word(F.octet_length(text).cast("long")), word(F.xxhash64(text))))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): the content key of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), content_key(text_col).alias("digest"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of a table: (digest, keep_id, group_size), one live entry per distinct text."""
    rows = digests(docs, id_col, text_col).select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    # A shard's filter and entries are in memory, so shards grow in number and not in size.
    shards = max(-(-docs.count() // SHARD_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(_combine, ENTRY).repartition(shards, "digest").mapInArrow(_index, ENTRY)


def insert(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with further documents: larger ids take over, sizes add up."""
    return index.unionByName(build_index(docs)).repartition("digest").mapInArrow(_index, ENTRY)


def delete(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the texts of `gone`, which leaves no live digest for them.

    A digest is deleted whole: who would stay next isn't in the index, so documents that are still there are inserted again.
    """

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, out = CuckooFilter(), []
        for batch in pairs:
            for digest, keep, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (out.append(digest) if size is None else live.insert(digest, (keep, size)))
        for digest in out:
            live.delete(digest)
        rows = list(live.entries())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.binary()), *(pa.array([v[j] for _, v in rows], pa.int64()) for j in (0, 1))], ["digest", "keep_id", "group_size"]
        )

    marks = digests(gone).select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size")).distinct()
    return index.unionByName(marks).repartition("digest").mapInArrow(run, ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; null counts as empty. Of a group the row with the largest id stays; rows that repeat
    that id are all marked kept, and null ids stay only where the group has no other. Other columns are ignored and an
    empty table gives an empty result.
    """
    index = materialise(build_index(docs, id_col, text_col), "digests")
    return (
        digests(docs, id_col, text_col)
        .join(index, "digest")
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.expr("id <=> keep_id").alias("kept"),
            F.lower(F.substring(F.hex("digest"), 1, 64)).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of rows that repeat both id and text one stays.

    What goes is found on narrow rows: keys of rows with another id than the one that stays, and keys that several rows
    share. Texts are shuffled only for the second kind, and while the first is small the planner broadcasts it.
    """
    key, id_, n = fresh(docs.columns, "digest_", "id_", "n_")
    index = materialise(build_index(docs), "digests").select(F.col("digest").alias(key), "keep_id")
    rows = digests(docs).select(F.col("digest").alias(key), F.col("id").alias(id_)).groupBy(key, id_).agg(F.count("*").alias(n))
    marked = materialise(rows.join(index, key).where(~F.col(id_).eqNullSafe(F.col("keep_id")) | (F.col(n) > 1)).select(key, id_, n, F.col(id_).eqNullSafe(F.col("keep_id")).alias("stays")), "marked")
    keyed = docs.withColumn(key, content_key())
    same = lambda m: (keyed[key] == m[key]) & keyed["doc_id"].cast("long").eqNullSafe(m[id_])
    whole, once = keyed.join(marked, same(marked), "left_anti"), marked.where("stays")
    if not once.isEmpty():  # else no text has to be shuffled to find rows that repeat each other
        whole = whole.unionByName(keyed.join(once, same(once), "left_semi").dropDuplicates([key]))
    return whole.select(*docs.columns)
