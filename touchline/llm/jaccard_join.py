"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct k-word shingles as 64-bit fingerprints. Documents with equal sets are one node.

* Small sets (both sizes below the boundary) are matched by enumerating their subsets of exactly the size that a link
  needs: two sets of sizes a and b link if and only if they share a subset of o(a, b) elements.
* Large sets are matched by scanning inverted lists. A list's key is a block of the set: the shingles whose
  fingerprints fall in one of k ranges. Linked sets of sizes a and b differ in at most h(a, b) elements, so with
  k > h ranges at least one block is the same in both. Keys on single shingles would make the list of a passage that a
  hundredth of all documents share as long as that hundredth, and its pairs quadratic; a block spans the whole text.
* The boundary minimises the number of postings, counted over the sizes of all sets.

Lists are not expanded into pairs. Postings are sorted by (key, node) over all partitions, a list may span several, and
each member is proposed with the first and the previous member of its list only. Proposals are verified on the shingle
sets of the whole texts. The members of lists whose proposals left them in more than one component are then matched once
more by scanning inverted lists of their rarest shingles, counted over these members, and pairs from different components
are verified. So no link between components is lost, and a large group of near copies costs about as many verifications as
it has members.

Sets hold 64-bit fingerprints of shingles, made from 64-bit fingerprints of words. A set's size is wrong only if two of
its own shingles collide, a link only if shingles of the two sets do: a chance of about n * n / 2**64 for sets of n
shingles, 2e-11 for 20,000. Sets count as equal by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.llm.common import hot_keys, materialise, mix, shingle_slices, split_join
from touchline.llm.components import connected_components


class Sizes:
    """Size arithmetic of a Jaccard threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [0]
        self.ranges: dict[int, int] = {}

    def partner(self, n: int) -> int:
        """Largest size that a set of n elements can link with."""
        return n * self.den // self.num

    def overlap(self, a: int, b: int) -> int:
        """Elements that linked sets of a and b elements share at least."""
        return -(-(a + b) * self.num // (self.num + self.den))

    def interval(self, n: int) -> int:
        """Number of the size interval of n; linked sets lie in the same or in neighbouring intervals."""
        while self.ends[-1] < n:
            self.ends.append(self.partner(self.ends[-1] + 1))
        return int(np.searchsorted(self.ends, n))

    def differences(self, j: int) -> int:
        """Most elements in which linked sets of interval j or less can differ."""
        while len(self.ends) <= j:
            self.ends.append(self.partner(self.ends[-1] + 1))
        return 2 * self.ends[j] * (self.den - self.num) // (self.den + self.num)

    def blocks(self, j: int) -> int:
        """Number of ranges for lists of intervals j - 1 and j: enough for the smallest set there to fill more of them,
        but for three standard deviations, than can differ; at most twice as many as can differ."""
        if j not in self.ranges:
            most = self.differences(j)
            n = self.ends[max(j - 2, 0)] + 1
            k = most + 1
            while k < 2 * most and k * (1 - exp(-n / k)) - 3 * sqrt(k * exp(-n / k)) < most + 1:
                k += 1 + k // 50
            self.ranges[j] = k
        return self.ranges[j]

    def subset_pairs(self, n: int, below: int) -> list[tuple[int, int]]:
        """(lesser, greater) sizes, both under `below`, that involve a set of n elements."""
        low = -(-n * self.num // self.den)
        return [(min(n, b), max(n, b)) for b in range(low, min(self.partner(n), below - 1) + 1)]

    def n_subsets(self, n: int, below: int) -> int:
        return sum(comb(n, self.overlap(a, b)) for a, b in self.subset_pairs(n, below))

    def n_blocks(self, n: int) -> int:
        j = self.interval(n)
        return self.blocks(j) + self.blocks(j + 1)

    def boundary(self, histogram: dict[int, int], upto: int, largest: int) -> int | None:
        """The size from which inverted lists take over, by the number of postings; None if sizes above `upto` matter.

        histogram: sets of each size up to `upto`. A larger boundary enumerates more sets and more subsets of each, so the
        search ends where subsets alone cost more than the best boundary's postings; the lists of larger sets cost the
        same whatever the boundary. largest: size of the largest set.
        """
        best = None
        for x in range(1, largest + 2):
            if self.partner(x) > upto and upto < largest:
                return None
            small = sum(count * self.n_subsets(n, x) for n, count in histogram.items() if n < x)
            if best is not None and small > best[0]:
                break
            cost = small + sum(count * self.n_blocks(n) for n, count in histogram.items() if self.partner(n) >= x)
            best = (cost, x) if best is None or cost < best[0] else best
        return best[1]


def _subset_keys(elements: np.ndarray, sizes: Sizes, boundary: int) -> np.ndarray:
    """Keys of the subsets of a small set, one for each subset of each size that a link needs."""
    n, spread = len(elements), [int(x) for x in mix(elements)]
    total, out = sum(spread), []
    for a, b in sizes.subset_pairs(n, boundary):
        kept = [(total - sum(gone)) % 2**64 for gone in combinations(spread, n - sizes.overlap(a, b))]
        out.append(mix(np.array(kept, np.uint64) ^ np.uint64(a * 1_000_003 + b)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _block_keys(elements: np.ndarray, at: np.ndarray, step: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set numbers) of all blocks of each set's own size interval (step 0) or the next one (step 1)."""
    n = np.diff(at)
    known = {int(x): sizes.interval(int(x)) + step for x in np.unique(n)}
    interval = np.array([known[int(x)] for x in n], np.int64)
    k = np.array([sizes.blocks(int(j)) for j in interval], np.uint64)
    most = np.array([sizes.differences(int(j)) for j in interval])
    owner = np.repeat(np.arange(len(n)), n)
    block = ((elements >> np.uint64(32)) * k[owner]) >> np.uint64(32)
    opens = np.ones(len(elements), bool)
    opens[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(opens)
    sums = np.add.reduceat(mix(elements), starts)
    whose, which = owner[starts], block[starts]
    # With more filled blocks than possible differences one filled block stays as it is. Other sets post their
    # empty blocks too: a pair can only be left to those if both sets are of that kind.
    few = np.flatnonzero(np.bincount(whose, minlength=len(n)) <= most)
    empty = [np.setdiff1d(np.arange(k[i], dtype=np.uint64), which[whose == i]) for i in few]
    sums = np.concatenate([sums, np.zeros(sum(map(len, empty)), np.uint64)])
    which = np.concatenate([which, *empty])
    whose = np.concatenate([whose, np.repeat(few, [len(x) for x in empty])]).astype(np.int64)
    salt = mix(which * np.uint64(0x9E3779B97F4A7C15) + interval[whose].astype(np.uint64))
    return mix(sums ^ salt), whose


def _set_digests(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two signed 64-bit words of digest for each set."""
    raw = [xxhash.xxh3_128_digest(elements[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def _parities(elements: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bit vector for each set, of n/2 to n bits but 256 at least: the parity of how many elements fall on each bit.

    Every bit in which two sets' vectors differ takes at least one element that only one of them has.
    """
    n = np.diff(at)
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(n / 2, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    where = base[owner] + (elements & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(where, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1], base[1:], strict=True)]


def set_signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, s1, s2, parity): the set's size, a 128-bit digest and a parity vector; null digest for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, e, at in shingle_slices(batch.column(1), k):
                n, digest = np.diff(at), _set_digests(e, at)
                cols = [batch.column(0).slice(first, len(n)), pa.array(n), *(pa.array(digest[:, i], mask=n == 0) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_parities(e, at), pa.binary())], ["id", "n_shingles", "s1", "s2", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, parity binary")


def postings(docs: DataFrame, k: int, num: int, den: int, boundary: int, text_col: str = "text") -> DataFrame:
    """(key, s1) of every list that a document's set is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(num, den)
        for batch in batches:
            for _, e, at in shingle_slices(batch.column(0), k):
                n = np.diff(at)
                full = n > 0
                at, digest, n = np.append(at[:-1][full], at[-1:]), _set_digests(e, at)[full, 0], n[full]
                if not len(n):
                    continue
                keys, whose = [], []
                for i in np.flatnonzero(n < boundary):
                    keys.append(_subset_keys(e[at[i] : at[i + 1]], sizes, boundary))
                    whose.append(np.full(len(keys[-1]), i))
                large = np.array([sizes.partner(int(x)) >= boundary for x in n])
                if large.any():
                    of = np.flatnonzero(large)
                    ends = np.concatenate([[0], np.cumsum(n[of])])
                    chosen = e[np.repeat(large, n)]
                    for step in (0, 1):
                        found, owner = _block_keys(chosen, ends, step, sizes)
                        keys.append(found)
                        whose.append(of[owner])
                if keys:
                    cols = np.concatenate(keys).view(np.int64), digest[np.concatenate(whose)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "s1"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, s1 long")


_PROPOSAL, _EDGE, _LONG = 0, 1, 2


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by key and node: (key, a, b, mark) for each member b with the list's first and previous member as a.

    Marked rows have a null b: the first node of the partition's first and last list, to tie parts of a list together, and
    the fourth member of a list, which shows that proposals are not all of its pairs.
    """
    names = ["key", "a", "b", "mark"]

    def edge(k: int, node: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([node]), pa.array([None], pa.int64()), pa.array([_EDGE], pa.int32())], names)

    key = head = last = first_key = None
    done = 0
    for batch in batches:
        k, s = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(k):
            continue
        if first_key is None:
            first_key = int(k[0])
            yield edge(first_key, int(s[0]))
        joined = key is not None and int(k[0]) == key
        if joined:
            k, s = np.concatenate([[key], k]), np.concatenate([[last], s])
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        lengths = np.diff(np.append(starts, len(k)))
        heads, before = s[starts].copy(), np.zeros(len(starts), np.int64)
        if joined:
            heads[0], before[0] = head, done - 1
        of = np.repeat(heads, lengths)
        place = np.arange(len(k)) - np.repeat(starts - before, lengths)
        follows = np.concatenate([[False], k[1:] == k[:-1]])
        previous = np.concatenate([[0], s[:-1]])
        near = follows & (previous != s)
        far = near & (of != previous) & (of != s)
        long = follows & (place == 3)
        out = [np.concatenate(x) for x in ((k[near], k[far], k[long]), (previous[near], of[far], s[long]), (s[near], s[far], s[long]))]
        if len(out[0]):
            marks = np.repeat([_PROPOSAL, _LONG], [near.sum() + far.sum(), long.sum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], mask=marks == _LONG), pa.array(marks)], names)
        key, head, last, done = int(k[-1]), int(heads[-1]), int(s[-1]), int(place[-1]) + 1
    if key is not None and key != first_key:
        yield edge(key, head)


def _may_link(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs without those whose parity vectors differ in more bits than linked sets have elements apart.

    pairs: a, b, rep_a, rep_b, n_a, n_b, parity_a, parity_b; the result has the first four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(4).to_numpy() + batch.column(5).to_numpy()) * (den - num)
            good = []
            for limit, x, y in zip(most, batch.column(6), batch.column(7), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                good.append(int(np.bitwise_count(x ^ y).sum()) * (num + den) <= limit)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "rep_a", "rep_b"]).filter(pa.array(good, pa.bool_()))

    columns = ["a", "b", "rep_a", "rep_b", "n_a", "n_b", "parity_a", "parity_b"]
    return pairs.select(*columns).mapInArrow(run, "a long, b long, rep_a long, rep_b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(rep_a, rep_b) of the pairs whose shingle sets reach the threshold. pairs: a, b, rep_a, rep_b; docs: id, text.

    A pair's second text travels to its first one, which comes once for all its pairs, but for hot ones once for each of
    about sqrt(pairs) parts. A task holds one set at a time and streams the others past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, center = None, None
        for batch in batches:
            a, part, b, node, rep_a, rep_b = (batch.column(i).to_pylist() for i in range(6))
            good: list[int] = []
            for first, e, at in shingle_slices(batch.column(6), k):
                digest = _set_digests(e, at)[:, 0]
                for i in range(len(at) - 1):
                    row, mine = first + i, e[at[i] : at[i + 1]]
                    # An id that rows with different texts share brings these along; only the node's own counts.
                    if digest[i] != node[row]:
                        continue
                    if b[row] is None:
                        at_part, center = (a[row], part[row]), mine.copy()
                    elif at_part == (a[row], part[row]):
                        found = np.searchsorted(center, mine)
                        same = int((center[np.minimum(found, len(center) - 1)] == mine).sum())
                        if same and den * same >= num * (len(center) + len(mine) - same):
                            good.append(row)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([rep_a[i] for i in good], pa.int64()), pa.array([rep_b[i] for i in good], pa.int64())], ["a", "b"])

    size = pairs.count()
    heads = materialise(pairs.groupBy("a", "rep_a").agg(F.ceil(F.sqrt(F.count("*")) / 4).cast("long").alias("parts")), "heads")
    parted = split_join(pairs, heads.select("a", "parts"), "a", hot_keys(pairs, "a", size))
    members = parted.select(F.col("rep_b").alias("id"), F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b", "rep_a", "rep_b")
    centers = heads.select(
        F.col("rep_a").alias("id"), F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("rep_a"), F.lit(None).cast("long").alias("rep_b"),
    )
    asked = materialise(members.unionByName(centers), "asked")
    # Written, so that the planner knows its size: while it is small no text is shuffled to be left out.
    wanted = docs.join(materialise(asked.select("id").distinct(), "wanted"), "id", "left_semi")
    placed = wanted.join(asked, "id").select("a", "part", "b", "node", "rep_a", "rep_b", "text")
    together = placed.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return together.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id), linking documents of Jaccard similarity num/den or more.

    component_id is the smallest id reachable by links, the document's own included. Null or word-less texts have an
    empty set, no links and their own id. Rows that repeat an id are one document for linking, so their links join; a
    null id takes no part and has a null component. Other columns are ignored. An empty table gives an empty result.
    """
    signs = materialise(set_signatures(docs, k, id_col, text_col), "sets")
    full = signs.where("s1 is not null and id is not null")
    groups = full.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"))
    own = full.select(F.col("id").alias("rep"), "s1", "s2", "parity").distinct()
    nodes = materialise(groups.join(own, ["rep", "s1", "s2"]).select("s1", "s2", "rep", "n", "parity"), "nodes")
    sizes, upto, boundary = Sizes(num, den), 32, None
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while boundary is None:
        upto *= 2
        counts = nodes.where(F.col("n") <= upto).groupBy("n").count().collect()  # at most `upto` rows
        boundary = sizes.boundary({r["n"]: r["count"] for r in counts}, upto, largest)
    lists = postings(docs.where(F.col(id_col).isNotNull()), k, num, den, boundary, text_col)
    ordered = lists.repartitionByRange("key", "s1").sortWithinPartitions("key", "s1")
    scanned = materialise(ordered.mapInArrow(_scan, "key long, a long, b long, mark int"), "lists")
    parts = scanned.where(F.col("mark") == _EDGE).select("key", F.col("a").alias("b")).distinct()
    ties = parts.join(parts.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "key").where("a <> b")
    proposed = scanned.where(F.col("mark") == _PROPOSAL).select("key", "a", "b").unionByName(ties.select("key", "a", "b"))

    # Lists are sorted by node, so a < b in every proposal and a list's first node is the a of many.
    tried = materialise(proposed.select("a", "b").distinct(), "tried")
    n_tried = tried.count()
    hubs = materialise(hot_keys(tried, "a", n_tried), "hubs")
    a_side, b_side = (nodes.select(F.col("s1").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab")
    near = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    pairs = split_join(tried, a_side, "a", hubs).join(b_side, "b").where(near & F.expr("rep_a <> rep_b"))
    # Texts travel only for pairs that their parity vectors don't rule out.
    close = materialise(_may_link(pairs, num, den), "close")
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = materialise(_verified(close, whole, k, num, den), "links")
    found = connected_components(links)

    # Lists that their proposals left in several components: pairs of members across components that can link are verified.
    home = nodes.join(found, nodes["rep"] == found["node"], "left").select("s1", "rep", "n", F.coalesce("component", "rep").alias("component"))
    home = materialise(home, "homes")
    ha, hb = (home.select(F.col("s1").alias(c), F.col("component").alias(f"comp_{c}")) for c in "ab")
    apart = split_join(tried, ha, "a", hubs).join(hb, "b").where("comp_a <> comp_b").select("a", "b")
    # The proposals of a list of three are all its pairs, unless it lies in several partitions.
    long = scanned.where(F.col("mark") == _LONG).select("key").unionByName(ties.select("key")).distinct()
    torn = materialise(proposed.join(apart, ["a", "b"]).select("key").distinct().join(long, "key"), "torn")
    members = split_join(proposed, torn, "key", hot_keys(proposed, "key", n_tried))
    members = members.select(F.col("a").alias("s1")).unionByName(members.select(F.col("b").alias("s1"))).distinct()
    suspects = materialise(members.join(home, "s1"), "suspects")
    rest = _rare_first_pairs(suspects, whole, k, num, den)
    rest = rest.join(tried, ["a", "b"], "left_anti")
    ra, rb = (home.select(F.col("s1").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    rest = materialise(rest.join(ra, "a").join(rb, "b").where("rep_a <> rep_b"), "rest")
    more = _verified(rest, whole, k, num, den)

    # Ids that rows with different sets share tie those sets together.
    own = full.join(nodes.select("s1", "s2", "rep"), (full["s1"] == nodes["s1"]) & (full["s2"] == nodes["s2"]) & (full["id"] != nodes["rep"]))
    shared = own.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(links.unionByName(more).unionByName(shared))
    return (
        signs.join(component, signs["id"] == component["node"], "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    )


def _rare_first_pairs(suspects: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of all suspect nodes of different components that can link, by the rarest shingles among the suspects.

    Linked sets share one of each set's n - ceil(t n) + 1 rarest shingles, and no shingle that only one suspect has, so a
    near copy with many edits of its own proposes nothing. A pair's first common shingle leaves enough after it in both, its
    reach, for the link. In each list the members of the component with most members are paired with the others, never
    among themselves, and long lists in parts. suspects: s1, rep, n, component; docs: id, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for first, e, at in shingle_slices(batch.column(1), k):
                mine = node[first : first + len(at) - 1]
                good = _set_digests(e, at)[:, 0] == mine
                n = np.diff(at)
                kept = np.repeat(good, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, n)[kept]), pa.array(e[kept].view(np.int64))], ["s1", "shingle"])

    texts = docs.join(suspects.select(F.col("rep").alias("id"), "s1"), "id").select("s1", "text").dropDuplicates()
    elements = materialise(texts.mapInArrow(run, "s1 long, shingle long"), "elements")
    common = elements.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("s1")
    ranked = elements.join(common, "shingle").select(
        "s1", "shingle", F.count("*").over(own).alias("shared"), F.row_number().over(own.orderBy("df", "shingle")).alias("place")
    )
    kept = ranked.join(suspects.select("s1", "n", "component"), "s1").where(f"n - shared + place <= n - (n * {num} + {den - 1}) div {den} + 1")
    kept = materialise(kept.select("shingle", "s1", "n", "component", (F.col("shared") - F.col("place") + 1).alias("reach")), "rare")
    most = (
        kept.groupBy("shingle", "component")
        .agg(F.count("*").alias("c"))
        .groupBy("shingle")
        .agg(F.max(F.struct("c", "component")).getField("component").alias("major"), F.count("*").alias("components"), F.ceil(F.sum("c") / 500).alias("parts"))
        .where("components > 1")
    )
    lists = kept.join(most.drop("components"), "shingle")
    a, b = (lists.select("shingle", "parts", *(F.col(x).alias(f"{x}_{c}") for x in ("s1", "n", "component", "reach")), (F.col("component") == F.col("major")).alias(f"major_{c}")) for c in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("s1_a"), F.col("parts"))).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    possible = f"""component_a <> component_b and (major_b or s1_a < s1_b)
        and least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}
        and least(reach_a, reach_b) * {num + den} >= {num} * (n_a + n_b)"""
    pairs = a.where("not major_a").join(b, ["shingle", "part"]).where(possible)
    return pairs.select(F.least("s1_a", "s1_b").alias("a"), F.greatest("s1_a", "s1_b").alias("b")).distinct()


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Documents without those that another document of their group, with a smaller id, represents.

    Rows with a null id and rows that repeat a kept id stay, columns are kept as they are, an empty table stays empty.
    """
    found = jaccard_components(docs, k, num, den)
    gone = materialise(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
