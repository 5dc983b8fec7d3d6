"""Merkle manifest of a dataset, built from fixed-size ordered arrays of leaves by higher-order SQL functions.

Leaves are ranked within their group by a range partitioning, not by one window over the group. Runs of `arity` nodes
become one; a block of arity ** levels leaves is an array that collapses several levels at once, by sequence, transform,
slice and aggregate; then the block roots are leaves of the next round, until each group has one. The subroots, in the order
of their groups, give the root in the same way. On the way down every block learns its path to the root once, and each leaf adds the
part of its path that lies inside its block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialise

_STEP = "array<struct<l:string,r:string>>"
#: Powers of the arity up to here count levels; 8 ** 20 is 2 ** 60.
_DEEPEST = 20


@dataclass(frozen=True)
class Shape:
    #: Nodes that become one.
    arity: int = 8
    #: Levels that one block collapses; a block holds arity ** levels leaves.
    levels: int = 3

    @property
    def block(self) -> int:
        return self.arity**self.levels


def digest(parts: Column) -> Column:
    """H: lowercase hex SHA-256."""
    return F.sha2(parts, 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, `:` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*(field(v) for v in values)))


def _depth(total: Column, shape: Shape) -> Column:
    """Levels between `total` nodes and one."""
    powers = [shape.arity**k for k in range(_DEEPEST) if shape.arity**k < 2**62]
    return reduce(lambda a, b: a + b, ((total > F.lit(p).cast("long")).cast("int") for p in powers))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, their place from 0 within g by `order`, and total, their number in g.

    Rows are range-partitioned by g and order, so a group with a third of all rows spreads over a third of the partitions;
    the counts of a group in earlier partitions are its offset. Ties need a last column of order that tells rows apart.
    """
    by = ["g", *order]
    rows = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__p", F.shiftright("__i", 33))
    w = Window.partitionBy("g")
    parts = rows.groupBy("g", "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("total"))
    return rows.join(parts, ["g", "__p"]).withColumn("pos", F.col("__i") + F.col("__shift")).drop("__i", "__p", "__shift")


def _up(nodes: Column, arity: int) -> Column:
    """The next level: every `arity` nodes in a row become the digest of their concatenation."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * arity + 1, F.lit(arity)), "")))


def _blocks(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(g, b, total, items, lv) from nodes (g, pos, total, item with a field h): a block's items and its nodes level by level."""
    block = F.floor(F.col("pos") / shape.block).cast("long")
    gathered = nodes.groupBy("g", block.alias("b"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    steps = F.slice(F.sequence(F.lit(1), F.lit(shape.levels)), F.lit(1), F.least(F.lit(shape.levels), _depth(F.col("total"), shape)))
    first = F.array(F.transform("items", lambda x: x["item"]["h"]))
    return gathered.withColumn("lv", F.aggregate(steps, first, lambda done, _: F.concat(done, F.array(_up(F.element_at(done, -1), shape.arity)))))


def _root() -> Column:
    return F.element_at(F.element_at("lv", -1), 1)


def _tree(nodes: DataFrame, shape: Shape, name: str) -> list[DataFrame]:
    """The block tables of every round, bottom first. A round shrinks each group by the block size; the last leaves one block a group."""
    rounds = []
    while True:
        blocks = materialise(_blocks(nodes, shape), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        open_ = blocks.where(F.col("total") > shape.block)
        if open_.isEmpty():
            return rounds
        total = F.ceil(F.col("total") / shape.block).cast("long")
        nodes = open_.select("g", F.col("b").alias("pos"), total.alias("total"), F.struct(_root().alias("h")).alias("item"))


def _within(index: Column, shape: Shape) -> Column:
    """Path of a block's item from the bottom to the block's root: (l, r), what stands before and after it in its run."""

    def step(level: Column) -> Column:
        at = F.floor(index / F.element_at(F.array(*(F.lit(shape.arity**j) for j in range(shape.levels))), level + 1)).cast("int")
        run = F.floor(at / shape.arity).cast("int") * shape.arity
        row = F.element_at("lv", level + 1)
        side = lambda start, n: F.array_join(F.slice(row, start + 1, n), "")
        return F.struct(side(run, at - run).alias("l"), side(at + 1, run + shape.arity - at - 1).alias("r"))

    levels = F.slice(F.sequence(F.lit(0), F.lit(shape.levels)), F.lit(1), F.size("lv") - 1)
    return F.transform(levels, step)


def _descend(rounds: list[DataFrame], tops: DataFrame, shape: Shape) -> DataFrame:
    """The bottom blocks, each with its path to the root and the columns of tops. tops: g, path (from the group's root on), more."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for blocks in reversed(rounds):
        done = blocks.where(F.col("total") <= shape.block).join(tops, "g").select(*blocks.columns, "path", *more)
        if above is not None:
            inner = above.select("g", "path", *more, F.posexplode(F.transform("items", lambda x, i: F.struct(x["pos"].alias("b"), _within(i, shape).alias("mine"))))).select(
                "g", F.col("col.b").alias("b"), F.concat("col.mine", "path").alias("path"), *more
            )
            done = done.unionByName(blocks.where(F.col("total") > shape.block).join(inner, ["g", "b"]).select(*blocks.columns, "path", *more))
        above = done
    return above


def fold(claim: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, claim, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def manifest(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of (grp, id, leaf, claim).

    Within a group leaves ascend by id (nulls first; repeated ids by leaf). While more than one node remains, every `arity`
    in a row become their digest, a shorter last run too. Groups' subroots are ordered by group, null first and else by
    UTF-8 bytes, and give the root alike. proof_sha256 is the digest of all siblings on a leaf's path, left to right, from
    the bottom up; without siblings that of nothing. folded_root is recomputed from `claim`, the leaf of what is to be
    verified, and the siblings. An empty table gives an empty result; columns other than the four are ignored.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))  # null before all, and no null key in a join
    item = F.struct(F.col("leaf").alias("h"), "id", "claim")
    narrow = materialise(rows.select(group.alias("g"), "id", "leaf", "claim").withColumn("__row", F.monotonically_increasing_id()), "leaves")
    ranked = _ranked(narrow, ["id", "leaf", "__row"], "ranked-leaves")
    trees = _tree(ranked.select("g", "pos", "total", item.alias("item")), shape, "tree")
    # Each group's subroot is the root of its one block in the round where it has one block.
    subroots = reduce(DataFrame.unionByName, [b.where(F.col("total") <= shape.block).select("g", _root().alias("h")) for b in trees])
    heads = _ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"], "ranked-subroots")
    top = _tree(heads.select("g", "pos", "total", F.struct("h", "name").alias("item")), shape, "top")
    root = top[-1].select("g", _root().alias("root"), F.lit(None).cast(_STEP).alias("path")).withColumn("path", F.coalesce("path", F.array().cast(_STEP)))
    upper = _descend(top, root, shape)
    upper = upper.select("root", "path", F.inline(F.transform("items", lambda x, i: F.struct(x["item"]["name"].alias("g"), x["item"]["h"].alias("subroot"), _within(i, shape).alias("mine")))))
    tops = materialise(upper.select("g", "subroot", "root", F.concat("mine", "path").alias("path")), "subroots")
    bottom = _descend(trees, tops, shape)

    def proof(x: Column, i: Column) -> Column:
        path = F.concat(_within(i, shape), F.col("path"))
        siblings = F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")
        return F.struct(x["item"]["id"].alias("id"), x["item"]["h"].alias("leaf"), digest(siblings).alias("proof_sha256"), fold(x["item"]["claim"], path).alias("folded_root"))

    out = bottom.select("subroot", "root", F.inline(F.transform("items", proof)))
    return out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_manifest(docs: DataFrame, one_in: int = 3, id_col: str = "doc_id", text_col: str = "text", by: str = "lang", others: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """The manifest of all rows, verified against rows of which every `one_in`-th by crc32 of its id has its text's A-Z lower-cased.

    A leaf is made of id, others and text. Null texts stay null, and rows with a null id are not tampered with. Rows whose
    text has no A-Z verify. Text is read once and leaves its task only as digests.
    """
    text, number, rest = F.col(text_col), F.col(id_col), [F.col(c) for c in others]
    mine = leaf(number, *rest, text)
    hit = F.coalesce(F.crc32(number.cast("string").cast("binary")) % one_in == 0, F.lit(False))
    claim = F.when(hit & text.isNotNull(), leaf(number, *rest, F.translate(text, _UPPER, _UPPER.lower())))
    leaves = docs.select(F.col(by).alias("grp"), number.cast("long").alias("id"), mine.alias("leaf"), claim.alias("other"))
    return manifest(leaves.select("grp", "id", "leaf", F.coalesce("other", "leaf").alias("claim"))).withColumnRenamed("id", id_col)
