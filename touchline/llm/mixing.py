"""Mixing sources to target weights by a splitting tree over blocks; DataFrame and SQL functions only.

1. Targets: sources share the corpus by weight, no source above a multiple of its own size; a water level over the
   sources' size-to-weight ratios gives where the excess of the capped ones goes.
2. Blocks: each source's documents are cut by hash into blocks of about `block_docs`, and its blocks are permuted. A
   source's quota is a number of block copies: every block a whole number of times and, in permuted order, the blocks of
   one more round until its target is met; of the block in which that happens it takes the largest documents that fit.
3. Splitting tree: from the root's quotas by source, every node of the tree sends half of its block copies to its left
   child. How many of each source go is drawn multivariate hypergeometrically, source by source from the exact conditional
   distribution, so that a node's quotas always sum to its size and both children's to the node's. The leaves are the
   output shards.
4. A shard draws from each source as many of the permuted copies as its leaf has quota, next to those of the shard before
   it: draws are disjoint and cover the quota. What a document gives follows from the draws of its block; a shard's copies
   are shuffled by hash within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_rank, n_docs, source_size, target) from doc_id, source, size rows.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. The result and its windows
    have one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) - before) / after)
    # Sources whose cap lies under the level at their place are capped; the first other one has the final level.
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))
    settled = levels.withColumn("level", F.min(free).over(everything).getField("level"))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return settled.select("source", "source_rank", "n_docs", "source_size", target.cast("double").alias("target"))


def _in_order(blocks: DataFrame, key: Column, ties: list[str]) -> DataFrame:
    """blocks with `place`, the rank from 1 by key within its source, and `before`, the words of the blocks before it.

    Ranges of the key are ranked on their own and shifted by the sums of the ranges before, at most 1024 a source; no task
    sees all blocks of a source.
    """
    split = materialise(blocks.withColumn("key_", key).withColumn("range_", F.shiftrightunsigned("key_", 54)), "ranges")
    sums = split.groupBy("source_rank", "range_").agg(F.count("*").alias("n_"), F.sum("words").alias("w_"))
    ordered = Window.partitionBy("source_rank").orderBy("range_")
    sums = sums.select("source_rank", "range_", (F.sum("n_").over(ordered) - F.col("n_")).alias("n_"), (F.sum("w_").over(ordered) - F.col("w_")).alias("w_"))
    inner = Window.partitionBy("source_rank", "range_").orderBy("key_", *ties)
    local = split.withColumn("place", F.row_number().over(inner)).withColumn("before", F.sum("words").over(inner) - F.col("words"))
    both = local.join(sums, ["source_rank", "range_"])
    return both.select(*blocks.columns, (F.col("n_") + F.col("place")).alias("place"), (F.col("w_") + F.col("before")).alias("before"))


def _let(name: str, value: str, body: str) -> str:
    """body with the value, evaluated once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Logarithm of the ratio of the probabilities of k and k - 1; 0 for the least k.
_RATIO = "if(k > p.low, ln((p.marked - k + 1) * (p.drawn - k + 1)) - ln(k * (p.total - p.marked - p.drawn + k)), 0D)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for how many of `marked` items of `total` are among `drawn` of them, by inverting the distribution at u in [0, 1).

    Probabilities follow from the mode by their ratios. Numbers further from it than 12 standard deviations and 60 are left
    out: their probability is under 1e-16 (Bernstein's bound), the resolution of u.
    """
    given = f"struct(double({total}) as total, double({marked}) as marked, double({drawn}) as drawn, {u} as u, double({marked}) / greatest(double({total}), 1D) as share)"
    around = """struct(
        least(g.marked, g.drawn, greatest(0D, g.drawn - g.total + g.marked, double(floor((g.drawn + 1) * (g.marked + 1) / (g.total + 2))))) as mode,
        12 * sqrt(g.drawn * g.share * (1 - g.share) * (g.total - g.drawn) / greatest(g.total - 1, 1D)) + 60 as reach)"""
    bounds = """struct(g.total as total, g.marked as marked, g.drawn as drawn, g.u as u, bigint(m.mode) as mode,
        bigint(ceil(greatest(0D, g.drawn - g.total + g.marked, m.mode - m.reach))) as low, bigint(floor(least(g.marked, g.drawn, m.mode + m.reach))) as high)"""
    start = f"aggregate(sequence(p.low, p.mode), 0D, (s, k) -> s - {_RATIO})"
    add = _let("l", f"s.log + {_RATIO}", "struct(l as log, s.sum + exp(l) as sum)")
    whole = f"aggregate(sequence(p.low, p.high), struct(q as log, 0D as sum), (s, k) -> {add}).sum"
    step = _let("l", f"s.log + {_RATIO}", "struct(l as log, s.sum + exp(l) as sum, if(s.sum <= w.bar, k, s.at) as at)")
    pick = f"aggregate(sequence(p.low, p.high), struct(w.log as log, 0D as sum, p.low as at), (s, k) -> {step}).at"
    found = _let("q", start, _let("w", f"struct(q as log, p.u * {whole} as bar)", pick))
    return _let("g", given, _let("p", _let("m", around, bounds), found))


def quota_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_rank, quota): block quotas by source of the tree's leaves. quotas: source_rank, quota of the root.

    A row is a node with one quota a source; shards are rounded up to a power of two. Of an odd number of copies the
    children take the larger half in turn.
    """
    own = "sort_array(collect_list(struct(source_rank, bigint(quota) as quota)))"
    nodes = quotas.groupBy().agg(F.expr(own).alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(max(0, shards - 1).bit_length()):
        noise = f"shiftrightunsigned(xxhash64({seed}, {level}, node, x.source_rank), 11) / {float(1 << 53)}D"
        keep = "struct(s.total - x.quota as total, s.half - n as half, concat(s.drawn, array(n)) as drawn)"
        draw = _let("n", hypergeometric("s.total", "x.quota", "s.half", noise), keep)
        begin = _let("t", "aggregate(q, 0L, (s, x) -> s + x.quota)", "struct(t as total, bigint(floor((t + node % 2) / 2)) as half, cast(array() as array<bigint>) as drawn)")
        nodes = nodes.select("node", "q", F.expr(f"aggregate(q, {begin}, (s, x) -> {draw}).drawn").alias("drawn"))
        left, right = (f"zip_with(q, drawn, (x, n) -> struct(x.source_rank as source_rank, {rest} as quota))" for rest in ("n", "x.quota - n"))
        nodes = nodes.select(F.expr(f"inline(array(struct(node * 2 as node, {left} as q), struct(node * 2 + 1 as node, {right} as q)))"))
    return nodes.select(F.col("node").alias("shard"), F.inline("q"))


def _last_block(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_rank, block, nr, fits) for the block in which each source's last round ends: which documents still go in.

    The largest go first, each that fits what is left. A source has one such block, of about block_docs documents.
    """
    last = blocks.where("before < rest and before + words > rest").select("source_rank", "block", (F.col("rest") - F.col("before")).alias("gap"))
    lists = placed.join(last, ["source_rank", "block"]).groupBy("source_rank", "block", "gap")
    lists = lists.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "nr"))).alias("rows"))
    nothing = F.array().cast("array<boolean>")
    filled = F.aggregate(
        "rows",
        F.struct(F.col("gap").alias("left"), nothing.alias("fits")),
        lambda state, row: F.struct(
            F.when(-row["less"] <= state["left"], state["left"] + row["less"]).otherwise(state["left"]).alias("left"),
            F.concat(state["fits"], F.array(-row["less"] <= state["left"])).alias("fits"),
        ),
    )
    zipped = lists.select("source_rank", "block", F.explode(F.arrays_zip("rows", filled["fits"].alias("fits"))).alias("z"))
    return zipped.select("source_rank", "block", F.col("z.rows.nr").alias("nr"), F.col("z.fits").alias("fits"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 8, block_docs: int = 500, seed: int = 20
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, copies, shards).

    size is the number of words (null text: 0), taken the words that the mix takes of it, repeats counted, and shards
    the output shard of each copy. Documents without words take no words but are dealt like others. Rows that repeat an
    id are documents of their own; other columns are ignored; an empty table gives an empty result. The same table and
    seed give the same mix.
    """
    return _deal(docs, [], weights, most, shards, block_docs, seed)


def _deal(docs: DataFrame, keys: list[str], weights: tuple[int, ...], most: int, shards: int, block_docs: int, seed: int) -> DataFrame:
    """mix() with the columns `keys` of docs before its own; they decide where a repeated id of the same size ties."""
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")
    sizes = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sizes = materialise(sizes, "sizes")
    sources = materialise(targets(sizes, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    n_blocks = F.ceil(F.col("n_docs") / block_docs)
    placed = (
        sizes.withColumnRenamed("source", "own_source")
        .join(sources, F.expr("own_source <=> source"))
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), n_blocks))
        .select(*keys, "doc_id", "size", "source_rank", "source_size", "target", "whole", "rest", "block", "order")
    )
    inside = Window.partitionBy("source_rank", "block").orderBy("order", "doc_id", "size", *keys)
    placed = materialise(placed.withColumn("nr", F.row_number().over(inside)), "placed")

    blocks = placed.groupBy("source_rank", "block").agg(F.sum("size").alias("words"), F.max("whole").alias("whole"), F.max("rest").alias("rest"))
    blocks = materialise(_in_order(blocks, F.xxhash64("source_rank", "block", F.lit(seed + 2)), ["block"]), "blocks")
    root = blocks.groupBy("source_rank").agg(F.count("*").alias("n"), F.max("whole").alias("whole"), F.count_if(F.col("before") < F.col("rest")).alias("last"))
    leaves = materialise(quota_tree(root.select("source_rank", (F.col("n") * F.col("whole") + F.col("last")).alias("quota")), shards, seed + 3), "leaves")
    # Of a source's permuted copies, shard i draws those after the i-th of `ends` up to the next one. A row for each source.
    upto = F.sum("quota").over(Window.partitionBy("source_rank").orderBy("shard"))
    ends = leaves.withColumn("upto", upto).groupBy("source_rank").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).getField("upto").alias("ends"))
    ends = materialise(root.select("source_rank", F.col("n").alias("n_blocks")).join(ends, "source_rank"), "ends")
    times = F.col("whole") + (F.col("before") < F.col("rest")).cast("int")
    drawn_by = lambda copy: F.size(F.filter("ends", lambda e: e < (copy - 1) * F.col("n_blocks") + F.col("place")))
    drawn = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), drawn_by), lambda s: s < F.size("ends"))
    block = blocks.join(ends, "source_rank").select(
        "source_rank", "block", (F.col("before") + F.col("words") <= F.col("rest")).alias("more"), drawn.alias("shards")
    )

    taken = placed.join(block, ["source_rank", "block"]).join(_last_block(placed, blocks), ["source_rank", "block", "nr"], "left")
    # Of the last block's last copy only the documents that fit are taken; of all other drawn copies every document is.
    fitting = F.when(F.col("more") | (F.col("rest") <= 0) | (F.size("shards") <= F.col("whole")), 0).otherwise(F.when(F.coalesce("fits", F.lit(False)), 0).otherwise(1))
    taken = taken.withColumn("copies", F.size("shards") - fitting)
    return taken.select(
        *keys,
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
        F.slice("shards", 1, F.col("copies")).alias("shards"),
    )


def draw(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 8, block_docs: int = 500, seed: int = 20
) -> DataFrame:
    """The mix itself: docs' columns and `shard`, a row for each copy, in shuffled order within each shard.

    Rows get a key of their own, so null and repeated ids are dealt like others; copies keep their id. A column `shard`
    of docs is replaced; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != "shard"]
    own, row, copy, order, of = fresh(columns, "content_", "row_", "copy_", "order_", "of_")
    content = F.xxhash64("doc_id", "source", "text")
    rows = materialise(docs.select(*columns).withColumn(own, content).withColumn(row, F.monotonically_increasing_id()), "rows")
    dealt = _deal(rows, [own, row], weights, most, shards, block_docs, seed)
    # Written, so that the planner knows its size: while it is small no text is shuffled to meet its copies.
    chosen = materialise(dealt.where("copies > 0").select(F.col(row).alias(of), F.posexplode("shards").alias(copy, "shard")), "chosen")
    drawn = rows.join(chosen, F.col(row) == F.col(of)).withColumn(order, F.xxhash64(own, copy, "shard", F.lit(seed)))
    place = ["shard", order, row]
    return drawn.repartitionByRange(*place).sortWithinPartitions(*place).select(*columns, "shard")
