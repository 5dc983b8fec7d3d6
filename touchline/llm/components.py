"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import hot_bar, materialise, split_join


def _star(arcs: DataFrame, keep_larger: bool, rows: int) -> DataFrame:
    """Re-hang the chosen neighbours of each u on the least of its neighbourhood. arcs: u, v both ways or downwards.

    The arcs of a hub with more than a thousandth of all `rows` arcs are not gathered: the hub's least travels to them.
    """
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    hot = least.where(F.col("n") > hot_bar(rows)).select("u")
    least = least.drop("n")
    hung = split_join(arcs, least, "u", hot)
    if keep_larger:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node it reaches.

    Every round is two aggregations and joins on the node, so no group of edges is gathered in one task,
    and the number of rounds grows with the logarithm of the longest path. Self-loops and null ends are ignored.
    """
    arcs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    arcs, before = materialise(arcs, "arcs"), None
    rows = arcs.count()
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both, keep_larger=True, rows=2 * rows).distinct(), "arcs")
        arcs = materialise(_star(large, keep_larger=False, rows=rows).distinct(), "arcs")
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    roots = arcs.select(F.col("v").alias("node")).distinct()
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
