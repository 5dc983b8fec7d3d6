"""Order-dependent sums and quantiles of groups of any size: range partitions and their offsets instead of one window a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.staging import materialise, shuffled


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of the columns over the rows of their group up to and with their own.

    Rows are range-partitioned by group and order, so that a large group spreads over many tasks; a group's totals in
    earlier partitions, at most one row a partition and group, are its offsets. The order has to be total, else rows that tie
    come in any order. Group columns may be null.
    """
    keys = [*(F.col(c) for c in by), *order]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__i", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__p", F.shiftright("__i", 33))
    local = Window.partitionBy(*by, "__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*by, "__p").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__p").alias("__q"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums))
    within = placed.withColumns({n: F.sum(c).over(local) for n, c in sums.items()})
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = within.join(parts, same)
    return joined.select(*rows.columns, *((F.col(n) + F.col(f"__before_{n}")).alias(n) for n in sums))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 1024, few: int = 10_000) -> DataFrame:
    """(by, share, quantile): exact quantiles with linear interpolation between neighbours; nulls and NaN count as missing.

    A quantile lies between the values of two ranks. Each is searched by counting values in equal ranges of the interval where
    it must lie, and going on inside the one range that holds it until that has `few` distinct values or cannot be cut;
    only the rows of such ranges are then ordered. No group is sorted whole. A group without values gives no row.
    """
    v = F.col(value).cast("double")
    known = rows.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    known = materialise(known, "distinct-values")
    ends = known.groupBy(*by).agg(F.sum("__n").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).where("n > 0")
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    wanted = ends.select("*", share.alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = wanted.select(*by, "lo", "hi", F.explode(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))).alias("rank")).distinct()
    open_ = materialise(ranks.withColumn("below", F.lit(0).cast("long")), "ranks")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    # Without groups the ranks are a handful of rows; with groups they are joined on them.
    few_rows = (lambda df: df) if by else F.broadcast
    found = None
    while True:
        # `lo` and `hi` are inclusive; bin bounds are values, so no value falls between two bins.
        step = (F.col("r.hi") - F.col("r.lo")) / bins
        bin_ = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("v.__v") - F.col("r.lo")) / step))).otherwise(0)
        inside = known.alias("v").join(few_rows(open_.alias("r")), [*same("v", "r"), F.col("v.__v").between(F.col("r.lo"), F.col("r.hi"))])
        counts = inside.groupBy(*(F.col(f"r.{c}").alias(c) for c in by), "r.rank", "r.below", bin_.alias("bin")).agg(
            F.sum("v.__n").alias("here"), F.count("*").alias("distinct"), F.min("v.__v").alias("lo"), F.max("v.__v").alias("hi")
        )
        w = Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("here").over(w), F.lit(0)))
        hit = materialise(counts.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("here"))).select(*by, "rank", "below", "distinct", "lo", "hi"), "ranks")
        small = hit.where((F.col("distinct") <= few) | (F.col("lo") == F.col("hi")))
        found = small if found is None else found.unionByName(small)
        open_ = hit.where((F.col("distinct") > few) & (F.col("lo") < F.col("hi"))).drop("distinct")
        if open_.isEmpty():
            break
    rest = known.alias("v").join(few_rows(found.alias("r")), [*same("v", "r"), F.col("v.__v").between(F.col("r.lo"), F.col("r.hi"))])
    w = Window.partitionBy(*(f"r.{c}" for c in by), "r.rank").orderBy("v.__v")
    upto = F.col("r.below") + F.sum("v.__n").over(w)
    hits = rest.select(*(F.col(f"r.{c}").alias(c) for c in by), F.col("r.rank").alias("rank"), F.col("v.__v").alias("value"), upto.alias("upto"), (upto - F.col("v.__n")).alias("from"))
    values = hits.where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    a, b = values.alias("a"), values.alias("b")
    w_ = wanted.alias("w")
    both = w_.join(a, [*same("w", "a"), F.floor("w.at").cast("long") == F.col("a.rank")]).join(b, [*same("w", "b"), F.ceil("w.at").cast("long") == F.col("b.rank")])
    between = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("w.at") - F.floor("w.at"))
    return both.select(*(F.col(f"w.{c}").alias(c) for c in by), F.col("w.share").alias("share"), between.alias("quantile"))


def positions(rows: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place from 1 within their group."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")})


def around(rows: DataFrame, by: list[str], position: str, payload: Column, before: int, after: int, name: str = "near") -> DataFrame:
    """rows with `name`, an array of (d, item): payloads of the rows d places on, from -before to after, where they aren't null.

    Rows send their payload to the places around them, so no window over a group is sorted in one task; a place gathers
    before + after + 1 items at most. Positions are unique within their group, and `by` columns are not null.
    """
    sent = rows.select(*by, F.col(position).alias("__from"), payload.alias("item")).where(F.col("item").isNotNull())
    sent = sent.withColumn("d", F.explode(F.sequence(F.lit(-before), F.lit(after)))).select(*by, (F.col("__from") - F.col("d")).alias(position), "d", "item")
    lists = sent.groupBy(*by, position).agg(F.array_sort(F.collect_list(F.struct("d", "item"))).alias(name))
    return rows.join(shuffled(lists), [*by, position], "left").select(*rows.columns, name)
