"""Choices over whole tables that look sequential: groups balanced over splits, rows spread apart under a budget."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import positions
from touchline.operators.staging import materialise


def _orders(sizes: list[tuple[int, int]], targets: list[float]) -> list[tuple[int, int, int, list[int]]]:
    """(size, split, number, leads) of the greedy choice, from a histogram (size, groups), largest first.

    Groups of one size that come one after the other each go to the split furthest below its target, ties to the first
    split. Split j's wants are d_j, d_j - size, d_j - 2 size, ...; the choices are the wants of all splits in falling order.
    So the i-th group of split j comes after i of its own and max(0, i + leads[k]) of each other split k: that is its rank.
    """
    below = [Fraction(t) for t in targets]
    out = []
    for size, groups in sizes:
        leads = []
        for j, mine in enumerate(below):
            deltas = [(other - mine) / size for other in below]
            leads.append([0 if k == j else (math.floor(d) + 1 if k < j else math.ceil(d)) for k, d in enumerate(deltas)])
        rank = lambda j, i: i + sum(max(0, i + leads[j][k]) for k in range(len(below)) if k != j)  # noqa: B023, E731
        for j in range(len(below)):
            lo, hi = 0, groups
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if rank(j, mid) < groups else (lo, mid)
            if lo:
                out.append((size, j, lo, [leads[j][k] for k in range(len(below)) if k != j]))
        for size_, j, n, _ in out:
            if size_ == size:
                below[j] -= n * size
    return out


def balanced_splits(rows: DataFrame, group: list[str], ratios: dict[str, float], seed: str) -> DataFrame:
    """(group, n, split): whole groups dealt to splits, largest first, each to the split furthest below its share of the rows.

    Groups of one size come in the order of the SHA-256 of `seed/group`; ties go to the split named first. Only the
    histogram of group sizes reaches the driver, which has at most the root of twice the number of rows; where each group of
    a size goes follows from its rank by a formula of whole numbers, so groups are dealt in parallel. Rows with a null in group
    form a group. The ratios must add up to 1.
    """
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError(f"ratios add up to {sum(ratios.values())}, not 1")
    spark: SparkSession = rows.sparkSession
    groups = materialise(rows.groupBy(*group).agg(F.count("*").alias("n")).withColumn("__key", seeded(seed, *group)), "groups")
    histogram = [(r["n"], r["c"]) for r in groups.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()]
    total = sum(n * c for n, c in histogram)
    names = list(ratios)
    orders = _orders(histogram, [ratios[name] * total for name in names])
    plan = spark.createDataFrame([(n, names[j], count, leads) for n, j, count, leads in orders], "n long, split string, count long, leads array<long>")
    i = F.col("i")
    slots = plan.select("n", "split", "leads", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    slots = slots.select("n", "split", (i + F.aggregate("leads", F.lit(0).cast("long"), lambda s, a: s + F.greatest(F.lit(0).cast("long"), i + a)) + 1).alias("__rank"))
    ranked = positions(groups, ["n"], [F.col("__key"), *(F.col(c) for c in group)], "__rank")
    return ranked.join(slots, ["n", "__rank"]).select(*group, "n", "split")


def seeded(seed: int | str, *columns: str) -> Column:
    """A random-looking order of rows that a seed fixes: the SHA-256 of seed and columns, joined by '/'."""
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def spread_apart(rows: DataFrame, by: list[str], position: str, gap: int, priority: Column, taken: DataFrame | None = None) -> DataFrame:
    """The rows kept when rows are looked at by rising priority and each is kept if none kept before lies nearer than `gap`.

    rows: by + position and more, positions unique within by; taken: by + position of rows kept earlier. Every round keeps the
    rows whose priority is the least within the gap and drops those around them, which is what the row-by-row choice would do; rounds
    grow with the logarithm of the rows within reach. Rows meet in cells of `gap` places, never all with all.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / gap) + d).cast("long")
    first = rows.select(*by, F.col(position).cast("long").alias("__at"), priority.alias("__prio"))
    near = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))

    def clear_of(left: DataFrame, kept: DataFrame) -> DataFrame:
        around = kept.select(*by, F.col("__at").alias("__k"), near.alias("__d")).select(*by, "__k", (cell("__k") + F.col("__d")).alias("__c"))
        hit = left.withColumn("__c", cell("__at")).join(around, [*by, "__c"]).where(F.abs(F.col("__at") - F.col("__k")) < gap).select(*by, "__at").distinct()
        return left.join(hit, [*by, "__at"], "left_anti")

    open_ = first if taken is None else clear_of(first, taken.select(*by, F.col(position).cast("long").alias("__at")))
    open_, kept = materialise(open_, "open-rows"), None
    while True:
        mine = F.struct("__prio", "__at")
        others = open_.select(*by, mine.alias("__o"), near.alias("__d")).select(*by, "__o", (cell("__o.__at") + F.col("__d")).alias("__c"))
        best = open_.withColumn("__c", cell("__at")).join(others, [*by, "__c"]).where(F.abs(F.col("__at") - F.col("__o.__at")) < gap).groupBy(*by, "__at").agg(F.min("__o").alias("__best"))
        now = materialise(best.where(F.col("__best.__at") == F.col("__at")).select(*by, "__at"), "kept-rows")
        kept = now if kept is None else kept.unionByName(now)
        open_ = materialise(clear_of(open_, now), "open-rows")
        if open_.isEmpty():
            break
    chosen = kept.withColumnRenamed("__at", position)
    return rows.join(chosen, [*by, position], "left_semi")


def spread_sample(rows: DataFrame, by: list[str], position: str, stratum: str, quotas: dict[str, int], gap: int, seed: int) -> DataFrame:
    """rows chosen for each stratum, at most its quota in each group, no two of a group nearer than `gap`; with `stratum` and `picked`.

    Strata are filled in the order of quotas, each in an order drawn from the SHA-256 of seed, group and position; what a stratum can't
    fill is added to the quota of the next one. picked is the place in that order. Rows of other strata, or with a null
    position, take no part.
    """
    rank = seeded(seed, *by, position)
    known = rows.where(F.col(position).isNotNull())
    taken, spill, out = None, None, None
    for name, quota in quotas.items():
        pool = known.where(F.col(stratum) == name)
        kept = spread_apart(pool, by, position, gap, rank, taken).withColumn("picked", F.row_number().over(Window.partitionBy(*by).orderBy(rank, position)))
        limit = F.lit(quota) if spill is None else F.lit(quota) + F.coalesce("__spill", F.lit(0))
        joined = kept if spill is None else kept.join(spill, by, "left")
        chosen = materialise(joined.where(F.col("picked") <= limit).select(*rows.columns, "picked"), "picked")
        found = chosen.groupBy(*by).agg(F.count("*").alias("__n"))
        whole = known.select(*by).distinct().join(found, by, "left")
        whole = whole if spill is None else whole.join(spill, by, "left")
        left = (F.lit(quota) if spill is None else F.lit(quota) + F.coalesce("__spill", F.lit(0))) - F.coalesce("__n", F.lit(0))
        spill = materialise(whole.select(*by, left.cast("long").alias("__spill")), "spill")
        out = chosen if out is None else out.unionByName(chosen)
        taken = out.select(*by, position)
    return out
