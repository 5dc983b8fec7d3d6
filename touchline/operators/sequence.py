"""Sequence operators: runs, segments, fills, smoothing and folds that have a window form.

Every function takes the columns that name an entity (`by`) and its order (`order`); windows are partitioned by entity, so
a sequence is one task's work and entities spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.operators.ordered import quantiles


def _w(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def number_runs(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """df with a number that grows by one at every row where `starts` holds; the first row always starts one."""
    w = _w(by, order)
    first = F.row_number().over(w) == 1
    return df.withColumn("__first", (first | F.coalesce(starts, F.lit(False))).cast("long")).withColumn(name, F.sum("__first").over(w)).drop("__first")


def spans(df: DataFrame, by: list[str], order: list[str], labels: list[str], time: str, value: str) -> DataFrame:
    """Run-length encoding: a row per maximal run of equal labels with its ends, duration, size and mean value."""
    w = _w(by, order)
    changed = F.lit(False)
    for c in labels:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = number_runs(df.withColumn("__changed", changed), by, order, F.col("__changed"))
    return runs.groupBy(*by, "run", *labels).agg(
        F.min(time).alias("start_t"), F.max(time).alias("end_t"), (F.max(time) - F.min(time)).alias("duration"),
        F.count("*").alias("n"), F.avg(value).alias("mean_value"),
    )


def absorb_short(found: DataFrame, by: list[str], label: str, shortest: float, unknown: str) -> DataFrame:
    """Spans shorter than `shortest` go to the kept span before them, unless they or the span before are unknown.

    Kept are the first span, long ones, unknown ones, and those right after an unknown one: the last kept span is unknown
    exactly when the span just before is. The kept span's label and mean stay as they are; its end moves.
    """
    w = _w(by, ["run"])
    kept = (F.row_number().over(w) == 1) | (F.col("duration") >= shortest) | (F.col(label) == unknown) | (F.lag(label).over(w) == unknown)
    marked = found.withColumn("kept", kept.cast("int")).withColumn("group", F.sum("kept").over(w))
    pick = lambda c: F.max(F.when(F.col("kept") == 1, F.col(c))).alias(c)
    return marked.groupBy(*by, "group").agg(pick(label), F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.count("*").alias("n_spans"), pick("mean_value"))


def segments(df: DataFrame, by: list[str], order: list[str], time: str, gap: float, least: int = 2) -> DataFrame:
    """Gaps and islands: a new segment where the step in time exceeds the gap; segments under `least` rows are left out."""
    step = F.col(time) - F.lag(time).over(_w(by, order))
    runs = number_runs(df.withColumn("__step", step), by, order, F.col("__step") > gap, "segment")
    found = runs.groupBy(*by, "segment").agg(F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def true_runs(df: DataFrame, by: list[str], order: list[str], flag: Column, time: str, least: int = 1) -> DataFrame:
    """Maximal runs of rows for which the flag holds, with at least `least` rows."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    runs = number_runs(marked, by, order, F.col("__flag") != F.lag("__flag").over(_w(by, order))).where("__flag")
    return runs.groupBy(*by, "run").agg(F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def fill_between(df: DataFrame, by: list[str], order: list[str], position: str, value: str, longest: int) -> DataFrame:
    """Linear interpolation of null values between known ones at most `longest` positions apart: `filled`, `method`, `confidence`."""
    w = _w(by, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    out = df.withColumn("__a", F.last(known, ignorenulls=True).over(before)).withColumn("__b", F.first(known, ignorenulls=True).over(after))
    span = F.col("__b.p") - F.col("__a.p")
    inside = F.col(value).isNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull() & (span <= longest)
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(position) - F.col("__a.p")) / span
    return out.select(
        *df.columns,
        F.when(F.col(value).isNotNull(), F.col(value)).when(inside, line).alias("filled"),
        F.when(F.col(value).isNotNull(), "observed").when(inside, "interpolated").otherwise("unknown").alias("method"),
        F.when(F.col(value).isNotNull(), 1.0).when(inside, F.greatest(F.lit(0.1), 1 - span / (2.0 * (longest + 1)))).otherwise(0.0).alias("confidence"),
    )


def carry_forward(df: DataFrame, by: list[str], order: list[str], position: str, value: str, longest: int) -> DataFrame:
    """The last known value for up to `longest` positions, its confidence falling linearly to 0."""
    before = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    out = df.withColumn("__k", F.last(known, ignorenulls=True).over(before)).withColumn("age", F.col(position) - F.col("__k.p"))
    fresh = F.col("age") <= longest
    return out.withColumn("carried", F.when(fresh, F.col("__k.v"))).withColumn("confidence", F.when(fresh, 1 - F.col("age") / float(longest + 1)).otherwise(0.0)).drop("__k")


def centred_mean(df: DataFrame, by: list[str], order: list[str], value: str, half: int, name: str = "smooth") -> DataFrame:
    """Centred moving average that skips nulls."""
    return df.withColumn(name, F.avg(value).over(_w(by, order).rowsBetween(-half, half)))


def differences(df: DataFrame, by: list[str], order: list[str], time: str, value: str) -> DataFrame:
    """Backward difference per unit of time as `velocity` (the first row takes the forward one), and `acceleration`."""
    w = _w(by, order)
    back = F.try_divide(F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w))
    ahead = F.try_divide(F.lead(value).over(w) - F.col(value), F.lead(time).over(w) - F.col(time))
    out = df.withColumn("velocity", F.when(F.lag(time).over(w).isNull(), ahead).otherwise(back))
    return out.withColumn("acceleration", F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))


def neighbour_support(df: DataFrame, by: list[str], order: list[str], value: str, half: int, radius: float) -> DataFrame:
    """How many of the `half` rows before and after lie within `radius` of a row's value."""
    near = F.collect_list(value).over(_w(by, order).rowsBetween(-half, half))
    mine = F.col(value)
    out = df.withColumn("__near", near)
    return out.withColumn("support", F.size(F.filter("__near", lambda v: F.abs(v - mine) <= radius)) - 1).drop("__near")


def off_median(df: DataFrame, by: list[str], order: list[str], value: str, half: int, jump: float, least: int = 4) -> DataFrame:
    """Whether a value is further than `jump` from the median of its neighbours, itself excluded; needs `least` of them."""
    w = _w(by, order)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-half, -1)), F.collect_list(value).over(w.rowsBetween(1, half)))
    out = df.withColumn("__s", F.sort_array(around)).withColumn("__n", F.size("__s"))
    at = lambda i: F.try_element_at("__s", i.cast("int"))
    middle = (at(F.floor((F.col("__n") + 1) / 2)) + at(F.floor((F.col("__n") + 2) / 2))) / 2
    return out.withColumn("outlier", (F.col("__n") >= least) & (F.abs(F.col(value) - middle) > jump)).drop("__s", "__n")


def cut_threshold(df: DataFrame, value: str, mads: float = 8.0) -> DataFrame:
    """One row: the larger of median + mads * MAD and the 99th percentile, from exact quantiles that no task sees whole."""
    pick = lambda q, share, name: q.where(F.abs(F.col("share") - share) < 1e-9).select(F.col("quantile").alias(name))
    first = quantiles(df.select(value), [], value, [0.5, 0.99])
    middle = pick(first, 0.5, "median").crossJoin(pick(first, 0.99, "p99"))  # one row each
    away = df.select(value).crossJoin(F.broadcast(middle)).select(F.abs(F.col(value) - F.col("median")).alias("away"))
    spread = pick(quantiles(away, [], "away", [0.5]), 0.5, "mad")
    return middle.crossJoin(spread).select("median", "mad", F.greatest(F.col("median") + mads * F.col("mad"), "p99").alias("threshold"))


def rising_edges(df: DataFrame, by: list[str], order: list[str], inside: Column) -> DataFrame:
    """(by, entries): how often the condition becomes true, a true first row counting."""
    out = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    out = out.withColumn("__edge", F.col("__in") & ~F.coalesce(F.lag("__in").over(_w(by, order)), F.lit(False)))
    return out.groupBy(*by).agg(F.count_if("__edge").alias("entries"))


def owner_carry(df: DataFrame, by: list[str], order: list[str], state: str, owner: str, time: str, held: str, clearing: tuple[str, ...]) -> DataFrame:
    """The holder before each row and since when it holds: kept through other states, cleared by the `clearing` ones.

    Window form of the fold: eras end with a clearing row; in an era a holding starts where a held row's owner
    differs from the one held before; a row sees the last earlier held row of its era.
    """
    w = _w(by, order)
    cleared = F.sum(F.col(state).isin(*clearing).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("era", F.coalesce(cleared, F.lit(0)))
    era = _w([*by, "era"], order)
    earlier = era.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(state) == held, F.col(owner))
    out = out.withColumn("previous_owner", F.last(own, ignorenulls=True).over(earlier))
    starts = F.when((F.col(state) == held) & ~F.col(owner).eqNullSafe(F.col("previous_owner")), F.col(time))
    out = out.withColumn("__start", starts)
    return out.withColumn("held_since", F.when(F.col("previous_owner").isNotNull(), F.last("__start", ignorenulls=True).over(earlier))).drop("__start")


def sustained_ahead(df: DataFrame, by: list[str], order: list[str], flag: Column, need: int, share: float = 0.7) -> DataFrame:
    """`sustained`: of this and the next `need` - 1 rows at least that share, and one, fulfil the flag."""
    ahead = _w(by, order).rowsBetween(0, need - 1)
    hits = F.sum(flag.cast("long")).over(ahead)
    return df.withColumn("sustained", hits >= F.greatest(F.lit(1), F.floor(F.count("*").over(ahead) * share)))


def running_shift(df: DataFrame, by: list[str], order: list[str], shift: Column, cut: Column) -> DataFrame:
    """Running sum of shifts that starts again at every cut."""
    out = number_runs(df.withColumn("__cut", cut).withColumn("__shift", shift), by, order, F.col("__cut"), "shot")
    return out.withColumn("moved", F.sum("__shift").over(_w([*by, "shot"], order))).drop("__cut", "__shift")


def keep_owned(rows: DataFrame, chunks: DataFrame, by: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose position their chunk owns, (by, chunk, dropped) counts). rows: by, chunk, position; chunks: by, chunk, own_from, own_to.

    Chunks overlap and ownership tiles, so what every chunk keeps is the union without duplicates.
    """
    marked = rows.join(chunks.select(*by, "chunk", "own_from", "own_to"), [*by, "chunk"])
    owned = F.col(position).between(F.col("own_from"), F.col("own_to"))
    return marked.where(owned).select(*rows.columns), marked.groupBy(*by, "chunk").agg(F.count_if(~owned).alias("dropped"))
