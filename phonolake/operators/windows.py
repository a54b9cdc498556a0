"""Operators over ordered rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .aggregates import prefix_sums


#: What a stretch covers, in the unit of the time that rows are ordered by: a day of microseconds.
STRETCH = 24 * 3600 * 1_000_000


def stretches(df: DataFrame, by: str, time: str, width: int) -> DataFrame:
    """Adds _k, the key as a struct (so never null), and _s, the number of the stretch of time a row is in.

    Ordered windows run within stretches, so a key with many rows is spread over its stretches. What crosses their edges
    comes from one row for each key and stretch, which are few if the width fits the data. Rows without a time are the
    first stretch, as they are the first rows of an ascending order.
    """
    s = F.coalesce(F.floor(F.col(time) / width), F.lit(-(2**62)).cast("long"))
    return df.withColumn("_k", F.struct(F.col(by).alias("k"))).withColumn("_s", s)


_SO_FAR, _BEFORE = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)


def _within(order: list[str]) -> WindowSpec:
    return Window.partitionBy("_k", "_s").orderBy(*order)


def _across() -> WindowSpec:
    return Window.partitionBy("_k").orderBy("_s")


def _edge(order: list[str], value: Column) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))


def beside(df: DataFrame, by: str, order: list[str], columns: list[str], width: int = STRETCH) -> DataFrame:
    """Adds _prev and _next: structs of the columns of the rows before and after within a key, null at its ends.

    The order ascends and begins with a time; rows that tie in it follow by the columns or in any order.
    """
    rows, value = stretches(df, by, order[0], width), F.struct(*columns)
    edges = rows.groupBy("_k", "_s").agg(F.min(_edge(order, value)).alias("first"), F.max(_edge(order, value)).alias("last"))
    edges = edges.select("_k", "_s", F.lag("last").over(_across())["v"].alias("_b"), F.lead("first").over(_across())["v"].alias("_a"))
    w = _within(order)
    rows = rows.withColumn("_prev", F.lag(value).over(w)).withColumn("_next", F.lead(value).over(w)).join(edges, ["_k", "_s"])
    return rows.select(*df.columns, F.coalesce("_prev", "_b").alias("_prev"), F.coalesce("_next", "_a").alias("_next"))


def running(df: DataFrame, by: str, order: list[str], value: Column, name: str, width: int = STRETCH) -> DataFrame:
    """Adds the sum of a value over a key's rows up to and with each, in an ascending order that begins with a time."""
    rows = stretches(df, by, order[0], width).withColumn("_x", value)
    sums = rows.groupBy("_k", "_s").agg(F.sum("_x").alias("_n"))
    sums = sums.select("_k", "_s", F.sum("_n").over(_across().rowsBetween(*_BEFORE)).alias("_base"))
    rows = rows.withColumn("_in", F.sum("_x").over(_within(order).rowsBetween(*_SO_FAR))).join(sums, ["_k", "_s"])
    total = F.when(F.col("_in").isNull(), F.col("_base")).otherwise(F.col("_in") + F.coalesce("_base", F.lit(0)))
    return rows.select(*df.columns, total.alias(name))


def numbered(df: DataFrame, by: str, order: list[str], columns: list[str], joins: Callable[[Column, Column], Column], name: str, width: int = STRETCH) -> DataFrame:
    """Adds the number (from 1) of the run each row is in: joins(before, here), of structs of the columns of two rows that
    follow each other, tells whether the second goes on with the run of the first.

    Runs are numbered within stretches of time; those that cross an edge are one, which the numbers before it tell.
    """
    rows, w = stretches(df, by, order[0], width).withColumn("_v", F.struct(*columns)), _within(order)
    goes_on = lambda before, here: F.when(before.isNotNull() & joins(before, here), 1).otherwise(0)
    rows = rows.withColumn("_new", 1 - goes_on(F.lag("_v").over(w), F.col("_v")))
    rows = rows.withColumn("_r", F.sum("_new").over(w.rowsBetween(*_SO_FAR)))
    ends = rows.groupBy("_k", "_s").agg(F.min(_edge(order, F.col("_v"))).alias("first"), F.max(_edge(order, F.col("_v"))).alias("last"), F.max("_r").alias("m"))
    ends = ends.withColumn("_on", goes_on(F.lag("last").over(_across())["v"], F.col("first")["v"]))
    base = F.coalesce(F.sum("m").over(_across().rowsBetween(*_BEFORE)), F.lit(0)) - F.sum("_on").over(_across().rowsBetween(*_SO_FAR))
    return rows.join(ends.select("_k", "_s", base.alias("_base")), ["_k", "_s"]).select(*df.columns, (F.col("_base") + F.col("_r")).alias(name))


def neighbours(df: DataFrame, by: str, order: list[str], value: str, width: int = STRETCH) -> DataFrame:
    """prev_<value> and next_<value>: those of the rows before and after within a key, null at its ends."""
    out = beside(df, by, order, [value], width)
    return out.select(*df.columns, F.col("_prev")[value].alias(f"prev_{value}"), F.col("_next")[value].alias(f"next_{value}"))


def with_group_totals(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each row with its group's size and total: aggregated first and joined back, so that a hot group is not one window."""
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("group_n"), F.sum(value).alias("group_total"))
    return df.join(totals, by)


def islands(df: DataFrame, by: str, time: str, order: str, gap: Column, width: int = STRETCH) -> DataFrame:
    """Runs of rows that follow each other by less than gap: first and last time, rows."""
    rows = numbered(df, by, [time, order], [time], lambda before, here: here[time] - before[time] < gap, "island", width)
    return rows.groupBy(by, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, by: str, order: list[str], value: str, score: str, width: int = STRETCH) -> DataFrame:
    """Runs of equal values (nulls are equal): number, value, rows, and the exact mean score."""
    rows = numbered(df, by, order, [value], lambda before, here: before[value].eqNullSafe(here[value]), "run", width)
    mean = F.sum(F.col(score).cast("decimal(20,6)")).cast("double") / F.count(score)
    return rows.groupBy(by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), mean.alias("mean_score"))


def _flagged(df: DataFrame, by: str, order: list[str], flag: Column, width: int) -> DataFrame:
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return numbered(rows, by, order, ["_f"], lambda before, here: before["_f"] == here["_f"], "_run", width)


def longest_run(df: DataFrame, by: str, order: list[str], flag: Column, width: int = STRETCH) -> DataFrame:
    """The longest run of rows with the flag: its length, 0 without one."""
    per = _flagged(df, by, order, flag, width).groupBy(by, "_run").agg(F.sum(F.col("_f").cast("int")).alias("n"))
    return per.groupBy(by).agg(F.max("n").alias("longest"))


def midpoint_bounds(df: DataFrame, by: str, start: str, end: str, width: int = STRETCH) -> DataFrame:
    """Each interval widened to the midpoints (rounded down) between it and its neighbours; the outer edges stay."""
    rows = beside(df, by, [start, end], [start, end], width)
    lo = F.coalesce(F.floor((F.col("_prev")[end] + F.col(start)) / 2), F.col(start))
    hi = F.coalesce(F.floor((F.col(end) + F.col("_next")[start]) / 2), F.col(end))
    return rows.select(*df.columns, lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def peak(df: DataFrame, by: str, order: str, dims: list[str], tie: float = 1e-9) -> DataFrame:
    """The row with the greatest sum of min-max scaled dimensions, and whether the verdict holds.

    Missing values take the group's minimum; dimensions without spread don't count. `low_confidence` if none does or the
    top two tie.
    """
    stats = df.groupBy(by).agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    spread = lambda d: F.col(f"hi_{d}") - F.col(f"lo_{d}")
    part = lambda d: F.when(spread(d) >= tie, (F.coalesce(F.col(d), F.col(f"lo_{d}")) - F.col(f"lo_{d}")) / spread(d)).otherwise(0.0)
    total = sum((part(d) for d in dims[1:]), part(dims[0]))
    usable = sum(((spread(d) >= tie).cast("int") for d in dims[1:]), (spread(dims[0]) >= tie).cast("int"))
    rows = df.join(stats, by).withColumn("_sum", F.round(total, 9)).withColumn("_usable", F.coalesce(usable, F.lit(0)))
    top = rows.groupBy(by).agg(F.max(F.struct("_sum", (-F.col(order)).alias("o"))).alias("m"), F.max("_usable").alias("usable"))
    second = rows.join(top, by).where(F.col(order) != -F.col("m.o")).groupBy(by).agg(F.max("_sum").alias("next"))
    low = (F.col("usable") == 0) | ((F.col("m._sum") - F.col("next")) < tie)
    return top.join(second, by, "left").select(by, (-F.col("m.o")).alias("peak"), F.when(F.coalesce(low, F.lit(False)), "low_confidence").otherwise("ok").alias("verdict"))


def cume_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """The share of the group's rows at or below each distinct value, by prefix sums over ranges of values."""
    per = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    return prefix_sums(per, [by], value, ["c"]).select(by, value, (F.col("c_to") / F.col("c_all")).alias("rank"))


def longest_interval(df: DataFrame, by: str, order: list[str], flag: Column, time: str, width: int = STRETCH) -> DataFrame:
    """The longest run of rows with the flag (the first among equals): its rows and its first and last time."""
    rows = _flagged(df, by, order, flag, width).where("_f")
    per = rows.groupBy(by, "_run").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("s"), F.max(time).alias("e"))
    best = per.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "s", "e")).alias("m"))
    return best.select(by, (-F.col("m.n")).alias("n"), F.col("m.s").alias("start_us"), F.col("m.e").alias("end_us"))
