"""Splits, samples and selections; all are functions of the rows, not of their order."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .aggregates import prefix_sums


def hash_key(*parts: Column) -> Column:
    """A stable pseudo-random sort key: SHA-1 of the parts joined by a bar."""
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def cap_per_group(df: DataFrame, by: str, key: Column, cap: int) -> DataFrame:
    """The first `cap` rows of each group in the order of a key; Spark cuts each task's rows to as many before shuffling."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("rank") <= cap)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def modulo_sample(df: DataFrame, a: Column, b: Column, modulus: int) -> DataFrame:
    return df.where(F.abs((a * 31 + b * 17) % modulus) == 0)


def latest(df: DataFrame, by: str, value: str, order: Column) -> DataFrame:
    """The value of each group's greatest order, by aggregation."""
    return df.groupBy(by).agg(F.max_by(value, order).alias(value))


#: Rows of a slice of a group in the fills; a task holds the running cost of one slice.
SLICE = 1_000_000
#: What the fills fold row by row at the end: so many rows of a group (budget_fill) or of all (balanced_fill).
TOGETHER = 20_000


def _placed(df: DataFrame, by: str, key: str, cost: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a cost, with their place in their group (_i) and its slice (_s); and the slices of each group."""
    names = list(dict.fromkeys([by, key, cost, *keep]))
    kind = df.schema[cost].dataType
    price = "double" if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else f"decimal(30,{kind.scale})" if isinstance(kind, T.DecimalType) else "bigint"
    rows = df.where(F.col(cost).isNotNull()).select(F.struct(F.col(by).alias("g")).alias("_g"), F.col(cost).cast(price).alias("_c"), F.struct(*names).alias("_row"), F.struct(*names[1:]).alias("_at"), F.lit(1).alias("_one"))
    ranked = prefix_sums(rows, ["_g"], "_at", ["_one"]).withColumnRenamed("_one_to", "_i")
    placed = cut(ranked.select("_g", "_c", "_row", "_i", F.floor((F.col("_i") - 1) / SLICE).alias("_s")), "placed")
    return placed, cut(placed.select("_g", "_s").distinct(), "slices")


def _near(placed: DataFrame, slices: DataFrame, state: DataFrame) -> DataFrame:
    """Of each group with something left, the rows after its place that fit; _fine: at most half of what is left."""
    of = slices.join(state.where("_left IS NOT NULL").drop("_past"), "_g").where((F.col("_s") + 1) * SLICE > F.col("_after"))
    near = placed.join(of, ["_g", "_s"]).where((F.col("_i") > F.col("_after")) & (F.col("_c") <= F.col("_left")))
    near = near.withColumn("_fine", F.col("_c") <= F.col("_left") - F.col("_c"))
    return near.withColumn("_small", F.when(F.col("_fine"), F.col("_c")).otherwise(F.lit(0)).cast(placed.schema["_c"].dataType))


def _sums(near: DataFrame) -> DataFrame:
    return cut(near.groupBy("_g", "_s").agg(F.sum("_small").alias("_sum"), F.count(F.lit(1)).alias("_n")), "sums")


def _running(near: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds _to: what the group's small rows cost up to and with each row."""
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_g", "_s", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_b"))
    inside = F.sum("_small").over(Window.partitionBy("_g", "_s").orderBy("_i"))
    return near.withColumn("_in", inside).join(before, ["_g", "_s"]).withColumn("_to", (F.col("_b") + F.col("_in")).cast(near.schema["_c"].dataType))


def _halving(to: Column, left: Column) -> Column:
    """Whether a row brings what is left to under a half: a small one by the sum up to it, another one by itself, if it fits."""
    return F.when(F.col("_fine"), to > left - to).otherwise(to + F.col("_c") <= left)


def _round(after: Column, left: Column, upto: Column, event: Column) -> Column:
    return F.struct(after.cast("long").alias("after"), left.alias("left"), upto.cast("long").alias("upto"), event.cast("long").alias("event"))


def _taken(placed: DataFrame, slices: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that the rounds took: small ones up to where a round ended, and the row that ended it."""
    of, i, c = slices.join(state.select("_g", "_past"), "_g"), F.col("_i"), F.col("_c")
    hit = F.exists("_past", lambda h: (i > h["after"]) & F.coalesce(i <= h["upto"], F.lit(True)) & (i.eqNullSafe(h["event"]) | (c <= h["left"] - c)))
    return placed.join(of, ["_g", "_s"]).where(hit).select("_row")


def budget_fill(df: DataFrame, by: str, key: str, cost: str, target: int, keep: list[str], together: int = TOGETHER) -> DataFrame:
    """For each group, rows in key order until their cost reaches the target.

    A row that would exceed it is skipped, and later ones are still tried; the first row is always taken. Rows without a
    cost are skipped; costs are not negative. Rows of equal keys follow in the order of their costs and kept columns.

    What a row does depends on all before it, but not on each alone: as long as the rows that cost at most half of what
    is left sum to at most that half, each of them is taken, so running sums over slices of a group find the first row
    that brings what is left below the half. A round does that for all groups, and as many rounds as a target has bits
    settle any group, however large, without one task for it. Once no group has more than `together` rows that still
    fit, those are folded one by one.
    """
    placed, slices = _placed(df, by, key, cost, keep)
    kind, one = placed.schema["_c"].dataType, F.lit(1)
    over = lambda left: F.when(left > 0, left.cast(kind))
    state = placed.where("_i = 1").select("_g", one.cast("long").alias("_after"), over(F.lit(target) - F.col("_c")).alias("_left"), F.array(_round(F.lit(0), F.col("_c"), one, one)).alias("_past"))
    while True:
        near = _near(placed, slices, state)
        sums = _sums(near)
        if (sums.groupBy("_g").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0) <= together:
            break
        ends = _running(near, sums).where(_halving(F.col("_to"), F.col("_left")))
        spent = F.when(F.col("_fine"), F.col("_to")).otherwise(F.col("_to") + F.col("_c"))
        ends = ends.groupBy("_g").agg(F.min(F.struct(F.col("_i").alias("i"), spent.alias("spent"))).alias("_e"))
        past = F.concat("_past", F.array(_round(F.col("_after"), F.col("_left"), F.col("_e.i"), F.col("_e.i"))))
        state = cut(state.join(ends, "_g", "left").select("_g", F.coalesce("_e.i", "_after").alias("_after"), over(F.col("_left") - F.col("_e.spent")).alias("_left"), F.when(F.col("_left").isNotNull(), past).otherwise(F.col("_past")).alias("_past")), "fill")
    names = list(dict.fromkeys([by, *keep]))
    row = [F.col("_row")[c].alias(c) for c in names]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, left = None, 0
        for pdf in batches:
            rows = []
            for i, (g, has, c) in enumerate(zip(pdf["_group"], pdf["_left"], pdf["_c"], strict=True)):
                if g != group:
                    group, left = g, has
                if left > 0 and c <= left:
                    rows.append(i)
                    left -= c
            yield pdf.iloc[rows][names]

    kinds = dict(df.dtypes)
    rest = near.withColumn("_group", F.to_json("_g")).repartition("_g").sortWithinPartitions("_g", "_i").select(*row, "_group", "_left", "_c")
    return _taken(placed, slices, state).select(*row).unionByName(rest.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in names)))


def balanced_fill(df: DataFrame, groups: str, key: str, cost: str, target: int, keep: list[str], seed: int | None = None, together: int = TOGETHER) -> DataFrame:
    """Round by round, the group with the least cost so far gives its next row that still fits the overall target.

    Groups of equal cost take turns by a seeded hash of their names, or by the names where seed is None. Rows that don't
    fit, or have no cost, are skipped; costs are not negative. Rows of equal keys follow in the order of their costs and
    kept columns.

    As long as only rows that cost at most half of what is left are taken, a row's turn is known: it comes when its group
    has spent what the group's small rows before it cost. Running sums in the order of these turns, over ranges of them,
    find the first row that brings what is left below the half, as budget_fill does within groups; so as many rounds as
    the target has bits settle any table. At most `together` rows that still fit are folded on the driver at the end, by
    their places and costs only.
    """
    placed, slices = _placed(df, groups, key, cost, keep)
    kind, name = placed.schema["_c"].dataType, F.col("_g.g")
    turn = F.lit("") if seed is None else F.when(name.isNull(), "").otherwise(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit("group"), name.cast("string")).cast("binary")))
    none = F.lit(None)
    state = slices.select("_g").distinct().select("_g", F.lit(0).cast("long").alias("_after"), F.lit(target).cast(kind).alias("_left"), F.lit(0).cast(kind).alias("_own"))
    state = state.withColumn("_past", F.filter(F.array(_round(F.col("_after"), F.col("_left"), none, none)), lambda h: F.lit(False)))
    while True:
        near = _near(placed, slices, state)
        sums = _sums(near)
        if (sums.agg(F.sum("_n")).first()[0] or 0) <= together:
            break
        own = F.col("_own") + F.col("_to") - F.col("_small")
        turns = _running(near, sums).withColumn("_turn", F.struct(own.alias("own"), name.isNotNull().alias("named"), turn.alias("turn"), name.alias("name"), F.col("_i").alias("i")))
        merged = prefix_sums(turns.select("_g", "_i", "_c", "_left", "_fine", "_small", "_turn", F.lit(1).alias("_one")), [], "_turn", ["_small", "_one"])
        spent = F.when(F.col("_fine"), F.col("_small_to")).otherwise(F.col("_small_to") + F.col("_c"))
        end = merged.where(_halving(F.col("_small_to"), F.col("_left"))).agg(F.min(F.struct(F.col("_one_to").alias("at"), spent.alias("spent"))).alias("e")).first()["e"]
        here = F.col("_one_to").eqNullSafe(F.lit(end and end["at"]))
        passed = merged.where(F.col("_one_to") <= end["at"]) if end else merged
        passed = passed.groupBy("_g").agg(F.max("_i").alias("_upto"), F.max(F.when(here, F.col("_i"))).alias("_event"), F.sum(F.when(here, F.col("_c")).otherwise(F.col("_small"))).alias("_spent"))
        upto = F.coalesce("_upto", "_after")
        left = F.col("_left") - F.lit(end["spent"]) if end else none
        state = cut(state.join(passed, "_g", "left").select("_g", upto.alias("_after"), left.cast(kind).alias("_left"), (F.col("_own") + F.coalesce("_spent", F.lit(0))).cast(kind).alias("_own"), F.concat("_past", F.array(_round(F.col("_after"), F.col("_left"), upto, F.col("_event")))).alias("_past")), "fill")
    rows = near.select("_g", "_own", turn.alias("turn"), "_i", "_c", "_left").collect()
    held, heap, left, out = defaultdict(list), {}, rows[0]["_left"] if rows else 0, []
    for r in sorted(rows, key=lambda r: -r["_i"]):
        held[r["_g"]["g"]].append((r["_i"], r["_c"]))
        heap[r["_g"]["g"]] = (r["_own"], r["_g"]["g"] is not None, r["turn"], r["_g"]["g"])
    heap = list(heap.values())
    heapq.heapify(heap)
    while heap:
        own, named, order, g = heap[0]
        while held[g] and held[g][-1][1] > left:
            held[g].pop()
        if held[g]:
            i, c = held[g].pop()
            left -= c
            out.append(((g,), i))
            heapq.heapreplace(heap, (own + c, named, order, g))
        else:
            heapq.heappop(heap)
    kinds = T.StructType([T.StructField("_g", placed.schema["_g"].dataType), T.StructField("_i", T.LongType())])
    rest = placed.join(F.broadcast(df.sparkSession.createDataFrame(out, kinds)), ["_g", "_i"], "left_semi").select("_row")
    return _taken(placed, slices, state).unionByName(rest).select(*[F.col("_row")[c].alias(c) for c in dict.fromkeys([groups, *keep])])


def quota_select(df: DataFrame, by: str, provider: str, quotas: dict[str, int], n: int, order: list[Column]) -> DataFrame:
    """For each group, n rows: each provider's quota first, then refills from providers with a quota, from those whose quota is 0, from unlisted ones."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    q = F.try_element_at(quota, F.col(provider))
    rows = df.withColumn("_in", F.row_number().over(Window.partitionBy(by, provider).orderBy(*order)))
    tier = F.when(q.isNull(), 3).when(q <= 0, 2).when(F.col("_in") <= q, 0).otherwise(1)
    rows = rows.where(F.col("_in") <= n).withColumn("tier", tier)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("tier", *order))).where(F.col("rank") <= n).drop("_in")
