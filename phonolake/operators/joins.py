"""Joins, overlays and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import STRETCH, stretches


def exists_flag(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether the key occurs in the other table. Its keys are made distinct first, so rows are never multiplied."""
    return df.join(other.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not done yet (for resuming)."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def insert_or_ignore(there: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are there, and those of more whose keys aren't there yet, one for each key; doing it again adds nothing."""
    return there.unionByName(pending(more.dropDuplicates(keys), there, keys))


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of patch replace those of base with the same key; new keys are added; `origin` tells."""
    values = [c for c in base.columns if c != key]
    b, p = base.alias("b"), patch.withColumn("_new", F.lit(1)).alias("p")
    new = F.col("p._new").isNotNull()
    pick = [F.when(new, F.col(f"p.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values]
    joined = b.join(p, F.col(f"b.{key}") == F.col(f"p.{key}"), "full")
    origin = F.when(new & F.col(f"b.{key}").isNotNull(), "replaced").when(new, "added").otherwise("kept")
    return joined.select(F.coalesce(F.col(f"p.{key}"), F.col(f"b.{key}")).alias(key), *pick, origin.alias("origin"))


def overlap_best(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], left_id: str, value: str, bin_size: int) -> DataFrame:
    """Each left interval's best right one: the greatest overlap within the same key, the smallest value among equals.

    Intervals are also keyed by time bins of bin_size, so that a hot key is spread over its bins; a pair that meets in
    several bins counts in the bin where its overlap starts. Left rows without overlap stay, with nulls.
    """
    (ls, le), (rs, re) = left_span, right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)))
    a = left.select(on, left_id, ls, le).where(F.col(le) > F.col(ls)).withColumn("_bin", bins(ls, le))
    b = right.select(on, F.col(rs).alias("_rs"), F.col(re).alias("_re"), F.col(value).alias("_v")).where("_re > _rs").withColumn("_bin", bins("_rs", "_re"))
    start = F.greatest(F.col(ls), F.col("_rs"))
    hit = a.join(b, [on, "_bin"]).where((F.col(ls) < F.col("_re")) & (F.col(le) > F.col("_rs")) & (F.floor(start / bin_size) == F.col("_bin")))
    best = hit.groupBy(left_id).agg(F.max(F.struct((F.least(F.col(le), F.col("_re")) - start).alias("overlap"), (-F.col("_v")).alias("v"))).alias("m"))
    return left.join(best, left_id, "left").select(*left.columns, F.col("m.overlap").alias("overlap"), (-F.col("m.v")).alias(value))


def _around(df: DataFrame, by: str, time: str, other: Column, order: tuple[Column, Column], width: int) -> DataFrame:
    """Adds _b and _a: the last `other` (a struct, null where a row is none) of the rows before each within its key, and
    the first of those after, in two orders that begin with the time.

    Windows run within stretches of time; what lies beyond a stretch comes from one row for each key and stretch.
    """
    rows = stretches(df, by, time, width).withColumn("_o", other).withColumn("_at_b", order[0]).withColumn("_at_a", order[1])
    has = F.col("_o").isNotNull()
    ends = rows.groupBy("_k", "_s").agg(F.max_by("_o", F.when(has, F.col("_at_b"))).alias("last"), F.min_by("_o", F.when(has, F.col("_at_a"))).alias("first"))
    across, within = Window.partitionBy("_k").orderBy("_s"), Window.partitionBy("_k", "_s")
    back, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    ends = ends.select("_k", "_s", F.last("last", True).over(across.rowsBetween(*back)).alias("_eb"), F.first("first", True).over(across.rowsBetween(*ahead)).alias("_ea"))
    rows = rows.withColumn("_b", F.last("_o", True).over(within.orderBy("_at_b").rowsBetween(*back)))
    rows = rows.withColumn("_a", F.first("_o", True).over(within.orderBy("_at_a").rowsBetween(*ahead)))
    return rows.join(ends, ["_k", "_s"]).select(*df.columns, F.coalesce("_b", "_eb").alias("_b"), F.coalesce("_a", "_ea").alias("_a"))


def nearest_before_after(df: DataFrame, by: str, time: str, order: str, is_probe: Column, payload: str, width: int = STRETCH) -> DataFrame:
    """For each probe row the nearest other row of its key in time (the earlier one among equals).

    One window in each direction over the union of both kinds, within stretches of time, instead of a join of all pairs.
    """
    other = F.when(~is_probe, F.struct(F.col(time).alias("t"), F.col(payload).alias("p")))
    at = F.struct(time, order)
    rows = _around(df, by, time, other, (at, at), width).where(is_probe)
    db, da = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    before = F.col("_b").isNotNull() & (F.col("_a").isNull() | (db <= da))
    return rows.withColumn("nearest", F.when(before, F.col("_b.p")).otherwise(F.col("_a.p"))).withColumn("distance", F.when(before, db).otherwise(da)).drop("_a", "_b")


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Ids in both, missing ones, extra ones, and the share covered, as one row."""
    e, g = expected.select(key).distinct().withColumn("_e", F.lit(1)), got.select(key).distinct().withColumn("_g", F.lit(1))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = e.join(g, key, "full").agg(n(F.col("_e").isNotNull() & F.col("_g").isNotNull()).alias("n_both"), n(F.col("_g").isNull()).alias("n_missing"), n(F.col("_e").isNull()).alias("n_extra"))
    return out.withColumn("coverage", F.try_divide(F.col("n_both").cast("double"), F.col("n_both") + F.col("n_missing")))


def overlaps_between(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one part (leaks between splits)."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(part)), ",").alias("parts"), F.countDistinct(part).alias("n_parts")).where("n_parts > 1")


def _meeting(left: DataFrame, right: DataFrame, on: str, bin_size: int) -> DataFrame:
    """Pairs of overlapping intervals (s, e and rs, re) of a key, once each; both sides are dealt out by time bins as well."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)))
    joined = left.withColumn("_bin", bins("s", "e")).join(right.withColumn("_bin", bins("rs", "re")), [on, "_bin"])
    return joined.where("s < re AND e > rs").where(F.floor(F.greatest("s", "rs") / bin_size) == F.col("_bin")).drop("_bin")


def overlap_first(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, primary: str, bin_size: int) -> DataFrame:
    """Each left interval's first right one: primary before not, then the longest overlap, then the smallest id; nulls without any."""
    hit = _meeting(left.select(on, left_id, "s", "e"), right.select(on, right_id, primary, F.col("s").alias("rs"), F.col("e").alias("re")), on, bin_size)
    overlap = F.least("e", "re") - F.greatest("s", "rs")
    best = hit.groupBy(left_id).agg(F.max(F.struct(primary, overlap.alias("overlap"), (-F.col(right_id)).alias("id"))).alias("m"))
    return left.select(left_id).join(best, left_id, "left").select(left_id, (-F.col("m.id")).alias(right_id), F.col(f"m.{primary}").alias(primary), F.col("m.overlap").alias("overlap"))


def nearest_containing(points: DataFrame, intervals: DataFrame, on: str, point_id: str, right_id: str, bin_size: int, width: int = STRETCH) -> DataFrame:
    """Each point's interval: of those that contain it the nearest centre, else the nearest centre of all.

    Containment is a join by time bins; the nearest centre is looked up by windows over points and centres together. So
    no point meets all the intervals of its key.
    """
    centre = F.floor((F.col("rs") + F.col("re")) / 2)
    right = intervals.select(on, right_id, F.col("s").alias("rs"), F.col("e").alias("re"))
    spots = points.select(on, point_id, "t", F.col("t").alias("s"), (F.col("t") + 1).alias("e"))
    inside = _meeting(spots, right, on, bin_size).groupBy(point_id).agg(F.min(F.struct(F.abs(centre - F.col("t")).alias("d"), F.col(right_id).alias("id"))).alias("inside"))
    both = points.select(on, "t", F.col(point_id).alias("_p"), F.lit(None).cast("long").alias("_i")).unionByName(right.select(on, centre.alias("t"), F.lit(None).cast("long").alias("_p"), F.col(right_id).alias("_i")))
    mark = F.when(F.col("_i").isNotNull(), F.struct("t", F.col("_i").alias("id")))
    order = F.struct("t", F.col("_i").isNull(), -F.col("_i")), F.struct("t", F.col("_i").isNotNull(), "_i")
    near = _around(both, on, "t", mark, order, width).where("_p IS NOT NULL")
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("d"), F.col(f"{c}.id").alias("id")))
    near = near.select(F.col("_p").alias(point_id), F.array_min(F.array_compact(F.array(side("_b"), side("_a")))).alias("near"))
    out = points.select(point_id).join(inside, point_id, "left").join(near, point_id, "left")
    best = F.coalesce("inside", "near")
    return out.select(point_id, best["id"].alias(right_id), F.when(best.isNotNull(), F.col("inside").isNotNull()).alias("inside"), best["d"].alias("distance"))
