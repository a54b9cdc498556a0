"""Operators on keyed rows: lookups that may be ambiguous, attempts, replacements, supplements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key, by aggregation."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in keep])


def next_number(df: DataFrame, keys: list[str], number: str, wanted: DataFrame) -> DataFrame:
    """The number after the greatest one of each wanted key; 1 where there is none."""
    top = df.groupBy(*keys).agg(F.max(number).alias("_top"))
    return wanted.join(top, keys, "left").select(*keys, (F.coalesce("_top", F.lit(0)) + 1).alias("next_number"))


def without_attempt(df: DataFrame, gone: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows but those to delete, and how many of each key remain."""
    left = df.join(gone.select(*keys, number).distinct(), [*keys, number], "left_anti")
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"), F.max(number).alias("last_number"))


def replace_rows(df: DataFrame, patch: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table with the patch's values under its keys. Raises ValueError if a key of the patch has no row or several."""
    counts = patch.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left").where("_n IS NULL OR _n <> 1")
    if not counts.isEmpty():
        raise ValueError("the patch names rows that are absent or not unique")
    new = patch.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    return df.join(new, keys, "left").withColumn(value, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(value))).drop("_v", "_hit")


def lookup(df: DataFrame, source: DataFrame, keys: list[str], exact: tuple[str, str], value: str) -> DataFrame:
    """Each row's source row: none → null, one → it, several → the one whose exact column agrees, else marked ambiguous.

    Source rows are counted by key and by key and exact value; so rows are never multiplied.
    """
    left, right = exact
    by_key = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_v"))
    by_both = source.groupBy(*keys, F.col(right).alias("_x")).agg(F.count(F.lit(1)).alias("_nx"), F.min(value).alias("_vx"))
    rows = df.join(by_key, keys, "left").withColumn("_x", F.col(left)).join(by_both, [*keys, "_x"], "left")
    outcome = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").when(F.col("_nx") == 1, "exact").otherwise("ambiguous")
    found = F.when(F.col("_n") == 1, F.col("_v")).when((F.col("_n") > 1) & (F.col("_nx") == 1), F.col("_vx"))
    return rows.withColumn("outcome", outcome).withColumn("found", found).drop("_n", "_v", "_x", "_nx", "_vx")


def bucket_set(spec: str) -> list[int]:
    """Buckets of a text like `0..89,95`, in order. Raises ValueError for a falling range or a bucket outside 0 to 99."""
    out: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        low, dots, high = part.partition("..")
        first, last = int(low), int(high if dots else low)
        if last < first or first < 0 or last > 99:
            raise ValueError(f"not a range of buckets: {part}")
        out.update(range(first, last + 1))
    return sorted(out)


def supplement(base: DataFrame, pool: DataFrame, key: str, rare: Column, order: Column, n: int) -> DataFrame:
    """The base sample and the first n rare rows of the pool, in the order of a key, that it lacks; role tells which."""
    more = pool.where(rare).join(base.select(key).distinct(), key, "left_anti").orderBy(order).limit(n)
    return base.withColumn("role", F.lit("base")).unionByName(more.withColumn("role", F.lit("supplement")))


def training_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each composite key, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
