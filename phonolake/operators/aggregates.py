"""Profiles, robust statistics, reports and calibrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_avg, exact_sum, rate_or_null, wilson
from ..session import cut


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False) -> DataFrame:
    """Adds <value>_to (the running sum up to and with a row, in the order of a column) and <value>_all, within keys.

    Rows are dealt out by ranges of keys and order; each range sums its own rows, and what lies before it comes from the
    sums by range. So a key with many rows, or the whole table without a key, is never one task. The order must not tie
    within a key.
    """
    rows = df.withColumn("_k", F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_0")))
    by = F.desc(order) if descending else F.asc(order)
    rows = cut(rows.repartitionByRange(*[F.asc(k) for k in keys], by).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = rows.groupBy("_k", "_p").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_k")
    parts = parts.select("_k", "_p", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values], *[F.sum(f"_s_{v}").over(whole).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy("_k", "_p").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values]).join(parts, ["_k", "_p"])
    return rows.select(*df.columns, *[(F.col(f"_b_{v}") + F.col(f"_i_{v}")).alias(f"{v}_to") for v in values], *[f"{v}_all" for v in values])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Keys, n, q: the quantiles of a column (linear between its values) for each key, nulls left out.

    Values are counted first, then ranked by prefix sums over ranges of them; no task holds the values of a key.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(per, keys, "_v", ["_c"])
    covers = lambda at: F.max(F.when((F.col("_c_to") - F.col("_c") <= at) & (at < F.col("_c_to")), F.col("_v")))
    aggs, quantiles = [F.max("_c_all").alias("n")], []
    for i, p in enumerate(at):
        place = F.lit(p) * (F.col("_c_all") - 1)
        aggs += [covers(F.floor(place)).alias(f"_lo{i}"), covers(F.ceil(place)).alias(f"_hi{i}")]
        here = F.lit(p) * (F.col("n") - 1)
        quantiles.append(F.col(f"_lo{i}") + (here - F.floor(here)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, "n", F.array(*quantiles).alias("q"))


def profile(df: DataFrame, keys: list[str], value: str, speaker: str, flag: Column) -> DataFrame:
    """Per group: rows, distinct speakers, rows with the flag, mean, and the flag's share."""
    hit = F.sum(F.when(flag, 1).otherwise(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(speaker).alias("n_speakers"), hit.alias("n_flag"), exact_avg(F.col(value)).alias("mean_value"), rate_or_null(hit, F.count(F.lit(1))).alias("flag_rate"))


def counts_by_level(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts for each outer value and for each pair, in one aggregation; `level` tells which."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")).where("gid < 3").select(outer, inner, "n", F.when(F.col("gid") == 0, "pair").otherwise("outer").alias("level"))


def robust_scale(df: DataFrame, key: str, value: str, min_samples: int) -> DataFrame:
    """Median and IQR / 1.349 of each group with enough rows; a scale of 0 where the IQR is."""
    out = exact_quantiles(df, [key], value, [0.25, 0.5, 0.75]).where(F.col("n") >= min_samples)
    return out.select(key, "n", F.round(F.col("q")[1], 6).alias("median_value"), F.round((F.col("q")[2] - F.col("q")[0]) / 1.349, 6).alias("scale"))


def quantiles(df: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """One row for each group and quantile."""
    q = exact_quantiles(df, [key], value, at)
    return q.select(key, F.posexplode("q").alias("i", "v")).select(key, F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("p"), F.round("v", 6).alias("v"))


def availability(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Rows and non-null rows of each feature, for each group, in long form."""
    long = df.unpivot([key], features, "feature", "x")
    return long.groupBy(key, "feature").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_present"), rate_or_null(F.count("x"), F.count(F.lit(1))).alias("coverage"))


def sample_percentiles(df: DataFrame, key: str, features: list[str], order: str, k: int, at: list[float]) -> DataFrame:
    """key, feature, n, null_rate, n_sample, q: how much of each feature is there, and quantiles of its first k values in an order.

    The k first are taken in each partition before they meet, so a hot key is no more than k rows a partition.
    """
    long = df.select(key, order, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([key, order], features, "feature", "x")
    rate = long.groupBy(key, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.isnull("x").cast("int")).alias("null_rate"))
    first = long.where("x IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy(key, "feature").orderBy(order))).where(F.col("_r") <= k)
    q = exact_quantiles(first, [key, "feature"], "x", at).withColumnRenamed("n", "n_sample")
    return rate.join(q, [key, "feature"], "left").withColumn("n_sample", F.coalesce("n_sample", F.lit(0).cast("long")))


def zero_filled_counts(df: DataFrame, inventory: DataFrame, key: str, by: str, example: str, n_examples: int = 3) -> DataFrame:
    """A row for every entry of the inventory: count, a JSON histogram over `by`, and the first example ids."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(example)))
    examples = ranked.where(F.col("_rank") <= n_examples).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(example)).cast("array<string>"), ",").alias("examples"))
    per = df.groupBy(key, by).agg(F.count(F.lit(1)).alias("c"))
    hist = per.groupBy(key).agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(by), F.col("c").cast("string")))), ";").alias("distribution"))
    return inventory.join(hist, key, "left").join(examples, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("distribution", F.lit("")).alias("distribution"), F.coalesce("examples", F.lit("")).alias("examples"))


def flagged_report(df: DataFrame, by: str, flagged: Column) -> DataFrame:
    """Flagged rows and their share, for each value and overall (`ALL`); an empty table gives no rows."""
    hit = F.sum(F.when(flagged, 1).otherwise(0))
    out = df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(hit, F.lit(0)).alias("n_flagged"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.coalesce(F.col(by), F.lit("unknown"))).alias(by), "n", "n_flagged", rate_or_null(F.col("n_flagged"), F.col("n")).alias("rate"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """How often each reason occurs over arrays of reasons."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def proportion(df: DataFrame, by: str, success: Column) -> DataFrame:
    """Successes, trials and the Wilson interval, for each group."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(success, 1).otherwise(0)).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(by, "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def separation(df: DataFrame, by: str, score: str, label: str, turn: bool = True) -> DataFrame:
    """ROC-AUC (ties count half; turned around below 0.5, if asked for) and Cohen's d of a score between labels 1 and 0, for each group.

    Rows are counted by score first, and ranked by prefix sums over ranges of the distinct scores.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    up = prefix_sums(per, [by], score, ["neg"])
    won = up.withColumn("won", F.col("pos") * (F.col("neg_to") - F.col("neg") + F.col("neg") / 2)).groupBy(by).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.try_divide(F.col("won"), F.col("n_pos") * F.col("n_neg"))
    x, y = F.col(score).cast("double"), F.col(label)
    at = lambda v: F.when(y == v, x)
    moments = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(by).agg(*[f(at(v)).alias(f"{name}{v}") for v in (0, 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), F.try_divide(F.col("m1") - F.col("m0"), pooled))
    return won.join(moments, by).select(by, "n_pos", "n_neg", F.round(F.greatest(auc, 1 - auc) if turn else auc, 9).alias("auc"), F.round(d, 6).alias("cohens_d"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The cut with the greatest balanced accuracy (rows at or above it count as positive; the lowest such cut wins).

    Every distinct score is a candidate: rows are counted by score and summed from the top by prefix sums over ranges.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = rows.groupBy(F.col(score).alias("cut")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    up = prefix_sums(per, [], "cut", ["pos", "neg"], descending=True)
    tpr = F.try_divide(F.col("pos_to"), F.col("pos_all"))
    tnr = 1 - F.try_divide(F.col("neg_to"), F.col("neg_all"))
    scored = up.select("cut", F.round((tpr + tnr) / 2, 9).alias("balanced_accuracy"))
    return scored.orderBy(F.desc("balanced_accuracy"), "cut").limit(1)


def calibrate_pairs(df: DataFrame, target: str, other: str, margin: str, observed: str, min_samples: int, min_margin: float, max_fp: float) -> DataFrame:
    """Per (target, other): rows, median margin, share of negative margins, share observed as the other, and the verdict."""
    m = F.col(margin)
    seen = F.when(F.col(observed).isNotNull(), (F.col(observed) == F.col(other)).cast("int"))
    out = df.groupBy(target, other).agg(F.count(F.lit(1)).alias("n"), F.avg((m < 0).cast("int")).alias("fp_rate"), F.avg(seen).alias("cross_confusion")).where(F.col("n") >= min_samples)
    median = exact_quantiles(df, [target, other], margin, [0.5]).select(target, other, F.round(F.col("q")[0], 6).alias("median_margin"))
    out = out.join(median, [target, other], "left")
    return out.withColumn("override", (F.col("median_margin") >= min_margin) & (F.col("fp_rate") <= max_fp))


def calibrate_fixed(df: DataFrame, fixed: DataFrame, target: str, other: str, margin: str, observed: str, min_samples: int, min_margin: float, max_fp: float) -> DataFrame:
    """Calibration within a fixed list of contrasts (a small table): each is in the result and counts as reliable; one with
    fewer rows than min_samples has no margin, no false positives and no override."""
    keys = [target, other]
    rows = df.join(F.broadcast(fixed), keys, "left_semi")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = calibrate_pairs(rows, target, other, margin, observed, min_samples, min_margin, max_fp).drop("n")
    out = fixed.join(n, keys, "left").join(found, keys, "left")
    no = F.lit(False)
    return out.select(*keys, F.coalesce("_n", F.lit(0).cast("long")).alias("n"), "median_margin", F.coalesce("fp_rate", F.lit(0.0)).alias("fp_rate"), "cross_confusion", F.coalesce("override", no).alias("override"), F.coalesce(F.col("median_margin") >= min_margin, no).alias("separable"), F.lit(True).alias("reliable"))


def weighted_mean(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(by).agg(rate_or_null(exact_sum(F.col(value) * F.col(weight)), exact_sum(F.col(weight))).alias("weighted_mean"))


def share_of_total(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each group's sum and its share of the grand total; the window is over the groups."""
    per = df.groupBy(by).agg(exact_sum(F.col(value)).alias("total"))
    return per.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 9))


def vector_means(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean and median of each element over a group's vectors, in long form."""
    long = df.select(by, F.posexplode(vector).alias("dim", "x"))
    return exact_quantiles(long, [by, "dim"], "x", [0.5]).select(by, "dim", "n", F.round(F.col("q")[0], 6).alias("median_x"))
