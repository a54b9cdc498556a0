"""Classifiers judged on rows they haven't seen: logistic regression and forests over group folds, and linear detectors that are
chosen among subsets of features and accepted on held-out splits.

What is fitted are sums by task over all rows, for all folds or subsets in the same passes; models are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import next_after
from ..session import cut
from .aggregates import exact_quantiles, prefix_sums, separation

#: More folds than this are not folds.
MOST_FOLDS = 100


def _trained(rows: DataFrame, folds: list) -> DataFrame:
    """Each row once for every fold that it is trained on: all but its own."""
    return rows.select("*", F.explode(F.lit(folds)).alias("_fold")).where(F.col("fold").isNull() | (F.col("fold") != F.col("_fold")))


def _scaled(rows: DataFrame, features: list[str], folds: list) -> dict:
    """{fold: (medians, means, spreads)} of what it is trained on, absent values taken as the median."""
    long = _trained(rows, folds).select("_fold", F.posexplode(F.array(*features)).alias("_f", "_x"))
    median = exact_quantiles(long, ["_fold", "_f"], "_x", [0.5]).select("_fold", "_f", F.col("q")[0].alias("_m"))
    d = F.col("_x") - F.col("_m")
    sums = long.join(F.broadcast(median), ["_fold", "_f"]).groupBy("_fold", "_f", "_m")  # folds times features
    found = sums.agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss")).collect()
    out = {k: (np.zeros(len(features)), np.zeros(len(features)), np.ones(len(features))) for k in folds}
    for r in found:
        mean = (r["s"] or 0.0) / r["n"]
        spread = max((r["ss"] or 0.0) / r["n"] - mean * mean, 0.0) ** 0.5
        for part, x in zip(out[r["_fold"]], (r["_m"], r["_m"] + mean, spread if spread > 1e-12 else 1.0), strict=True):
            part[r["_f"]] = x
    return out


def _matrix(pdf: pd.DataFrame, scaling: tuple) -> np.ndarray:
    median, mean, spread = scaling
    x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(mean)))
    return np.column_stack([np.ones(len(x)), (np.where(np.isnan(x), median, x) - mean) / spread])


def logistic_folds(df: DataFrame, label: str, features: list[str], fold: Column, strength: float = 1.0, steps: int = 12) -> dict:
    """{fold: (weights with the constant first, scaling)}: for each fold a logistic regression of a 0/1 label on the rows of all others.

    Newton's method on the balanced, ridged likelihood (classes weigh alike; the constant isn't penalised). One pass a
    step for all folds: every task sums gradients and Hessians of its rows. Rows whose fold is null train every model
    and are judged by none. A fold whose training rows are of one class has no model.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), fold.alias("fold"), *[F.col(c).cast("double").alias(c) for c in features])
    folds = sorted(r[0] for r in rows.where("fold IS NOT NULL").select("fold").distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"over {MOST_FOLDS} folds")
    if not folds:
        return {}
    counts = {(r["_fold"], r["y"]): r["count"] for r in _trained(rows, folds).groupBy("_fold", "y").count().collect()}
    folds = [k for k in folds if counts.get((k, 0)) and counts.get((k, 1))]
    if not folds:
        return {}
    scaling = _scaled(rows, features, folds)
    size = {k: counts[k, 0] + counts[k, 1] for k in folds}
    d = len(features) + 1
    weights = {k: np.zeros(d) for k in folds}
    spark = df.sparkSession
    table = rows.select("y", "fold", F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in features]).alias("x"))
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((weights, scaling))  # folds times features

        def task(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            weights, scaling = shared.value
            total = {k: np.zeros(d + d * d) for k in weights}
            for pdf in batches:
                for k, w in weights.items():
                    own = pdf[pdf["fold"].isna() | (pdf["fold"] != k)]
                    x, y = _matrix(own, scaling[k]), own["y"].to_numpy(float)
                    p = 1 / (1 + np.exp(-x @ w))
                    c = np.where(y > 0, size[k] / (2 * counts[k, 1]), size[k] / (2 * counts[k, 0]))
                    total[k] += np.concatenate([x.T @ (c * (y - p)), ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()])
            yield pd.DataFrame({"k": range(len(total)), "s": [s.tolist() for s in total.values()]})

        cells = table.mapInPandas(task, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros((len(folds), d + d * d))
        for r in cells:
            sums[r["k"], r["i"]] = r["v"]
        penalty = np.diag([0.0] + [1.0] * (d - 1)) / strength
        moved = 0.0
        for i, k in enumerate(folds):
            change = np.linalg.solve(sums[i, d:].reshape(d, d) + penalty + 1e-12 * np.eye(d), sums[i, :d] - penalty @ weights[k])
            weights[k], moved = weights[k] + change, max(moved, float(np.abs(change).max()))
        shared.unpersist()
        if moved < 1e-10:
            break
    return {k: (weights[k], scaling[k]) for k in folds}


def predicted(df: DataFrame, models: dict, features: list[str], fold: Column, name: str = "p") -> DataFrame:
    """Adds the probability of label 1 by the model of the row's own fold; null where there is none."""
    kind = df.select(fold.alias("f")).schema["f"].dataType.simpleString()

    def logit(k) -> Column:
        w, (median, mean, spread) = models[k]
        terms = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(a)) / float(s) * float(b) for c, m, a, s, b in zip(features, median, mean, spread, w[1:], strict=True)]
        return sum(terms, F.lit(float(w[0])))

    out = F.lit(None).cast("double")
    for k in models:
        out = F.when(fold == F.lit(k).cast(kind), 1 / (1 + F.exp(-logit(k)))).otherwise(out)
    return df.withColumn(name, out)


def fold_report(df: DataFrame, label: str, p: str, fold: str) -> DataFrame:
    """For each fold auc and balanced accuracy (at a probability of one half) of the rows it holds out; folds of one class are left out."""
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, high = F.col(label) == 1, F.col(p) >= 0.5
    bal = rows.groupBy(fold).agg(((F.try_divide(n(y & high), n(y)) + F.try_divide(n(~y & ~high), n(~y))) / 2).alias("balanced"))
    return separation(rows, fold, p, label, turn=False).select(fold, "n_pos", "n_neg", "auc").join(bal, fold).where("auc IS NOT NULL")


def forest_folds(df: DataFrame, label: str, features: list[str], fold: str, trees: int = 60, seed: int = 0) -> DataFrame:
    """df with p, the probability of label 1 by a forest trained on all folds but the row's own.

    Spark's own forests: classes weigh alike, leaves of three rows at least, absent values as the median of what is trained on.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.where(F.col(label).isNotNull())
    folds = sorted(r[0] for r in rows.where(F.col(fold).isNotNull()).select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"over {MOST_FOLDS} folds")
    scaling = _scaled(rows.select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(c) for c in features]), features, folds) if folds else {}
    out = None
    for k in folds:
        fill = {c: float(m) for c, m in zip(features, scaling[k][0], strict=True)}
        whole = rows.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(f"_{c}") for c in features])
        whole = VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_x").transform(whole)
        train = whole.where(F.col(fold).isNull() | (F.col(fold) != k))
        n = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("int")).count().collect()}
        if len(n) < 2:
            continue
        weight = F.when(F.col(label) == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0]))
        train = train.select(F.col(label).cast("double").alias("_y"), "_x", weight.alias("_w"))
        model = RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=10, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed).fit(train)
        held = model.transform(whole.where(F.col(fold) == k)).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")
        out = held if out is None else out.unionByName(held)
    return out if out is not None else df.limit(0).withColumn("p", F.lit(None).cast("double"))


def _subset_rows(df: DataFrame, pair: str, features: list[str], size: int) -> DataFrame:
    """Every row once for each subset of features that it has in full: pair, side, split, quality, subset, x."""
    subsets = [s for n in range(1, min(size, len(features)) + 1) for s in combinations(features, n)]
    whole = [F.when(~F.isnull(sum((F.col(c) for c in s[1:]), F.col(s[0]))), F.struct(F.lit("+".join(s)).alias("subset"), F.array(*[F.col(c).cast("double") for c in s]).alias("x"))) for s in subsets]
    return df.select(pair, "side", "split", "quality", F.explode(F.array_compact(F.array(*whole))).alias("s")).select(pair, "side", "split", "quality", "s.*")


def _weights(pdf: pd.DataFrame, regular: float) -> list[float] | None:
    """The direction of one pair and subset from the sums of both sides, with its values scaled by centre and scale."""
    c, s = np.array(pdf["centre"].iloc[0], float), np.array(pdf["scale"].iloc[0], float)
    by = {int(side): np.array(x, float) for side, x in zip(pdf["side"], pdf["sums"], strict=True)}
    if len(by) < 2:
        return None
    d = len(c)
    n, mean, inner = {}, {}, 0.0
    for k, x in by.items():  # sums of (x - centre) and of their products
        n[k], mean[k] = x[0], x[1 : 1 + d] / x[0] / s
        inner = inner + x[1 + d :].reshape(d, d) / np.outer(s, s) - x[0] * np.outer(mean[k], mean[k])
    delta = mean[1] - mean[0]
    if d == 1:
        w = np.where(delta >= 0, 1.0, -1.0)
    else:
        w = np.linalg.solve(inner / max(1, n[0] + n[1] - 1) + regular * np.eye(d), delta)
        w = w if mean[1] @ w >= mean[0] @ w else -w
    norm = float(np.linalg.norm(w))
    return (w / norm).tolist() if np.isfinite(norm) and norm > 1e-9 else None


def fitted_detectors(df: DataFrame, pair: str, features: list[str], fp_ceiling: float, min_recall: float, min_samples: int = 20, min_eval: int = 10, quality_ceiling: float = 1.0, size: int = 3, regular: float = 1e-2) -> DataFrame:
    """Every subset of up to `size` features as a linear detector of side 1 (the alternative) against side 0 (the target) of a pair.

    df: pair, side, split (train, dev, test: of disjoint speakers), quality, features. Fitted on train; the threshold is
    the lowest that lets at most fp_ceiling of the target's dev rows pass (just above the next score); a row passes that
    reaches it and whose quality is at most quality_ceiling. Accepted is what holds the ceiling and finds min_recall on
    dev and on test, on enough rows; the best of a pair has the greatest recall on test, then on dev, then the greatest
    distance of the sides' medians on train, then the fewest features.

    Returns pair, subset, weights, centre, scale, threshold, dev_fp, test_fp, dev_recall, test_recall, train_margin,
    accepted, best. Medians and thresholds come from ranges of values, covariances from sums by task.
    """
    rows = cut(_subset_rows(df.where("side IS NOT NULL AND quality IS NOT NULL"), pair, features, size), "subset-rows")
    keys = [pair, "subset"]
    n = lambda side, split: F.sum(F.when((F.col("side") == side) & (F.col("split") == split), 1).otherwise(0))
    enough = [n(k, "train") >= min_samples for k in (0, 1)] + [n(k, s) >= min_eval for k in (0, 1) for s in ("dev", "test")]
    usable = rows.groupBy(*keys).agg(*[c.alias(f"e{i}") for i, c in enumerate(enough)]).where(" AND ".join(f"e{i}" for i in range(6))).select(*keys)
    train = rows.where("split = 'train'").join(usable, keys, "left_semi")
    long = train.select(*keys, F.posexplode("x").alias("dim", "v"))
    q = exact_quantiles(long, [*keys, "dim"], "v", [0.25, 0.5, 0.75]).join(long.groupBy(*keys, "dim").agg(F.stddev_pop("v").alias("sd")), [*keys, "dim"])
    wide = F.col("q")[2] - F.col("q")[0]
    scale = F.when(F.abs(wide) > 1e-9, wide).when(F.abs("sd") > 1e-9, F.col("sd")).otherwise(1.0)
    parts = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("q")[1].alias("c"), scale.alias("s")))).alias("m"))  # at most `size` each
    scaling = parts.select(*keys, F.transform("m", lambda x: x["c"]).alias("centre"), F.transform("m", lambda x: x["s"]).alias("scale"))
    d = F.transform("x", lambda x, i: x - F.get("centre", i))
    products = F.flatten(F.transform("d", lambda a: F.transform("d", lambda b: a * b)))
    cells = train.join(scaling, keys).select(*keys, "side", d.alias("d")).select(*keys, "side", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("d"), products)).alias("i", "v"))
    sums = cells.groupBy(*keys, "side", "i").agg(F.sum("v").alias("v")).groupBy(*keys, "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({pair: pdf[pair].iloc[:1], "subset": pdf["subset"].iloc[:1], "weights": [_weights(pdf, regular)]})

    kind = f"{pair} {dict(df.dtypes)[pair]}, subset string, weights array<double>"
    models = cut(sums.join(scaling, keys).groupBy(*keys).applyInPandas(solve, kind).where("weights IS NOT NULL").join(scaling, keys), "detectors")  # two rows each
    z = F.transform("x", lambda x, i: (x - F.get("centre", i)) / F.get("scale", i) * F.get("weights", i))
    score = F.round(F.aggregate(z, F.lit(0.0), lambda s, x: s + x), 9)
    scored = cut(rows.join(models, keys).select(*keys, "side", "split", (F.col("quality") <= quality_ceiling).alias("fits"), score.alias("score")), "scores")
    threshold = fp_thresholds(scored.where("side = 0 AND split = 'dev'"), keys, fp_ceiling)
    judged = scored.where("split <> 'train'").join(threshold, keys)
    at = lambda side, split: F.avg(F.when((F.col("side") == side) & (F.col("split") == split), (F.col("fits") & (F.col("score") >= F.col("threshold"))).cast("int")))
    rates = judged.groupBy(*keys, "threshold").agg(at(0, "dev").alias("dev_fp"), at(0, "test").alias("test_fp"), at(1, "dev").alias("dev_recall"), at(1, "test").alias("test_recall"))
    middle = exact_quantiles(scored.where("split = 'train'"), [*keys, "side"], "score", [0.5]).select(*keys, "side", F.col("q")[0].alias("m"))
    margin = middle.groupBy(*keys).agg((F.max(F.when(F.col("side") == 1, F.col("m"))) - F.max(F.when(F.col("side") == 0, F.col("m")))).alias("train_margin"))
    out = models.join(rates, keys).join(margin, keys)
    accepted = (F.col("train_margin") > 0) & (F.col("dev_fp") <= fp_ceiling) & (F.col("test_fp") <= fp_ceiling) & (F.col("dev_recall") >= min_recall) & (F.col("test_recall") >= min_recall)
    out = out.withColumn("accepted", accepted)
    rank = F.struct("test_recall", "dev_recall", "train_margin", (-F.size("weights")).alias("few"), F.col("subset").alias("_s"))
    best = out.where("accepted").groupBy(pair).agg(F.max(rank).alias("_r")).select(pair, F.col("_r._s").alias("subset"), F.lit(True).alias("best"))
    return out.join(best, keys, "left").withColumn("best", F.coalesce("best", F.lit(False)))


def fp_thresholds(rows: DataFrame, keys: list[str], ceiling: float) -> DataFrame:
    """keys, threshold: of all rows of a key at most a share of ceiling reach it among those that fit.

    rows: keys, fits, score. The threshold lies just above the score that is one place beyond what is allowed (the
    highest, if nothing is; the lowest score itself, if all are). Keys without a row that fits have none.
    """
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = rows.where("fits").groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_c"))
    up = prefix_sums(per, keys, "score", ["_c"], descending=True).join(total, keys)
    allowed = F.floor(F.lit(ceiling) * F.col("_n"))
    place = F.col("_c_to") > allowed  # the first place beyond is the highest score that this many rows reach
    found = up.groupBy(*keys).agg(F.max(F.when(place, F.col("score"))).alias("_next"), F.min("score").alias("_lowest"))
    return found.select(*keys, F.when(F.col("_next").isNotNull(), next_after(F.col("_next"))).otherwise(F.col("_lowest")).alias("threshold"))
