"""Mixture models of groups of vectors, their calibration and use; linear projections between two groups; choice of features.

A group is a phone or a label, of which there are as many as the inventory has: models are small tables, fitted by sums
over tasks. What grows with the data are passes over it, never what a task or the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .aggregates import exact_quantiles, prefix_sums
from .scoring import robust_models, summed, verdict

#: More groups than this are not an inventory.
MOST_GROUPS = 2_000
REGULAR = 1e-3
ROUNDS = 25


@dataclass
class Component:
    weight: float
    mean: np.ndarray
    precision: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return math.log(max(self.weight, 1e-12)) - 0.5 * (self.squared_distance(x) + self.log_det + x.shape[1] * math.log(2 * math.pi))

    def squared_distance(self, x: np.ndarray) -> np.ndarray:
        d = x - self.mean
        return ((d @ self.precision) * d).sum(1)


def _component(weight: float, mean: np.ndarray, cov: np.ndarray) -> Component:
    sign, log_det = np.linalg.slogdet(cov)
    return Component(weight, mean, np.linalg.pinv(cov), float(log_det) if sign > 0 else 0.0)


def log_density(model: list[Component], x: np.ndarray) -> np.ndarray:
    parts = np.stack([c.log_density(x) for c in model])
    top = parts.max(0)
    return top + np.log(np.exp(parts - top).sum(0))


def _sums(rows: DataFrame, models: dict[int, dict[int, list[Component]]]) -> dict[tuple[int, int, int], np.ndarray]:
    """One step of expectation for models of several sizes at once, {size: {group: components}}: per size, group and component
    the weight, the weighted sums of vectors and of their products, and the group's log likelihood. rows: i, v."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # as many models as the inventory has groups

    def measure(g: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for n, some in shared.value.items():
            if g not in some:
                continue
            parts = np.stack([c.log_density(x) for c in some[g]])
            top = parts.max(0)
            p = np.exp(parts - top)
            like = float((top + np.log(p.sum(0))).sum())
            p /= p.sum(0)
            for k in range(n):
                head = [len(x) if k == 0 else 0, like if k == 0 else 0.0, p[k].sum()]
                yield n << 16 | k, np.concatenate([head, p[k] @ x, ((x * p[k][:, None]).T @ x).ravel()])

    out = {(at >> 16, g, at & 0xFFFF): s for (g, at), s in summed(rows, measure).items()}
    shared.unpersist()
    return out


def fit_mixtures(df: DataFrame, by: str, vector: str, most: int = 3, least_rows: int = 30, min_samples: int = 20, robust: DataFrame | None = None) -> dict:
    """{group: components}: of 1 to `most` components (one for every least_rows rows at most) the number of least BIC.

    The single component is the robust model. More start apart along the direction in which the group spreads most and
    are fitted by expectation maximisation, all groups in the same passes, up to ROUNDS of them. Groups under
    min_samples have no model. robust: the robust models, where they are known.
    """
    rows = df.where(F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>").alias("v"))
    robust = robust_models(rows, by, "v", min_samples=min_samples) if robust is None else robust
    base = {r[by]: r for r in robust.limit(MOST_GROUPS + 1).collect()}
    if len(base) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups are no inventory")
    if not base:
        return {}
    names = list(base)
    numbers = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], StructType([StructField(by, rows.schema[by].dataType), StructField("i", IntegerType())]))
    rows = rows.join(F.broadcast(numbers), by).select("i", "v")
    one = {}
    for i, g in enumerate(names):
        r = base[g]
        c = np.linalg.pinv(np.array(r["precision"]).reshape(len(r["centre"]), -1))
        one[i] = [_component(1.0, np.array(r["centre"]), (c + c.T) / 2)]
    sizes = {n: {i: start_apart(m[0], n) for i, m in one.items() if base[names[i]]["n"] // least_rows >= n} for n in range(2, most + 1)}
    open_ = {n: some for n, some in sizes.items() if some}  # models of all sizes are fitted in the same passes
    fitted, likes = dict(open_), {}
    for round_ in range(max(1, ROUNDS if open_ else 1)):
        sums = _sums(rows, open_ | ({1: one} if round_ == 0 else {}))
        if round_ == 0:
            likes[1] = {i: sums[1, i, 0][1] for i in one}
            count = {i: sums[1, i, 0][0] for i in one}
        for n, some in list(open_.items()):
            like, last = {i: sums[n, i, 0][1] for i in some}, likes.get(n)
            if last and all(abs(like[i] - last[i]) <= 1e-6 * max(1.0, abs(last[i])) for i in like):
                del open_[n]
                continue
            likes[n] = like
            fitted[n] = open_[n] = {i: maximise([sums[n, i, k] for k in range(n)]) for i in some}
        if not open_:
            break
    best, least = dict(one), {}
    for i, m in one.items():
        d = len(m[0].mean)
        least[i] = -2 * likes[1][i] + (d + d * (d + 1) / 2) * math.log(max(count[i], 1))
    for n, some in fitted.items():
        for i, m in some.items():
            d = len(m[0].mean)
            bic = -2 * likes[n][i] + (n * (d + d * (d + 1) / 2) + n - 1) * math.log(max(base[names[i]]["n"], 1))
            if bic < least[i]:
                best[i], least[i] = m, bic
    return {names[i]: m for i, m in best.items()}


def start_apart(c: Component, n: int) -> list[Component]:
    """n components along the direction of greatest spread."""
    cov = np.linalg.pinv(c.precision)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    step = math.sqrt(max(values[-1], 0.0)) * vectors[:, -1] * (1 if vectors[np.argmax(np.abs(vectors[:, -1])), -1] > 0 else -1)
    return [_component(1 / n, c.mean + step * (2 * k / (n - 1) - 1), cov) for k in range(n)]


def maximise(sums: list[np.ndarray]) -> list[Component]:
    """Components from their sums: weights, means, covariances with a small ridge."""
    total, out = sum(s[2] for s in sums), []
    d = int((-1 + math.sqrt(1 + 4 * (len(sums[0]) - 3))) / 2)
    for s in sums:
        w = max(s[2], 1e-9)
        mean = s[3 : 3 + d] / w
        out.append(_component(w / total, mean, s[3 + d :].reshape(d, d) / w - np.outer(mean, mean) + REGULAR * np.eye(d)))
    return out


def signature(models: dict) -> str:
    """A digest of models: their groups, numbers of components and means."""
    h = hashlib.sha1()
    for g in sorted(models):
        h.update(f"|{g}|{len(models[g])}".encode())
        for c in models[g]:
            h.update("".join(f"{x:.6f}" for x in c.mean).encode())
    return h.hexdigest()


def score(df: DataFrame, models: dict, by: str, vector: str, thresholds: dict, same_class: dict | None = None) -> DataFrame:
    """Adds log_density, typicality, best_match, best_typicality, components to rows whose group has a model; others get nulls.

    Typicality is exp(-(d / threshold)^2 / 2) of the nearest component; the best match is the most typical other group of
    the same class (of all groups, if no classes are given).
    """
    shared = df.sparkSession.sparkContext.broadcast((models, thresholds, same_class))  # as many models as the inventory has groups
    kind = dict(df.dtypes)[by]

    @F.pandas_udf(f"log_density double, typicality double, best_match {kind}, best_typicality double, components int")
    def measure(groups: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        models, limits, classes = shared.value
        names = sorted(models)
        out = pd.DataFrame({"log_density": [None] * len(groups), "typicality": None, "best_match": None, "best_typicality": None, "components": None}, dtype=object)
        known = np.flatnonzero([v is not None and g in models for g, v in zip(groups, vectors, strict=True)])
        if not len(known):
            return out
        x = np.stack([np.asarray(vectors.iloc[i], float) for i in known])
        near = np.stack([np.min([c.squared_distance(x) for c in models[g]], axis=0) for g in names])
        limit = np.array([limits[g] for g in names])[:, None]
        fit = np.where(limit > 0, np.exp(-0.5 * np.maximum(near, 0) / np.where(limit > 0, limit, 1) ** 2), 1.0)
        own = np.array([names.index(g) for g in groups.iloc[known]])
        kinds = [None if classes is None else classes.get(n) for n in names]
        rival = np.array([[a != b and kinds[a] == kinds[b] for b in range(len(names))] for a in range(len(names))])[own]  # rows by groups
        others = np.where(rival, fit.T, -np.inf)
        top = others.argmax(1)  # the first of equal ones
        density = np.empty(len(known))
        for k in np.unique(own):
            density[own == k] = log_density(models[names[k]], x[own == k])
        some, at = rival.any(1), np.arange(len(known))
        found = {"log_density": density, "typicality": fit[own, at], "best_match": np.where(some, np.array(names, object)[top], None), "best_typicality": np.where(some, others[at, top], None), "components": np.array([len(models[names[k]]) for k in own], object)}
        for c, v in found.items():
            out[c] = out[c].mask(np.isin(np.arange(len(out)), known), pd.Series(pd.Series(v, dtype=object).to_numpy(), index=known).reindex(range(len(out))))
        return out

    rows = df.withColumn("_s", measure(F.col(by), F.col(vector).cast("array<double>")))
    return rows.select(*df.columns, "_s.*")


def assess(scored: DataFrame, floor: float = math.exp(-0.5), delta: float = 0.15) -> DataFrame:
    """Adds margin and verdict; low_confidence where there is no model."""
    margin = F.col("typicality") - F.col("best_typicality")
    call = verdict(F.col("typicality"), margin, floor, delta)
    return scored.withColumn("margin", margin).withColumn("verdict", F.when(F.col("typicality").isNull(), "low_confidence").otherwise(call))


def quantile_grid(df: DataFrame, by: str, value: str, count: int = 1024) -> DataFrame:
    """by, n, j, q: an evenly spaced grid of quantiles of each group, its own values where there are no more than `count`.

    Ranked values name the places of the grid that they cover, by whole numbers; nothing is gathered.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(per, [by], "_v", ["_c"])
    n, last = F.col("_c_all"), F.greatest(F.least(F.lit(count), F.col("_c_all")) - 1, F.lit(1))
    first = F.greatest(F.floor((F.col("_c_to") - F.col("_c") - 1) * last / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0))
    until = F.least(F.ceil(F.col("_c_to") * last / F.greatest(n - 1, F.lit(1))) + 1, F.when(n > 1, last).otherwise(0))
    rows = ranked.select(by, "_v", n.alias("n"), last.alias("_m"), (F.col("_c_to") - F.col("_c")).alias("_a"), F.col("_c_to").alias("_b"), F.explode(F.when(until >= first, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))).alias("j"))
    low = F.expr("(j * (n - 1)) div _m")
    high = F.expr("(j * (n - 1) + _m - 1) div _m")
    inside = lambda p: (F.col("_a") <= p) & (p < F.col("_b"))
    ends = rows.groupBy(by, "j").agg(F.max("n").alias("n"), F.max("_m").alias("_m"), F.max(F.when(inside(low), F.col("_v"))).alias("lo"), F.max(F.when(inside(high), F.col("_v"))).alias("hi"))
    part = (F.col("j") * (F.col("n") - 1) % F.col("_m")) / F.col("_m")
    return ends.select(by, "n", "j", (F.col("lo") + part * (F.col("hi") - F.col("lo"))).alias("q"))


def ranks_in_grid(df: DataFrame, grid: DataFrame, by: str, value: str) -> DataFrame:
    """Adds rank: the share of the group's grid that is not above the value. A grid is an array of at most some thousand values."""
    whole = grid.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda x: x["q"]).alias("_grid"))
    out = df.join(whole, by, "left")
    return out.withColumn("rank", F.size(F.filter("_grid", lambda q: q <= F.col(value))) / F.size("_grid")).drop("_grid")


def projections(df: DataFrame, pair: str, side: Column, vector: str, regular: float = 1e-2) -> DataFrame:
    """pair, weights, centre, scale: the direction that tells the sides (0, 1) of each pair apart, of length one.

    Vectors are scaled by median and quartile range; the direction is the inverse of the pooled covariance (with a
    ridge) times the difference of the sides' means, towards side 1. Means and covariances are sums by task.
    """
    rows = df.select(pair, side.cast("int").alias("side"), F.col(vector).cast("array<double>").alias("v")).where("side IS NOT NULL AND v IS NOT NULL")
    long = rows.select(pair, F.posexplode("v").alias("dim", "x"))
    q = exact_quantiles(long, [pair, "dim"], "x", [0.25, 0.5, 0.75]).join(long.groupBy(pair, "dim").agg(F.stddev_pop("x").alias("sd")), [pair, "dim"])
    wide, sd = F.col("q")[2] - F.col("q")[0], F.col("sd")
    scale = F.when(F.abs(wide) > 1e-9, wide).when(F.abs(sd) > 1e-9, sd).otherwise(1.0)
    model = q.groupBy(pair).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("q")[1].alias("c"), scale.alias("s")))).alias("m"))
    model = model.select(pair, F.transform("m", lambda x: x["c"]).alias("centre"), F.transform("m", lambda x: x["s"]).alias("scale"))
    z = rows.join(F.broadcast(model), pair).select(pair, "side", F.zip_with(F.zip_with("v", "centre", lambda x, c: x - c), "scale", lambda d, s: d / s).alias("z"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for g, p in pdf.groupby([pair, "side"]):
                x = np.stack(p["z"].to_numpy())
                total[g] = total.get(g, 0.0) + np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        if total:
            yield pd.DataFrame({pair: [g for g, _ in total], "side": [s for _, s in total], "s": list(total.values())})

    kind = f"{pair} {dict(df.dtypes)[pair]}"
    cells = z.mapInPandas(part, f"{kind}, side int, s array<double>").select(pair, "side", F.posexplode("s").alias("i", "x")).groupBy(pair, "side", "i").agg(F.sum("x").alias("x"))
    sums = cells.groupBy(pair, "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {int(r.side): np.asarray(r.s, float) for r in pdf.itertuples()}
        out = pd.DataFrame({pair: pdf[pair].iloc[:1], "weights": [None]})
        if len(by) < 2:
            return out.iloc[:0]
        d = int((-1 + math.sqrt(1 + 4 * (len(by[0]) - 1))) / 2)
        n, mean = {k: s[0] for k, s in by.items()}, {k: s[1 : 1 + d] / s[0] for k, s in by.items()}
        pooled = sum(s[1 + d :].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k, s in by.items()) / max(1, n[0] + n[1] - 1)
        delta = mean[1] - mean[0]
        w = np.sign(delta) + (delta == 0) if d == 1 else np.linalg.solve(pooled + regular * np.eye(d), delta)
        w = w if mean[1] @ w >= mean[0] @ w else -w
        norm = np.linalg.norm(w)
        if not np.isfinite(norm) or norm <= 1e-9:
            return out.iloc[:0]
        out.at[out.index[0], "weights"] = np.round(w / norm, 10).tolist()
        return out

    return sums.groupBy(pair).applyInPandas(solve, f"{kind}, weights array<double>").join(model, pair)  # two rows each


def usable_features(df: DataFrame, by: str, features: list[str], least: float = 0.6) -> DataFrame:
    """by, features: those that enough of a group's rows have; the one with the most, where none reaches that."""
    share = lambda c: F.count(c) / F.count(F.lit(1))
    per = df.groupBy(by).agg(*[share(c).alias(c) for c in features])
    rows = F.array(*[F.struct(F.col(c).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("f")) for i, c in enumerate(features)])
    good = F.transform(F.filter(rows, lambda x: x["s"] >= least), lambda x: x["f"])
    return per.select(by, F.when(F.size(good) > 0, good).otherwise(F.array(F.array_max(rows)["f"])).alias("features"))


def first_analysis(*candidates: tuple[str, Column]) -> Column:
    """source, phone of the first candidate that names a phone."""
    out = F.lit(None).cast("struct<source: string, phone: string>")
    for source, phone in reversed(candidates):
        out = F.when(phone.isNotNull(), F.struct(F.lit(source).alias("source"), phone.alias("phone"))).otherwise(out)
    return out


def authority(n: Column, false_positive: Column, recall: Column, min_samples: int, most_fp: float, least_recall: float) -> Column:
    """What a detector may do: hard_override if it is sure and finds enough, quality_only if it is sure, else no_override."""
    sure = (n >= min_samples) & (false_positive <= most_fp)
    return F.when(sure & (recall >= least_recall), "hard_override").when(sure, "quality_only").otherwise("no_override")


def detectors(df: DataFrame, label: str, features: list[str], most_fp: float, size: int = 3) -> DataFrame:
    """subset, threshold, fp, recall: for every subset of up to `size` features the sum of their values as a score, the
    lowest threshold whose false positives stay within most_fp, and what it finds. Label 1 is to be found.

    Scores are counted by value and summed from the top in prefix sums, all subsets at once.
    """
    from itertools import combinations

    subsets = [s for k in range(1, size + 1) for s in combinations(features, k)]
    scores = F.array(*[F.struct(F.lit("+".join(s)).alias("subset"), F.round(sum((F.col(c) for c in s[1:]), F.col(s[0])), 6).alias("score")) for s in subsets])
    rows = df.where(F.col(label).isNotNull()).select(label, F.explode(scores).alias("x")).select(label, "x.*").where("score IS NOT NULL")
    per = rows.groupBy("subset", "score").agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    up = prefix_sums(per, ["subset"], "score", ["pos", "neg"], descending=True)
    rates = up.select("subset", "score", F.coalesce(F.try_divide(F.col("neg_to"), F.col("neg_all")), F.lit(0.0)).alias("fp"), F.coalesce(F.try_divide(F.col("pos_to"), F.col("pos_all")), F.lit(0.0)).alias("recall"))
    return rates.where(F.col("fp") <= most_fp).groupBy("subset").agg(F.min("score").alias("threshold"), F.max("fp").alias("fp"), F.max("recall").alias("recall"))
