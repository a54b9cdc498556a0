"""Verdicts, scores and robust models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import cut
from .aggregates import exact_quantiles, prefix_sums

#: Models of so many bytes in all go to every task, as an inventory's do.
SENT_BYTES = 64 << 20
#: About so many rows of a group tell the bounds of its medians, and so many standard errors of their rank the bounds are apart from it.
SAMPLE_ROWS, BOUNDS = 16_384, 5


def verdict(fit: Column, margin: Column, floor: float, delta: float) -> Column:
    """fit_ok from the floor on; else a likely substitution if another target fits better by delta; else atypical."""
    return F.when(fit >= floor, "fit_ok").when(margin <= -delta, "likely_substitution").otherwise("atypical")


def layer_rates(df: DataFrame, by: str, layers: dict[str, Column]) -> DataFrame:
    """Flagged rows of each layered policy, for each group, in one aggregation."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in layers.items()])
    return per.unpivot([by, "n"], list(layers), "layer", "n_flagged")


def utterance_scores(df: DataFrame, by: str, score: str, extra: Column) -> DataFrame:
    """The mean score of an utterance's targets times targets / (targets + extras), in percent; null without targets."""
    targets, extras = F.sum(F.when(extra, 0).otherwise(1)), F.sum(F.when(extra, 1).otherwise(0))
    total = F.sum(F.when(~extra, F.col(score).cast("decimal(20,6)"))).cast("double")
    return df.groupBy(by).agg(targets.alias("n_targets"), extras.alias("n_extra"), F.round(F.try_divide(total, targets) * F.try_divide(targets, targets + extras) * 100, 6).alias("score"))


def fold_metrics(df: DataFrame, fold: Column, correct: Column) -> DataFrame:
    """Accuracy of each fold, then mean and standard deviation over the folds."""
    per = df.groupBy(fold.alias("fold")).agg(F.avg(correct.cast("int")).alias("accuracy"))
    return per.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("accuracy"), 9).alias("mean_accuracy"), F.round(F.stddev_pop("accuracy"), 9).alias("std_accuracy"))


def _inverse(n: int, s: np.ndarray, ridge: float) -> np.ndarray:
    """The inverse of a scatter with a ridge, from its n rows' sum of outer products."""
    k = int(len(s) ** 0.5)
    c = s.reshape(k, k) / max(1, n - 1)
    return np.linalg.pinv(c + ridge * np.trace(c) / k * np.eye(k))


def scatter(rows: DataFrame, by: str, ridge: float) -> DataFrame:
    """by, n, precision: the inverse of each group's scatter about its centre, with a ridge. rows: by, v, centre.

    Every task sums the outer products of its own rows; what is shuffled is one matrix a task and group.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for g, p in pdf.groupby(by, dropna=False):
                d = np.stack(p["v"].to_numpy()) - np.stack(p["centre"].to_numpy())
                n, s = sums.get(g, (0, 0.0))
                sums[g] = n + len(d), s + d.T @ d
        if sums:
            yield pd.DataFrame({by: list(sums), "n": [n for n, _ in sums.values()], "s": [s.ravel() for _, s in sums.values()]})

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        return pd.DataFrame({by: pdf[by], "n": [n], "precision": [_inverse(n, np.array(pdf["s"].iloc[0], float), ridge).ravel().tolist()]})

    kind = f"{by} {dict(rows.dtypes)[by]}"
    parts = rows.select(by, "v", "centre").mapInPandas(part, f"{kind}, n long, s array<double>")
    cells = parts.select(by, "n", F.posexplode("s").alias("i", "x")).groupBy(by, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = cells.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("s"))  # dimensions squared
    return whole.groupBy(by).applyInPandas(invert, f"{kind}, n long, precision array<double>")  # one row each


def medians(rows: DataFrame, by: str) -> DataFrame:
    """by, centre: the median of every dimension of a group's vectors. rows: by, v."""
    long = rows.select(by, F.posexplode("v").alias("dim", "x"))
    q = exact_quantiles(long, [by, "dim"], "x", [0.5]).select(by, "dim", F.col("q")[0].alias("x"))
    return q.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("centre"))


def vectors_of(v: pa.Array, at: np.ndarray) -> np.ndarray:
    """The vectors at some places of an Arrow array of lists, as a matrix of doubles; all are of one length."""
    offsets = v.offsets.to_numpy()
    n = np.unique(np.diff(offsets)[at])
    if len(n) != 1:
        raise ValueError(f"vectors of one group have {n.tolist()} dimensions")
    return v.values.to_numpy(zero_copy_only=False)[offsets[:-1][at][:, None] + np.arange(n[0])].astype(float, copy=False)


def by_number(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(number, matrix) of the groups in a batch of i, v."""
    i = batch.column("i").to_numpy()
    for g in np.unique(i):
        yield int(g), vectors_of(batch.column("v"), np.flatnonzero(i == g))


def summed(rows: DataFrame, measure: Callable[[int, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """{(group, k): sum} of what `measure` gives for each group's vectors in a batch as (k, array). rows: i (the group's number), v.

    Each task adds up its own; one array a task and pair is shuffled and added as it arrives, one a pair is collected.
    """

    def out(total: dict) -> Iterator[pa.RecordBatch]:
        for (g, k), s in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([g], pa.int32()), "k": pa.array([k], pa.int32()), "s": pa.array([s], pa.list_(pa.float64()))})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for g, x in by_number(batch):
                for k, s in measure(g, x):
                    total[g, k] = total.get((g, k), 0.0) + s
        yield from out(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for r, (g, k) in enumerate(zip(batch.column("i").to_pylist(), batch.column("k").to_pylist(), strict=True)):
                total[g, k] = total.get((g, k), 0.0) + vectors_of(batch.column("s"), np.array([r]))[0]
        yield from out(total)

    kind = "i int, k int, s array<double>"
    return {(r["i"], r["k"]): np.array(r["s"]) for r in rows.select("i", "v").mapInArrow(task, kind).repartition("i", "k").mapInArrow(add, kind).collect()}


def _medians_of_numbered(rows: DataFrame, n: dict[int, int]) -> dict[int, np.ndarray]:
    """{number: centre}: exact medians of every dimension. rows: i, v; n: a group's rows.

    A sample tells the bounds that the median most likely lies within; then only the values within them are ranked, those
    below them are counted. Where the bounds don't hold it, all values of that group are ranked.
    """
    spark = rows.sparkSession
    sizes = spark.createDataFrame(list(n.items()), "i int, n long")

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.stack(pdf["v"].to_numpy()), axis=0)
        g, m = int(pdf["i"].iloc[0]), len(x)
        off = 0 if m == n[g] else BOUNDS * 0.5 * m**0.5 + 1
        lo, hi = max(0, math.floor(0.5 * (m - 1) - off)), min(m - 1, math.ceil(0.5 * (m - 1) + off))
        return pd.DataFrame({"i": [g], "lo": [x[lo]], "hi": [x[hi]]})

    share = F.lit(float(SAMPLE_ROWS)) / F.col("n")
    some = rows.join(F.broadcast(sizes), "i").where((share >= 1) | (F.rand(7) < share)).select("i", "v")
    within = {r["i"]: (np.array(r["lo"]), np.array(r["hi"])) for r in some.groupBy("i").applyInPandas(bounds, "i int, lo array<double>, hi array<double>").collect()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict = {}
        for batch in batches:
            for g, x in by_number(batch):
                if g in within:
                    lo, hi = within[g]
                    below[g] = below.get(g, 0) + (x < lo).sum(0)
                    row, dim = np.nonzero((x >= lo) & (x <= hi))
                    yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(row), g, np.int32)), "dim": pa.array(dim.astype(np.int32)), "x": pa.array(x[row, dim]), "c": pa.array(np.ones(len(row), np.int64))})
        for g, c in below.items():  # before all values of its dimension
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(c), g, np.int32)), "dim": pa.array(np.arange(len(c), dtype=np.int32)), "x": pa.nulls(len(c), pa.float64()), "c": pa.array(c.astype(np.int64))})

    per = rows.select("i", "v").mapInArrow(near, "i int, dim int, x double, c long").groupBy("i", "dim", "x").agg(F.sum("c").alias("c"))
    ranked = prefix_sums(per, ["i", "dim"], "x", ["c"]).join(F.broadcast(sizes), "i")
    place = F.lit(0.5) * (F.col("n") - 1)
    covers = lambda at: F.max(F.when((F.col("c_to") - F.col("c") <= at) & (at < F.col("c_to")), F.col("x")))
    q = ranked.groupBy("i", "dim").agg(F.max(place - F.floor(place)).alias("part"), covers(F.floor(place)).alias("lo"), covers(F.ceil(place)).alias("hi"))
    x = F.struct("dim", (F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))).alias("x"))
    found = {r["i"]: [c["x"] for c in r["m"]] for r in q.groupBy("i").agg(F.array_sort(F.collect_list(x)).alias("m")).collect()}
    missed = [g for g in n if g not in found or None in found[g]]
    if missed:
        found |= {r["i"]: r["centre"] for r in medians(rows.where(F.col("i").isin(missed)), "i").collect()}
    return {g: np.array(c, float) for g, c in found.items()}


def far(models: dict[int, tuple[np.ndarray, np.ndarray]], spark: SparkSession) -> Callable[[str, str], Column]:
    """A column function of a group's number and a vector: the squared distance by the number's (centre, precision); null where the vector is null or of another length."""
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("double")
    def measure(i: pa.Array, v: pa.Array) -> pa.Array:
        i, out, n = i.to_numpy(zero_copy_only=False), np.full(len(i), np.nan), v.value_lengths().fill_null(-1).to_numpy()
        known = np.zeros(len(i), bool)
        for g in np.unique(i):
            centre, precision = shared.value[int(g)]
            at = np.flatnonzero((i == g) & (n == len(centre)))
            if len(at):
                d = vectors_of(v, at) - centre
                out[at], known[at] = ((d @ precision) * d).sum(1), True
        if v.values.null_count:
            holes = pc.list_parent_indices(v).filter(pc.is_null(v.flatten())).to_numpy()
            known[holes] = False
        return pa.array(out, mask=~known)

    return measure


def squared_distance(vector: Column, centre: Column, precision: Column) -> Column:
    """The squared distance of a vector from a centre by an inverse scatter, held row by row in one array."""
    d = F.zip_with(vector, centre, lambda x, c: x - c)
    n = F.size(vector)
    row = lambda i: F.aggregate(F.zip_with(d, F.slice(precision, i * n + 1, n), lambda a, p: a * p), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(d, lambda a, i: a * row(i)), F.lit(0.0), lambda s, x: s + x)


def robust_models(df: DataFrame, by: str, vector: str, ridge: float = 1e-3, min_samples: int = 20, quantile: float = 0.95) -> DataFrame:
    """by, n, centre, precision, threshold: a robust model of each group's vectors; groups under min_samples are left out.

    The centre is the median, the scatter is taken about it; rows beyond the 0.999 quantile of squared distances are
    trimmed (unless hardly any would be left), and both are taken again. The threshold is a quantile of the distances
    of all rows. Medians come from ranges of values and scatters from sums by task, so no task holds a group. Models of
    up to SENT_BYTES go to the tasks, larger ones (of very many groups) are joined to the rows.
    """
    rows = df.where(F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>").alias("v"))
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("k")).where(F.col("n") >= min_samples)
    n = n.withColumn("limit", n["k"] * F.pow(1 - 2 / (9 * n["k"]) + 3.0902323061678132 * F.sqrt(2 / (9 * n["k"])), F.lit(3.0)))
    if 8 * (n.agg(F.sum(F.col("k") * (F.col("k") + 1))).first()[0] or 0) > SENT_BYTES:
        return _joined_models(rows, n, by, ridge, quantile)
    spark = df.sparkSession
    groups = list(enumerate(n.where(F.col(by).isNotNull()).collect()))  # at most SENT_BYTES, by their models
    key = StructField(by, rows.schema[by].dataType)
    numbers = spark.createDataFrame([(r[by], i) for i, r in groups], StructType([key, StructField("i", IntegerType())]))
    rows = cut(rows.join(F.broadcast(numbers), by).select("i", "v"), "numbered")

    def model(rows: DataFrame, n: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        centres = _medians_of_numbered(rows, n)

        def measure(g: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            d = x - centres[g]
            yield 0, (d.T @ d).ravel()

        return {g: (centres[g], _inverse(n[g], s, ridge)) for (g, _), s in summed(rows, measure).items()}

    size = {i: r["n"] for i, r in groups}
    first = far(model(rows, size), spark)("i", "v")
    limits = spark.createDataFrame([(i, r["limit"], r["k"] + 1) for i, r in groups], "i int, limit double, least long")
    rows_in = rows.join(F.broadcast(limits), "i").withColumn("m", first)
    left = {r["i"]: r["left"] for r in rows_in.groupBy("i").agg(F.sum((F.col("m") <= F.col("limit")).cast("int")).alias("left")).collect()}
    whole = [i for i, r in groups if left[i] < r["k"] + 1]
    kept = rows_in.where((F.col("m") <= F.col("limit")) | F.col("i").isin(whole)).select("i", "v")
    models = model(kept, {i: c if i not in whole else size[i] for i, c in left.items()})
    q = exact_quantiles(rows.select("i", far(models, spark)("i", "v").alias("m")), ["i"], "m", [quantile])
    threshold = {r["i"]: math.sqrt(max(r["q"][0], 0.0)) for r in q.collect()}
    out = [(r[by], r["n"], models[i][0].tolist(), models[i][1].ravel().tolist(), threshold[i]) for i, r in groups]
    doubles = ArrayType(DoubleType())
    return spark.createDataFrame(out, StructType([key, StructField("n", LongType()), StructField("centre", doubles), StructField("precision", doubles), StructField("threshold", DoubleType())]))


def _joined_models(rows: DataFrame, n: DataFrame, by: str, ridge: float, quantile: float) -> DataFrame:
    """The same for so many groups that their models are no small table. n: by, n, k, limit."""
    rows = rows.join(n.select(by, "k", "limit"), by)

    def with_model(rows: DataFrame) -> DataFrame:
        centred = rows.join(medians(rows, by), by)
        return cut(centred.join(scatter(centred, by, ridge).drop("n"), by).withColumn("m", squared_distance(F.col("v"), F.col("centre"), F.col("precision"))), "model-rows")

    first = with_model(rows)
    left = first.groupBy(by).agg(F.sum((F.col("m") <= F.col("limit")).cast("int")).alias("left"))
    kept = first.join(left, by).where((F.col("m") <= F.col("limit")) | (F.col("left") < F.col("k") + 1)).select(by, "v", "k", "limit")
    models = with_model(kept).groupBy(by).agg(F.first("centre").alias("centre"), F.first("precision").alias("precision"))
    far = rows.join(models, by).select(by, squared_distance(F.col("v"), F.col("centre"), F.col("precision")).alias("m"))
    threshold = exact_quantiles(far, [by], "m", [quantile]).select(by, F.sqrt(F.greatest(F.col("q")[0], F.lit(0.0))).alias("threshold"))
    return n.select(by, "n").join(models, by).join(threshold, by)


def typicality(df: DataFrame, models: DataFrame, by: str, vector: str) -> DataFrame:
    """Each row's distance from its group's centre and fit exp(-(d / threshold)^2 / 2). models: one row a group."""
    v = F.col(vector).cast("array<double>")
    models = cut(models, "typical-models")
    if 8 * (models.agg(F.sum(F.size("precision") + F.size("centre"))).first()[0] or 0) > SENT_BYTES:
        out = df.join(models, by).withColumn("m", squared_distance(v, F.col("centre"), F.col("precision")))
    else:
        (number,) = [c for c in ("i", "_i", "__i") if c not in df.columns][:1]
        held = list(enumerate(models.where(F.col(by).isNotNull()).collect()))
        sent = {i: (np.array(r["centre"]), np.array(r["precision"]).reshape(len(r["centre"]), -1)) for i, r in held}
        numbers = df.sparkSession.createDataFrame([(r[by], i, r["threshold"]) for i, r in held], StructType([models.schema[by], StructField(number, IntegerType()), StructField("threshold", DoubleType())]))
        out = df.join(F.broadcast(numbers), by).withColumn("m", far(sent, df.sparkSession)(F.col(number), v)).drop(number)
    out = out.withColumn("distance", F.sqrt(F.greatest(F.col("m"), F.lit(0.0))))
    return out.withColumn("fit", F.exp(-0.5 * F.pow(F.try_divide(F.col("distance"), F.col("threshold")), F.lit(2.0)))).drop("m", "centre", "precision", "threshold", "n")
