"""Logistic models over group folds and held-out contexts, and linear detectors chosen on held-out splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.exprs import sha1_mod100
from ..operators import classifiers as C
from .adapters import OBSERVATIONS, observations, table
from .set_queries import _mod100

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


STEPS = 12


def _logistic_sql(fold: str) -> str:
    """Common table expressions up to `judged`: fold, n_pos, n_neg, auc, balanced, w0 to w2."""
    p = "1 / (1 + exp(-(w0 + w1 * u + w2 * v)))"
    steps = ["b0 AS (SELECT k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM sc)"]
    for i in range(STEPS):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT k, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, sum(c * (y - p)) AS g0, sum(c * (y - p) * u) - any_value(w1) AS g1, sum(c * (y - p) * v) - any_value(w2) AS g2,
sum(s) AS a, sum(s * u) AS b, sum(s * v) AS d, sum(s * u * u) + 1 AS e, sum(s * u * v) AS f, sum(s * v * v) + 1 AS h FROM (SELECT *, c * p * (1 - p) AS s FROM (SELECT x.*, w0, w1, w2, {p} AS p FROM x JOIN b{i} USING (k))) GROUP BY k)""")
        det = "(a * (e * h - f * f) - b * (b * h - f * d) + d * (b * f - e * d))"
        steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT k, w0 + (g0 * (e * h - f * f) - b * (g1 * h - f * g2) + d * (g1 * f - e * g2)) / {det} AS w0,
w1 + (a * (g1 * h - f * g2) - g0 * (b * h - f * d) + d * (b * g2 - g1 * d)) / {det} AS w1, w2 + (a * (e * g2 - g1 * f) - b * (b * g2 - g1 * d) + g0 * (b * f - e * d)) / {det} AS w2 FROM g{i})""")
    return f"""WITH o AS MATERIALIZED (SELECT quality AS y, CASE WHEN doc_id % 7 <> 0 THEN n_chars::DOUBLE END AS a, (doc_id % 1000)::DOUBLE AS b, {fold} AS fold FROM {OBSERVATIONS} WHERE quality IS NOT NULL),
t AS MATERIALIZED (SELECT o.*, k FROM o, (SELECT DISTINCT fold AS k FROM o WHERE fold IS NOT NULL) WHERE fold IS NULL OR fold <> k),
sc AS MATERIALIZED (SELECT k, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb, sum(y) AS np, sum(1 - y) AS nn FROM t GROUP BY k HAVING sum(y) > 0 AND sum(1 - y) > 0),
st AS MATERIALIZED (SELECT k, avg(coalesce(a, ma)) AS ua, stddev_pop(coalesce(a, ma)) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM t JOIN sc USING (k) GROUP BY k),
x AS MATERIALIZED (SELECT k, y, (coalesce(a, ma) - ua) / sa AS u, (b - ub) / sb AS v, CASE WHEN y = 1 THEN (np + nn) / (2.0 * np) ELSE (np + nn) / (2.0 * nn) END AS c FROM t JOIN sc USING (k) JOIN st USING (k)),
{", ".join(steps)},
held AS (SELECT k, y, {p} AS p FROM (SELECT k, y, w0, w1, w2, (coalesce(a, ma) - ua) / sa AS u, (b - ub) / sb AS v FROM o JOIN b{STEPS} ON fold = k JOIN sc USING (k) JOIN st USING (k))),
ranked AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS r FROM held),
judged AS (SELECT k AS fold, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc,
(sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END)::DOUBLE / sum(y) + sum(CASE WHEN y = 0 AND p < 0.5 THEN 1 ELSE 0 END)::DOUBLE / sum(1 - y)) / 2 AS balanced FROM ranked GROUP BY k HAVING sum(y) > 0 AND sum(1 - y) > 0)"""


_FOLD = f"{_mod100('source')} % 5"
FEATURES = ["a", "b"]


def _observed(spark, d, fold):
    o = observations(spark, d).where("quality IS NOT NULL").withColumn("fold", fold)
    return o.select("quality", "fold", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("a"), (F.col("doc_id") % 1000).cast("double").alias("b"))


def _judged(o):
    models = C.logistic_folds(o, "quality", FEATURES, F.col("fold"), steps=STEPS)
    return models, C.fold_report(C.predicted(o, models, FEATURES, F.col("fold")), "quality", "p", "fold")


@query(f"""{_logistic_sql(_FOLD)} SELECT j.fold, n_pos, n_neg, round(auc, 6) AS auc, round(balanced, 6) AS balanced, round(w0, 6) AS constant, round(w1, 6) AS weight_a, round(w2, 6) AS weight_b FROM judged j JOIN b{STEPS} ON k = j.fold""")
def logistic_group_folds(spark, d):
    """Five folds by a hash of the source, so that no source is trained on and judged: the models and what they tell apart."""
    models, report = _judged(_observed(spark, d, sha1_mod100(F.col("source")) % 5))
    rows = [(int(k), *(float(x) for x in w)) for k, (w, _) in models.items()]
    weights = spark.createDataFrame(rows, "fold int, constant double, weight_a double, weight_b double")  # one row a fold
    out = report.join(F.broadcast(weights), "fold")
    return out.select("fold", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("balanced", 6).alias("balanced"), *[F.round(c, 6).alias(c) for c in ("constant", "weight_a", "weight_b")])


@query(f"""{_logistic_sql(_FOLD)} SELECT count(*) AS folds, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, round(avg(balanced), 6) AS balanced_mean, round(stddev_pop(balanced), 6) AS balanced_std FROM judged""")
def cross_validated(spark, d):
    """Means and spreads over the folds."""
    _, report = _judged(_observed(spark, d, sha1_mod100(F.col("source")) % 5))
    r = lambda c, name: F.round(c, 6).alias(name)
    return report.agg(F.count(F.lit(1)).alias("folds"), r(F.avg("auc"), "auc_mean"), r(F.stddev_pop("auc"), "auc_std"), r(F.avg("balanced"), "balanced_mean"), r(F.stddev_pop("balanced"), "balanced_std"))


@query(f"""{_logistic_sql("CASE WHEN lang = 'en' THEN 0 END")} SELECT n_pos, n_neg, round(auc, 6) AS auc, round(balanced, 6) AS balanced FROM judged""")
def held_out_context(spark, d):
    """Trained outside of one context (a language), judged within it."""
    _, report = _judged(_observed(spark, d, F.when(F.col("lang") == "en", 0)))
    return report.select("n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("balanced", 6).alias("balanced"))


_SHARED = "embedding[4]::DOUBLE AS quality, CASE vec_id // 10 % 5 WHEN 3 THEN 'dev' WHEN 4 THEN 'test' ELSE 'train' END AS split, embedding[1]::DOUBLE + 0.2 * (label % 3) AS a, CASE WHEN vec_id % 9 <> 0 THEN embedding[2]::DOUBLE - 0.1 * (label % 2) END AS b, embedding[3]::DOUBLE + embedding[1]::DOUBLE * 0.5 AS c"
_SETS = [s for n in (1, 2, 3) for s in combinations("abc", n)]
_PASS = "avg(CASE WHEN side = {side} AND split = '{split}' THEN CASE WHEN fits AND score >= threshold THEN 1.0 ELSE 0.0 END END)"
FP, RECALL = 0.3, 0.3


@query(f"""WITH e AS (SELECT label AS pair, 0 AS side, {_SHARED} FROM embeddings UNION ALL SELECT (label + 9) % 10, 1, {_SHARED} FROM embeddings),
r0 AS MATERIALIZED ({" UNION ALL ".join(f"SELECT pair, side, split, quality, '{'+'.join(s)}' AS subset, [{', '.join(s)}] AS x FROM e WHERE {' AND '.join(f'{c} IS NOT NULL' for c in s)}" for s in _SETS)}),
us AS (SELECT pair, subset FROM r0 GROUP BY 1, 2 HAVING {" AND ".join(f"count(CASE WHEN side = {k} AND split = '{s}' THEN 1 END) >= {n}" for k in (0, 1) for s, n in (("train", 8), ("dev", 2), ("test", 2)))}),
r AS MATERIALIZED (SELECT r0.* FROM r0 JOIN us USING (pair, subset)), tr AS MATERIALIZED (SELECT * FROM r WHERE split = 'train'),
q AS (SELECT pair, subset, i, quantile_cont(x[i], 0.5) AS c, quantile_cont(x[i], 0.75) - quantile_cont(x[i], 0.25) AS w, stddev_pop(x[i]) AS sd FROM tr, range(1, 4) t(i) WHERE i <= len(x) GROUP BY ALL),
sc AS MATERIALIZED (SELECT pair, subset, list(c ORDER BY i) AS c, list(CASE WHEN abs(w) > 1e-9 THEN w WHEN abs(sd) > 1e-9 THEN sd ELSE 1.0 END ORDER BY i) AS s FROM q GROUP BY ALL),
z AS (SELECT pair, subset, side, list_transform(range(1, 4), lambda i: coalesce((x[i] - c[i]) / s[i], 0.0)) AS z, len(x) AS d FROM tr JOIN sc USING (pair, subset)),
m AS MATERIALIZED (SELECT pair, subset, side, any_value(d) AS d, count(*) AS n, {", ".join(f"avg(z[{i}]) AS m{i}" for i in (1, 2, 3))}, {", ".join(f"sum(z[{i}] * z[{j}]) AS s{i}{j}" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))} FROM z GROUP BY ALL),
k AS (SELECT pair, subset, a.d, {", ".join(f"b.m{i} - a.m{i} AS g{i}, a.m{i} AS t{i}, b.m{i} AS u{i}" for i in (1, 2, 3))}, {", ".join(f"(a.s{i}{j} - a.n * a.m{i} * a.m{j} + b.s{i}{j} - b.n * b.m{i} * b.m{j}) / greatest(1, a.n + b.n - 1) + {0.01 if i == j else 0.0} AS k{i}{j}" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))} FROM m a JOIN m b USING (pair, subset) WHERE a.side = 0 AND b.side = 1),
w AS (SELECT *, CASE WHEN d = 1 THEN [CASE WHEN g1 >= 0 THEN 1.0 ELSE -1.0 END, 0.0, 0.0] ELSE [g1 * (k22 * k33 - k23 * k23) - k12 * (g2 * k33 - k23 * g3) + k13 * (g2 * k23 - k22 * g3), k11 * (g2 * k33 - k23 * g3) - g1 * (k12 * k33 - k23 * k13) + k13 * (k12 * g3 - g2 * k13), k11 * (k22 * g3 - g2 * k23) - k12 * (k12 * g3 - g2 * k13) + g1 * (k12 * k23 - k22 * k13)] END AS w0 FROM k),
f AS MATERIALIZED (SELECT pair, subset, list_transform(w0[1:d], lambda v: v * CASE WHEN u1 * w0[1] + u2 * w0[2] + u3 * w0[3] < t1 * w0[1] + t2 * w0[2] + t3 * w0[3] THEN -1 ELSE 1 END / sqrt(list_sum(list_transform(w0, lambda x: x * x)))) AS w FROM w),
p AS MATERIALIZED (SELECT r.pair, r.subset, side, split, quality <= 0.1 AS fits, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) / s[i] * w[i])), 9) AS score FROM r JOIN sc USING (pair, subset) JOIN f USING (pair, subset)),
n AS (SELECT pair, subset, count(*) AS n FROM p WHERE side = 0 AND split = 'dev' GROUP BY ALL), o AS (SELECT pair, subset, list(score ORDER BY score DESC) AS l FROM p WHERE side = 0 AND split = 'dev' AND fits GROUP BY ALL),
th AS (SELECT pair, subset, CASE WHEN floor({FP} * n) >= len(l) THEN l[len(l)] ELSE nextafter(l[floor({FP} * n)::INTEGER + 1], 'infinity'::DOUBLE) END AS threshold FROM n JOIN o USING (pair, subset)),
ra AS (SELECT pair, subset, threshold, {_PASS.format(side=0, split="dev")} AS dev_fp, {_PASS.format(side=0, split="test")} AS test_fp, {_PASS.format(side=1, split="dev")} AS dev_recall, {_PASS.format(side=1, split="test")} AS test_recall FROM p JOIN th USING (pair, subset) GROUP BY ALL),
mg AS (SELECT pair, subset, quantile_cont(CASE WHEN side = 1 THEN score END, 0.5) - quantile_cont(CASE WHEN side = 0 THEN score END, 0.5) AS train_margin FROM p WHERE split = 'train' GROUP BY ALL),
al AS (SELECT ra.*, train_margin, w, train_margin > 0 AND dev_fp <= {FP} AND test_fp <= {FP} AND dev_recall >= {RECALL} AND test_recall >= {RECALL} AS accepted FROM ra JOIN mg USING (pair, subset) JOIN f USING (pair, subset))
SELECT pair, subset, list_aggregate(list_transform(w, lambda x: format('{{:.5f}}', x)), 'string_agg', ',') AS weights, round(threshold, 7) AS threshold, round(dev_fp, 6) AS dev_fp, round(test_fp, 6) AS test_fp, round(dev_recall, 6) AS dev_recall, round(test_recall, 6) AS test_recall, round(train_margin, 7) AS train_margin, accepted,
accepted AND row_number() OVER (PARTITION BY pair, accepted ORDER BY test_recall DESC, dev_recall DESC, train_margin DESC, len(w), subset DESC) = 1 AS best FROM al""")
def detector_selection(spark, d):
    """Every subset of three features as a detector of each label's neighbour: fitted, held to a false-positive ceiling, accepted on held-out speakers."""
    k, v = F.col("label"), lambda i: F.col("embedding")[i].cast("double")
    split = F.when(F.floor(F.col("vec_id") / 10) % 5 == 3, "dev").when(F.floor(F.col("vec_id") / 10) % 5 == 4, "test").otherwise("train")
    sides = F.array(F.struct(k.alias("pair"), F.lit(0).alias("side")), F.struct(((k + 9) % 10).alias("pair"), F.lit(1).alias("side")))
    e = table(spark, d, "embeddings").select(F.explode(sides).alias("p"), v(3).alias("quality"), split.alias("split"), (v(0) + 0.2 * (k % 3)).alias("a"), F.when(F.col("vec_id") % 9 != 0, v(1) - 0.1 * (k % 2)).alias("b"), (v(2) + v(0) * 0.5).alias("c"))
    out = C.fitted_detectors(e.select("p.*", "quality", "split", "a", "b", "c"), "pair", ["a", "b", "c"], FP, RECALL, min_samples=8, min_eval=2, quality_ceiling=0.1)
    r = lambda c, n=6: F.round(c, n).alias(c)
    weights = F.array_join(F.transform("weights", lambda w: F.format_string("%.5f", w)), ",").alias("weights")
    return out.select("pair", "subset", weights, r("threshold", 7), r("dev_fp"), r("test_fp"), r("dev_recall"), r("test_recall"), r("train_margin", 7), "accepted", "best")
