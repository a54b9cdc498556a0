"""Mixture models, grids, projections, feature choice and detectors over the given vectors and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixtures as M
from ..operators.aggregates import exact_quantiles
from ..operators.scoring import robust_models
from ..session import cut
from . import matrix_sql as MX
from .adapters import INSTANCES, OBSERVATIONS, instances, observations, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    robust = cut(robust_models(e, "label", "embedding"), "robust-models")  # one row a label
    models = M.fit_mixtures(e, "label", "embedding", robust=robust)
    limits = {r["label"]: r["threshold"] for r in robust.select("label", "threshold").collect()}
    return M.score(e.select("vec_id", "label", "embedding"), models, "label", "embedding", limits, {g: g % 2 for g in models}).drop("embedding")


@query()
def mixture_assessment(spark, d):
    """Typicality of every vector under its label's mixture, the most typical other label of its class, margin and verdict (fitting and scoring are tested against plain numpy)."""
    out = M.assess(_scored(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("vec_id", "label", r("log_density"), r("typicality"), "best_match", r("best_typicality"), "components", r("margin"), "verdict")


@query()
def calibrated_ranks(spark, d):
    """Log densities as ranks in their label's grid of 1,024 quantiles (the grid is compared in quantile_grids)."""
    scored = cut(_scored(spark, d), "scored")  # used twice
    grid = M.quantile_grid(scored, "label", "log_density")
    return M.ranks_in_grid(scored, grid, "label", "log_density").select("vec_id", "label", F.round("rank", 6).alias("rank"))


@query("""WITH v AS (SELECT lang, n_chars::DOUBLE AS v FROM documents), n AS (SELECT lang, list_sort(list(v)) AS l, count(*) AS n, greatest(least(count(*), 64) - 1, 1) AS m FROM v GROUP BY 1), j AS (SELECT *, unnest(range(0, least(n, 64))) AS j FROM n),
e AS (SELECT lang, n, j, (j * (n - 1)) % m / m::DOUBLE AS part, l[(j * (n - 1)) // m + 1] AS a, l[(j * (n - 1) + m - 1) // m + 1] AS b FROM j) SELECT lang, n, j, round(a + part * (b - a), 6) AS q FROM e""")
def quantile_grids(spark, d):
    """Evenly spaced quantiles of text lengths, 64 a language."""
    return M.quantile_grid(table(spark, d, "documents"), "lang", "n_chars", 64).select("lang", "n", "j", F.round("q", 6).alias("q"))


_SIDES = "(SELECT label AS pair, 0 AS side, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings UNION ALL SELECT (label + 9) % 10, 1, list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings)"


@query(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {_SIDES}), q AS (SELECT pair, i, quantile_cont(v[i], 0.5) AS c, quantile_cont(v[i], 0.75) - quantile_cont(v[i], 0.25) AS w, stddev_pop(v[i]) AS sd FROM r, range(1, 65) t(i) GROUP BY 1, 2),
s AS (SELECT pair, list(c ORDER BY i) AS c, list(CASE WHEN abs(w) > 1e-9 THEN w WHEN abs(sd) > 1e-9 THEN sd ELSE 1.0 END ORDER BY i) AS s FROM q GROUP BY 1), y AS MATERIALIZED (SELECT pair, side, list_transform(v, lambda x, i: (x - c[i]) / s[i]) AS y FROM r JOIN s USING (pair)),
mu AS MATERIALIZED (SELECT pair, side, list(x ORDER BY i) AS mu FROM (SELECT pair, side, i, avg(y[i]) AS x FROM y, range(1, 65) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2), z AS MATERIALIZED (SELECT pair, list_transform(y, lambda x, i: x - mu[i]) AS z FROM y JOIN mu USING (pair, side)),
{MX.eliminated("g", MX.ridged(MX.products("z", "pair", 64, "greatest(n - 1, 1)"), "pair", 64, "1e-2"), "pair", 64)},
w AS (SELECT pair, a.mu AS m0, b.mu AS m1, list_transform(p, lambda line: list_sum(list_transform(range(1, 65), lambda j: line[j] * (b.mu[j] - a.mu[j])))) AS w FROM g_inverse JOIN (SELECT * FROM mu WHERE side = 0) a USING (pair) JOIN (SELECT * FROM mu WHERE side = 1) b USING (pair)),
o AS (SELECT pair, CASE WHEN list_sum(list_transform(range(1, 65), lambda j: (m1[j] - m0[j]) * w[j])) >= 0 THEN 1 ELSE -1 END / sqrt(list_sum(list_transform(w, lambda x: x * x))) AS f, w FROM w) SELECT pair, i::INTEGER - 1 AS dim, round(f * w[i], 6) AS weight FROM o, range(1, 65) t(i)""")
def linear_projections(spark, d):
    """Directions that tell each label from the next one (tested against plain numpy)."""
    e = table(spark, d, "embeddings")
    pairs = e.select(F.explode(F.array(F.struct(F.col("label").alias("pair"), F.lit(0).alias("side")), F.struct(((F.col("label") + 9) % 10).alias("pair"), F.lit(1).alias("side")))).alias("p"), "embedding").select("p.*", "embedding")
    out = M.projections(pairs, "pair", F.col("side"), "embedding")
    return out.select("pair", F.posexplode("weights").alias("dim", "weight")).select("pair", "dim", F.round("weight", 6).alias("weight"))


_PARTS = "(SELECT lang, CASE WHEN n_chars % 3 <> 0 THEN n_chars END AS a, CASE WHEN n_chars % 2 = 0 THEN n_chars END AS b, CASE WHEN source > 'src3' THEN n_chars END AS c FROM documents)"


@query(f"""WITH s AS (SELECT lang, count(a)::DOUBLE / count(*) AS a, count(b)::DOUBLE / count(*) AS b, count(c)::DOUBLE / count(*) AS c FROM {_PARTS} GROUP BY 1), f AS (SELECT lang, list_filter([CASE WHEN a >= 0.6 THEN 'a' END, CASE WHEN b >= 0.6 THEN 'b' END, CASE WHEN c >= 0.6 THEN 'c' END], lambda x: x IS NOT NULL) AS g, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS top FROM s) SELECT lang, CASE WHEN len(g) > 0 THEN array_to_string(g, ',') ELSE top END AS features FROM f""")
def usable_features(spark, d):
    """Features that enough rows of a group have."""
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select("lang", F.when(n % 3 != 0, n).alias("a"), F.when(n % 2 == 0, n).alias("b"), F.when(F.col("source") > "src3", n).alias("c"))
    return M.usable_features(docs, "lang", ["a", "b", "c"]).select("lang", F.array_join("features", ",").alias("features"))


_OBS = f"(SELECT quality, n_chars AS a, doc_id % 1000 AS b, (doc_id * 7) % 500 AS c FROM {OBSERVATIONS} WHERE quality IS NOT NULL)"
_SUBSETS = ["a", "b", "c", "a+b", "a+c", "b+c", "a+b+c"]


@query(f"""WITH x AS (SELECT quality, unnest({_SUBSETS}) AS subset, unnest([a, b, c, a + b, a + c, b + c, a + b + c]) AS score FROM {_OBS}), p AS (SELECT subset, score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM x GROUP BY 1, 2),
u AS (SELECT subset, score, coalesce(sum(neg) OVER w::DOUBLE / nullif(sum(neg) OVER (PARTITION BY subset), 0), 0) AS fp, coalesce(sum(pos) OVER w::DOUBLE / nullif(sum(pos) OVER (PARTITION BY subset), 0), 0) AS recall FROM p WINDOW w AS (PARTITION BY subset ORDER BY score DESC)), t AS (SELECT subset, min(score)::BIGINT AS threshold, max(fp) AS fp, max(recall) AS recall FROM u WHERE fp <= 0.2 GROUP BY 1)
SELECT subset, threshold, round(fp, 9) AS fp, round(recall, 9) AS recall, CASE WHEN recall >= 0.25 THEN 'hard_override' ELSE 'quality_only' END AS authority FROM t""")
def detector_search(spark, d):
    """Every subset of features as a detector, at the threshold that false positives allow, and what it may do."""
    o = observations(spark, d).where("quality IS NOT NULL").select("quality", F.col("n_chars").alias("a"), (F.col("doc_id") % 1000).alias("b"), (F.col("doc_id") * 7 % 500).alias("c"))
    found = M.detectors(o, "quality", ["a", "b", "c"], 0.2)
    call = M.authority(F.lit(1000), F.col("fp"), F.col("recall"), 20, 0.2, 0.25)
    return found.select("subset", F.col("threshold").cast("long").alias("threshold"), F.round("fp", 9).alias("fp"), F.round("recall", 9).alias("recall"), call.alias("authority"))


@query(f"""WITH q AS (SELECT expected AS p, quantile_cont(duration_ms, 0.5) AS m FROM {INSTANCES} GROUP BY 1), c AS (SELECT id, CASE WHEN duration_ms > 3 * m AND length(expected) = 1 THEN expected || 'ː' END AS a, CASE WHEN k % 4 = 0 AND observed <> expected THEN observed END AS b, CASE WHEN confidence < 0.3 THEN coalesce(observed, expected) END AS n FROM {INSTANCES} JOIN q ON p = expected)
SELECT id, CASE WHEN a IS NOT NULL THEN 'duration' WHEN b IS NOT NULL THEN 'pairwise_contrast' WHEN n IS NOT NULL THEN 'gmm_nearest' END AS source, coalesce(a, b, n) AS phone FROM c""")
def analysis_candidates(spark, d):
    """The first kind of evidence that names another phone: duration, then a contrast, then the nearest model."""
    rows = instances(spark, d)
    median = exact_quantiles(rows, ["expected"], "duration_ms", [0.5]).select("expected", F.col("q")[0].alias("m"))
    rows = rows.join(F.broadcast(median), "expected")  # at most the inventory
    long = F.when((F.col("duration_ms") > 3 * F.col("m")) & (F.length("expected") == 1), F.concat("expected", F.lit("ː")))
    contrast = F.when((F.col("k") % 4 == 0) & (F.col("observed") != F.col("expected")), F.col("observed"))
    nearest = F.when(F.col("confidence") < 0.3, F.coalesce("observed", "expected"))
    return rows.select("id", M.first_analysis(("duration", long), ("pairwise_contrast", contrast), ("gmm_nearest", nearest)).alias("x")).select("id", "x.*")
