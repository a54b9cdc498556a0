"""Verdicts, provenance, shards and the smaller row functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import sha1_mod100
from ..operators import scoring as S
from ..operators import windows as W
from . import matrix_sql as M
from .adapters import OBSERVATIONS, PHONE_EVENTS, observations, phone_events, table
from .row_queries import _mod100

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN duration_ms / 100 >= 0.6 THEN 'fit_ok' WHEN (k - 50) / 100.0 <= -0.15 THEN 'likely_substitution' ELSE 'atypical' END AS verdict FROM {PHONE_EVENTS}) GROUP BY 1""")
def atlas_verdicts(spark, d):
    v = S.verdict(F.col("duration_ms") / 100, (F.col("k") - 50) / 100, 0.6, 0.15)
    return phone_events(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT lang, n, layer, CASE layer WHEN 'gop' THEN gop WHEN 'abstain' THEN abstain ELSE whole END AS n_flagged FROM (SELECT lang, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS gop, sum(CASE WHEN quality = 0 AND n_chars > 500 THEN 1 ELSE 0 END)::BIGINT AS abstain, sum(CASE WHEN (quality = 0 AND n_chars > 500) OR toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS whole FROM {OBSERVATIONS} GROUP BY lang), (VALUES ('gop'), ('abstain'), ('whole')) t(layer)""")
def layered_policy(spark, d):
    low, sure = F.col("quality") == 0, F.col("n_chars") > 500
    return S.layer_rates(observations(spark, d), "lang", {"gop": low, "abstain": low & sure, "whole": (low & sure) | (F.col("toxic") == 1)})


@query(f"""SELECT speaker, n_targets, n_extra, round(total / nullif(n_targets, 0) * (n_targets::DOUBLE / (n_targets + n_extra)) * 100, 6) AS score FROM (SELECT speaker, sum(CASE WHEN phone = 'error' THEN 0 ELSE 1 END)::BIGINT AS n_targets, sum(CASE WHEN phone = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_extra, CAST(sum(CASE WHEN phone <> 'error' THEN CAST(k / 100.0 AS DECIMAL(20,6)) END) AS DOUBLE) AS total FROM {PHONE_EVENTS} GROUP BY speaker)""")
def utterance_score(spark, d):
    return S.utterance_scores(phone_events(spark, d).withColumn("s", F.col("k") / 100), "speaker", "s", F.col("phone") == "error")


@query(f"""WITH p AS (SELECT ({_mod100("CAST(doc_id AS VARCHAR)")}) % 5 AS fold, avg(CASE WHEN (n_chars > 1000) = (quality = 1) THEN 1 ELSE 0 END) AS accuracy FROM {OBSERVATIONS} GROUP BY 1) SELECT count(*) AS folds, round(avg(accuracy), 9) AS mean_accuracy, round(stddev_pop(accuracy), 9) AS std_accuracy FROM p""")
def fold_accuracy(spark, d):
    return S.fold_metrics(observations(spark, d), sha1_mod100(F.col("doc_id").cast("string")) % 5, (F.col("n_chars") > 1000) == (F.col("quality") == 1))


_MEDIAN = "(SELECT label, list(c ORDER BY i) AS c FROM (SELECT label, i, quantile_cont(v[i], 0.5) AS c FROM {0}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"
_TRACE = "1e-3 * list_sum(list_transform(m, lambda line, i: line[i])) / 64"
_MINUS = "list_transform(v, lambda x, i: x - c[i])"


@query(f"""WITH RECURSIVE a AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS MATERIALIZED (SELECT * FROM a WHERE label IN (SELECT label FROM a GROUP BY 1 HAVING count(*) >= 20)),
z1 AS MATERIALIZED (SELECT vec_id, label, v, {_MINUS} AS z FROM e JOIN {_MEDIAN.format("e")} USING (label)), {M.eliminated("g1", M.ridged(M.products("z1", "label", 64, "greatest(n - 1, 1)"), "label", 64, _TRACE), "label", 64)},
d1 AS MATERIALIZED (SELECT z1.vec_id, label, v, {M.squared("z", "p", 64)} <= 64 * pow(1 - 2 / (9 * 64.0) + 3.0902323061678132 * sqrt(2 / (9 * 64.0)), 3) AS near FROM z1 JOIN g1_inverse USING (label)),
k AS MATERIALIZED (SELECT * FROM d1 WHERE near OR label IN (SELECT label FROM d1 GROUP BY 1 HAVING count(CASE WHEN near THEN 1 END) < 65)), c2 AS MATERIALIZED (SELECT * FROM {_MEDIAN.format("k")}),
z2 AS MATERIALIZED (SELECT vec_id, label, {_MINUS} AS z FROM k JOIN c2 USING (label)), {M.eliminated("g2", M.ridged(M.products("z2", "label", 64, "greatest(n - 1, 1)"), "label", 64, _TRACE), "label", 64)},
f AS MATERIALIZED (SELECT vec_id, label, {M.squared("z", "p", 64)} AS q FROM (SELECT vec_id, label, {_MINUS} AS z FROM e JOIN c2 USING (label)) JOIN g2_inverse USING (label)), t AS (SELECT label, sqrt(quantile_cont(q, 0.95)) AS t FROM f GROUP BY 1)
SELECT vec_id, label, round(sqrt(q), 6) AS distance, round(exp(-0.5 * q / (t * t)), 6) AS fit FROM f JOIN t USING (label)""")
def robust_scatter(spark, d):
    """Fit of each vector to its label's robust model (compared with numpy as well)."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return S.typicality(e, S.robust_models(e, "label", "v"), "label", "v").select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("fit", 6).alias("fit"))


@query("""SELECT source, arg_min(class, rank) AS worst FROM (SELECT source, CASE WHEN n_chars < 100 THEN 'missing' WHEN n_chars < 1000 THEN 'thin' ELSE 'ok' END AS class, CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 1000 THEN 1 ELSE 2 END AS rank FROM documents) GROUP BY source""")
def worst_class(spark, d):
    n = F.col("n_chars")
    rank = F.when(n < 100, 0).when(n < 1000, 1).otherwise(2)
    name = F.when(n < 100, "missing").when(n < 1000, "thin").otherwise("ok")
    return table(spark, d, "documents").groupBy("source").agg(F.min_by(name, rank).alias("worst"))


@query("""SELECT doc_id, string_agg(s, ',' ORDER BY s) AS found_in FROM (SELECT DISTINCT doc_id, 'documents' AS s FROM documents UNION SELECT DISTINCT doc_id, 'labels' FROM labels) GROUP BY doc_id""")
def union_provenance(spark, d):
    both = table(spark, d, "documents").select("doc_id", F.lit("documents").alias("s")).unionByName(table(spark, d, "labels").select("doc_id", F.lit("labels").alias("s")))
    return both.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("found_in"))


@query("SELECT (doc_id + 3) % 4 AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def round_robin_shards(spark, d):
    return table(spark, d, "documents").groupBy(((F.col("doc_id") + 3) % 4).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT vec_id, len(list_filter(range(1, 33), lambda i: (embedding[i] > 0) <> (embedding[i + 32] > 0))) AS n_differ FROM embeddings")
def differing_positions(spark, d):
    a, b = (F.transform(F.slice("embedding", s, 32), lambda x: x > 0) for s in (1, 33))
    differ = F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda t: t)
    return table(spark, d, "embeddings").select("vec_id", F.size(differ).cast("long").alias("n_differ"))


@query("SELECT conv_id, turn, list_aggregate(list_filter(list_transform(regexp_split_to_array(lower(text), ''), lambda c: CASE WHEN c IN ('é', 'è', 'ê') THEN 'e' WHEN c = ' ' THEN NULL ELSE c END), lambda c: c IS NOT NULL), 'string_agg', '') AS collapsed FROM conversations")
def collapse_tokens(spark, d):
    one = F.transform(F.split(F.lower("text"), ""), lambda c: F.when(c.isin("é", "è", "ê"), "e").when(c == " ", None).otherwise(c))
    joined = F.array_join(F.filter(one, lambda c: c.isNotNull()), "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(joined != "", joined).alias("collapsed"))


@query(f"SELECT event_id, sum(CASE WHEN phone = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY speaker ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS word_index FROM {PHONE_EVENTS}")
def word_index(spark, d):
    new = F.when(F.col("phone") == "view", 1).otherwise(0)
    return W.running(phone_events(spark, d), "speaker", ["start_us", "event_id"], new, "word_index").select("event_id", "word_index")


@query(f"""SELECT event_id, lo, greatest(hi, lo) AS hi, hi <= lo AS fallback FROM (SELECT event_id, coalesce(lag(e) OVER w, s) AS lo, coalesce(lead(s) OVER w, e) AS hi FROM (SELECT event_id, speaker, start_us // 1000 AS s, start_us // 1000 + CAST(trunc(duration_ms) AS BIGINT) AS e FROM {PHONE_EVENTS}) WINDOW w AS (PARTITION BY speaker ORDER BY s, event_id))""")
def quantity_spans(spark, d):
    start = F.floor(F.col("start_us") / 1000)
    e = phone_events(spark, d).select("event_id", "speaker", start.alias("s"), (start + F.col("duration_ms").cast("long")).alias("e"))
    e = W.beside(e, "speaker", ["s", "event_id"], ["s", "e"], W.STRETCH // 1000)
    e = e.select("event_id", F.coalesce("_prev.e", "s").alias("lo"), F.coalesce("_next.s", "e").alias("hi"))
    return e.select("event_id", "lo", F.greatest("hi", "lo").alias("hi"), (F.col("hi") <= F.col("lo")).alias("fallback"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS config_hash, substr(sha1(lang || '|' || source), 1, 12) AS short_key FROM documents")
def stable_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("config_hash"), F.substring(F.sha1(F.concat_ws("|", "lang", "source").cast("binary")), 1, 12).alias("short_key"))


@query("SELECT source, string_agg(DISTINCT CASE WHEN starts_with(lang, 'e') THEN 'CTL' WHEN lang = 'fr' THEN 'W_NAT' WHEN lang = 'de' THEN 'W_ERR' ELSE '?' END, ',' ORDER BY CASE WHEN starts_with(lang, 'e') THEN 'CTL' WHEN lang = 'fr' THEN 'W_NAT' WHEN lang = 'de' THEN 'W_ERR' ELSE '?' END) AS kinds FROM documents GROUP BY source")
def prompt_kinds(spark, d):
    kind = F.when(F.startswith("lang", F.lit("e")), "CTL").when(F.col("lang") == "fr", "W_NAT").when(F.col("lang") == "de", "W_ERR").otherwise("?")
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


@query("SELECT label, dim, round((m - min(m) OVER (PARTITION BY dim)) / nullif(max(m) OVER (PARTITION BY dim) - min(m) OVER (PARTITION BY dim), 0), 4) AS scaled FROM (SELECT label, (i - 1)::INTEGER AS dim, CAST(sum(CAST(x AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, round(unnest(embedding)::DOUBLE, 5) AS x FROM embeddings) GROUP BY 1, 2)")
def scaled_vector_means(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    m = long.groupBy("label", "dim").agg((F.sum(F.round(F.col("x").cast("double"), 5).cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("m"))
    w = Window.partitionBy("dim")
    lo, hi = F.min("m").over(w), F.max("m").over(w)
    return m.select("label", "dim", F.round(F.try_divide(F.col("m") - lo, hi - lo), 4).alias("scaled"))
