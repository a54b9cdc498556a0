"""Aggregates, reports and calibrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from .adapters import OBSERVATIONS, PHONE_EVENTS, observations, phone_events, table

Q, SQL = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT phone, count(*) AS n, count(DISTINCT speaker) AS n_speakers, sum(CASE WHEN k >= 50 THEN 1 ELSE 0 END)::BIGINT AS n_flag,
CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) / count(duration_ms) AS mean_value,
sum(CASE WHEN k >= 50 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS flag_rate FROM {PHONE_EVENTS} GROUP BY phone""")
def phone_profile(spark, d):
    return A.profile(phone_events(spark, d), ["phone"], "duration_ms", "speaker", F.col("k") >= 50)


@query(f"""SELECT provider, phone, count(*) AS n, count(DISTINCT speaker) AS n_speakers, sum(CASE WHEN k >= 50 THEN 1 ELSE 0 END)::BIGINT AS n_flag,
CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) / count(duration_ms) AS mean_value,
sum(CASE WHEN k >= 50 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS flag_rate FROM {PHONE_EVENTS} GROUP BY provider, phone""")
def provider_phone_profile(spark, d):
    return A.profile(phone_events(spark, d), ["provider", "phone"], "duration_ms", "speaker", F.col("k") >= 50)


@query("""SELECT lang, source, count(*) AS n, 'pair' AS level FROM documents GROUP BY lang, source
UNION ALL SELECT lang, NULL, count(*), 'outer' FROM documents GROUP BY lang""")
def lang_source_rollup(spark, d):
    return A.counts_by_level(table(spark, d, "documents"), "lang", "source")


@query(f"""SELECT phone, n, round(m, 6) AS median_value, round((c - a) / 1.349, 6) AS scale FROM (SELECT phone, count(*) AS n,
quantile_cont(duration_ms, 0.25) AS a, quantile_cont(duration_ms, 0.5) AS m, quantile_cont(duration_ms, 0.75) AS c FROM {PHONE_EVENTS} GROUP BY phone) WHERE n >= 50""")
def robust_duration_stats(spark, d):
    return A.robust_scale(phone_events(spark, d), "phone", "duration_ms", 50)


@query(f"""SELECT phone, p, round(v, 6) AS v FROM (SELECT phone, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p,
unnest(quantile_cont(duration_ms, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM {PHONE_EVENTS} GROUP BY phone)""")
def quantile_profile(spark, d):
    return A.quantiles(phone_events(spark, d), "phone", "duration_ms", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("""SELECT lang, feature, count(*) AS n, count(x) AS n_present, count(x)::DOUBLE / count(*) AS coverage FROM (
SELECT d.lang, unnest(['quality', 'toxic', 'n_chars']) AS feature, unnest([l.quality, l.toxic, d.n_chars]) AS x FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY lang, feature""")
def feature_availability(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return A.availability(rows.select("lang", F.col("quality").cast("long"), F.col("toxic").cast("long"), "n_chars"), "lang", ["quality", "toxic", "n_chars"])


@query(f"""WITH inv AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'unseen']) AS phone),
c AS (SELECT phone, provider, count(*) AS c FROM {PHONE_EVENTS} GROUP BY 1, 2),
h AS (SELECT phone, sum(c)::BIGINT AS n, string_agg(provider || '=' || c, ';' ORDER BY provider || '=' || c) AS distribution FROM c GROUP BY 1),
x AS (SELECT phone, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS examples FROM (SELECT phone, event_id, row_number() OVER (PARTITION BY phone ORDER BY event_id) AS r FROM {PHONE_EVENTS}) WHERE r <= 3 GROUP BY 1)
SELECT phone, coalesce(n, 0) AS n, coalesce(distribution, '') AS distribution, coalesce(examples, '') AS examples FROM inv LEFT JOIN h USING (phone) LEFT JOIN x USING (phone)""")
def zero_filled_inventory(spark, d):
    inventory = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "unseen")], "phone string")
    return A.zero_filled_counts(phone_events(spark, d), inventory, "phone", "provider", "event_id")


@query(f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE coalesce(lang, 'unknown') END AS lang, count(*) AS n, coalesce(sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_flagged,
sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0) AS rate FROM {OBSERVATIONS} GROUP BY ROLLUP (lang)""")
def hard_flag_rollup(spark, d):
    return A.flagged_report(observations(spark, d), "lang", (F.col("toxic") == 1) | (F.col("quality") == 0))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN duration_ms < 5 THEN 'too_short' END, CASE WHEN duration_ms > 150 THEN 'too_long' END, CASE WHEN k < 10 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS reason FROM {PHONE_EVENTS}) GROUP BY reason""")
def unscored_reasons(spark, d):
    e = phone_events(spark, d)
    why = F.array_compact(F.array(F.when(F.col("duration_ms") < 5, "too_short"), F.when(F.col("duration_ms") > 150, "too_long"), F.when(F.col("k") < 10, "low_confidence")))
    return A.reason_counts(e.select(why.alias("reasons")), "reasons")


@query(f"""SELECT lang, n, k, round(greatest(0.0, (p + z*z/(2*n) - h) / (1 + z*z/n)), 9) AS low, round(least(1.0, (p + z*z/(2*n) + h) / (1 + z*z/n)), 9) AS high FROM (
SELECT *, z * sqrt(p * (1 - p) / n + z*z / (4*n*n)) AS h FROM (SELECT lang, count(*) AS n, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS k, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS p, 1.96::DOUBLE AS z FROM {OBSERVATIONS} GROUP BY lang))""")
def wilson_by_lang(spark, d):
    return A.proportion(observations(spark, d), "lang", F.col("toxic") == 1)


@query(f"""WITH o AS {OBSERVATIONS}, r AS (SELECT lang, quality, n_chars, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM o WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
a AS (SELECT lang, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END)::BIGINT AS n_neg, sum(CASE WHEN quality = 1 THEN rk ELSE 0 END) AS rs,
count(CASE WHEN quality = 0 THEN 1 END) AS n0, count(CASE WHEN quality = 1 THEN 1 END) AS n1, avg(CASE WHEN quality = 0 THEN n_chars END) AS m0, avg(CASE WHEN quality = 1 THEN n_chars END) AS m1, var_samp(CASE WHEN quality = 0 THEN n_chars END) AS v0, var_samp(CASE WHEN quality = 1 THEN n_chars END) AS v1 FROM r GROUP BY lang),
b AS (SELECT *, (rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0) AS auc FROM a)
SELECT lang, n_pos, n_neg, round(greatest(auc, 1 - auc), 9) AS auc, round(CASE WHEN n0 >= 2 AND n1 >= 2 THEN (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) END, 6) AS cohens_d FROM b""")
def auc_cohen(spark, d):
    return A.separation(observations(spark, d), "lang", "n_chars", "quality")


@query(f"""WITH p AS (SELECT n_chars AS cut, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM {OBSERVATIONS} GROUP BY 1),
b AS (SELECT cut, round((sum(pos) OVER (ORDER BY cut DESC)::DOUBLE / sum(pos) OVER () + (1 - sum(neg) OVER (ORDER BY cut DESC)::DOUBLE / sum(neg) OVER ())) / 2, 9) AS balanced_accuracy FROM p)
SELECT cut, balanced_accuracy FROM b ORDER BY balanced_accuracy DESC, cut LIMIT 1""")
def best_threshold(spark, d):
    return A.best_threshold(observations(spark, d), "n_chars", "quality")


_MARGINS = """(SELECT label, (label + 1 + vec_id % 2) % 10 AS other, (list_sum(list_transform(embedding[1:32], lambda v: CAST(round(v::DOUBLE, 4) AS DECIMAL(18,4)))) - list_sum(list_transform(embedding[33:64], lambda v: CAST(round(v::DOUBLE, 4) AS DECIMAL(18,4)))))::DOUBLE AS margin,
CASE WHEN embedding[3] > 0 THEN (label + 1 + vec_id % 2) % 10 WHEN embedding[3] > -0.1 THEN label END AS observed FROM embeddings)"""


def contrast_margins(spark, d):
    """Margins of a label against its next one or the next but one: the difference of the sums of both halves of a vector."""
    total = lambda first: F.aggregate(F.slice("embedding", first, 32), F.lit(0).cast("decimal(18,4)"), lambda s, v: (s + F.round(v.cast("double"), 4).cast("decimal(18,4)")).cast("decimal(18,4)"))
    other = (F.col("label") + 1 + F.col("vec_id") % 2) % 10
    observed = F.when(F.col("embedding")[2] > 0, other).when(F.col("embedding")[2] > F.lit(-0.1).cast("float"), F.col("label"))
    return table(spark, d, "embeddings").select("label", other.alias("other"), (total(1) - total(33)).cast("double").alias("margin"), observed.alias("observed"))


@query(f"""SELECT label, other, count(*) AS n, round(quantile_cont(margin, 0.5), 6) AS median_margin, sum(CASE WHEN margin < 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS fp_rate,
sum(CASE WHEN observed = other THEN 1 ELSE 0 END)::DOUBLE / nullif(count(observed), 0) AS cross_confusion, round(quantile_cont(margin, 0.5), 6) >= 0.0 AND sum(CASE WHEN margin < 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) <= 0.5 AS override FROM {_MARGINS} GROUP BY label, other HAVING count(*) >= 20""")
def authority_calibration(spark, d):
    return A.calibrate_pairs(contrast_margins(spark, d), "label", "other", "margin", "observed", 20, 0.0, 0.5)


#: Contrasts that are in the fixed scope, one of them without a row.
_FIXED = [(0, 1), (0, 2), (3, 4), (5, 9), (7, 8)]


@query(f"""WITH p AS (SELECT unnest({[list(x) for x in _FIXED]}) AS p), f AS (SELECT p[1] AS label, p[2] AS other FROM p), g AS (SELECT label, other, count(*) AS n, round(quantile_cont(margin, 0.5), 6) AS m, sum(CASE WHEN margin < 0 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS fp, sum(CASE WHEN observed = other THEN 1 ELSE 0 END)::DOUBLE / nullif(count(observed), 0) AS x FROM {_MARGINS} GROUP BY 1, 2)
SELECT f.label, f.other, coalesce(n, 0) AS n, CASE WHEN n >= 20 THEN m END AS median_margin, CASE WHEN n >= 20 THEN fp ELSE 0.0 END AS fp_rate, CASE WHEN n >= 20 THEN x END AS cross_confusion, coalesce(n >= 20 AND m >= 0.0 AND fp <= 0.5, false) AS override, coalesce(n >= 20 AND m >= 0.0, false) AS separable, true AS reliable FROM f LEFT JOIN g ON g.label = f.label AND g.other = f.other""")
def fixed_calibration(spark, d):
    """The same for a fixed list of contrasts: all of them are there, reliable by decree; those with too few rows allow nothing."""
    fixed = spark.createDataFrame(_FIXED, "label int, other int")
    return A.calibrate_fixed(contrast_margins(spark, d), fixed, "label", "other", "margin", "observed", 20, 0.0, 0.5)


@query("""SELECT label, (i - 1)::INTEGER AS dim, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median_x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i""")
def median_vector_by_label(spark, d):
    return A.vector_means(table(spark, d, "embeddings"), "label", "embedding")


@query(f"""SELECT phone, total, round(total / sum(total) OVER (), 9) AS share FROM (SELECT phone, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) AS total FROM {PHONE_EVENTS} GROUP BY phone)""")
def share_by_phone(spark, d):
    return A.share_of_total(phone_events(spark, d), "phone", "duration_ms")


@query(f"""SELECT provider, CAST(sum(CAST(duration_ms * k AS DECIMAL(20,6))) AS DOUBLE) / CAST(sum(CAST(k AS DECIMAL(20,6))) AS DOUBLE) AS weighted_mean FROM {PHONE_EVENTS} GROUP BY provider""")
def weighted_mean_by_provider(spark, d):
    return A.weighted_mean(phone_events(spark, d), "provider", "duration_ms", "k")


@query(f"""WITH b AS (SELECT band, keep_low, keep_toxic FROM (VALUES ('all', true, true), ('quality_only', true, false), ('toxic_only', false, true), ('none', false, false)) t(band, keep_low, keep_toxic))
SELECT band, lang, count(*) AS n, sum(CASE WHEN (keep_low AND quality = 0) OR (keep_toxic AND toxic = 1) THEN 1 ELSE 0 END)::BIGINT AS n_flagged FROM {OBSERVATIONS} o, b GROUP BY band, lang""")
def policy_frontier(spark, d):
    low, bad = F.col("quality") == 0, F.col("toxic") == 1
    bands = {"all": low | bad, "quality_only": low, "toxic_only": bad, "none": F.lit(False)}
    per = observations(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(b) for b, c in bands.items()])
    return per.unpivot(["lang", "n"], list(bands), "band", "n_flagged")  # no product of rows and bands


@query("""SELECT source, count(*) AS n, sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS n_blank, count(*) - count(DISTINCT doc_id) AS n_repeated_ids,
sum(CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 1 ELSE 0 END)::BIGINT AS n_bad_lang, sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END)::BIGINT AS n_bad_length FROM documents GROUP BY source""")
def integrity_audit(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    docs = table(spark, d, "documents")
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), n(blank).alias("n_blank"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("n_repeated_ids"), n(~F.col("lang").isin("en", "de", "fr", "es")).alias("n_bad_lang"), n(F.col("n_chars") != F.length("text")).alias("n_bad_length"))


@query("""SELECT count(CASE WHEN a AND b THEN 1 END) AS n_both, count(CASE WHEN a AND NOT b THEN 1 END) AS n_missing, count(CASE WHEN b AND NOT a THEN 1 END) AS n_extra, count(CASE WHEN a AND b THEN 1 END)::DOUBLE / count(CASE WHEN a THEN 1 END) AS coverage
FROM (SELECT d.doc_id, d.doc_id % 5 <> 0 AS a, d.doc_id IN (SELECT doc_id FROM labels) AS b FROM (SELECT DISTINCT doc_id FROM documents) d)""")
def coverage_sets(spark, d):
    """Labels against the documents that are wanted (four of five): covered, missing, extra."""
    return J.coverage(table(spark, d, "documents").where("doc_id % 5 <> 0"), table(spark, d, "labels"), "doc_id")


@query("""SELECT p_brand, split_part(p_type, ' ', 1) AS status, count(*) AS n, count(*) >= 20 AS enough FROM part GROUP BY 1, 2""")
def label_status_coverage(spark, d):
    status = F.split_part("p_type", F.lit(" "), F.lit(1))
    return table(spark, d, "part").groupBy("p_brand", status.alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= 20)


@query(f"""SELECT phone, count(CASE WHEN provider = 'p0' THEN 1 END) AS p0, count(CASE WHEN provider = 'p1' THEN 1 END) AS p1, count(CASE WHEN provider = 'p2' THEN 1 END) AS p2, count(CASE WHEN provider = 'p3' THEN 1 END) AS p3 FROM {PHONE_EVENTS} GROUP BY phone""")
def side_by_side_counts(spark, d):
    return phone_events(spark, d).groupBy("phone").pivot("provider", ["p0", "p1", "p2", "p3"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""SELECT floor(duration_ms / 25)::BIGINT AS bucket, count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) AS total FROM {PHONE_EVENTS} GROUP BY 1""")
def duration_buckets(spark, d):
    return phone_events(spark, d).groupBy(F.floor(F.col("duration_ms") / 25).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("duration_ms").cast("decimal(20,6)")).cast("double").alias("total"))


@query("""WITH r AS (SELECT lang, doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars::DOUBLE END AS a, length(source)::DOUBLE AS b, NULL::DOUBLE AS c FROM documents), l AS (SELECT lang, doc_id, unnest(['a', 'b', 'c']) AS feature, unnest([a, b, c]) AS x FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, feature ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, doc_id) AS k FROM l) SELECT lang, feature, count(*) AS n, round(count(CASE WHEN x IS NULL THEN 1 END)::DOUBLE / count(*), 9) AS null_rate, count(CASE WHEN k <= 40 AND x IS NOT NULL THEN 1 END) AS n_sample,
round(quantile_cont(CASE WHEN k <= 40 THEN x END, 0.05), 6) AS p05, round(quantile_cont(CASE WHEN k <= 40 THEN x END, 0.5), 6) AS p50, round(quantile_cont(CASE WHEN k <= 40 THEN x END, 0.95), 6) AS p95 FROM f GROUP BY 1, 2""")
def sampled_percentiles(spark, d):
    """How much of each feature is absent, and percentiles of its first forty values."""
    docs = table(spark, d, "documents").select("lang", "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("a"), F.length("source").alias("b"), F.lit(None).cast("double").alias("c"))
    out = A.sample_percentiles(docs, "lang", ["a", "b", "c"], "doc_id", 40, [0.05, 0.5, 0.95])
    return out.select("lang", "feature", "n", F.round("null_rate", 9).alias("null_rate"), "n_sample", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p05", "p50", "p95"))])
