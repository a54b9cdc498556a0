"""Sets and shares of phone instances: filters by id sets, pairs, folds, shares, caches, days, clamps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import phones as P
from ..functions.exprs import dot, rate_or_null, sha1_mod100, words
from ..operators import aggregates as A
from ..operators import sampling as S
from .adapters import INSTANCES, OBSERVATIONS, PHONE_EVENTS, instances, observations, sql_list, table
from .rule_queries import _CLASS
from .row_queries import _mod100
from .text_queries import _W

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"SELECT id, expected FROM {INSTANCES} WHERE segment IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def id_set_filter(spark, d):
    """Rows whose key is in a set taken from another table."""
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("segment"))
    return instances(spark, d).join(wanted, "segment", "left_semi").select("id", "expected")


@query("SELECT coalesce(c_mktsegment, 'unknown') AS provider, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS total FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 <> 0 GROUP BY 1")
def provider_lookup(spark, d):
    """A lookup that says unknown where it finds nothing."""
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = table(spark, d, "events").join(known, "user_id", "left")
    return rows.groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("provider")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"))


@query(f"""WITH i AS (SELECT unnest({P.PHONES}) AS p), c AS (SELECT expected, observed, count(*) AS n FROM {INSTANCES} GROUP BY 1, 2) SELECT a.p AS target, b.p AS alternative, coalesce(n, 0) AS n FROM i a JOIN i b ON a.p <> b.p LEFT JOIN c ON c.expected = a.p AND c.observed = b.p""")
def alternative_pairs(spark, d):
    """Every ordered pair of different phones (the inventory times itself, a fixed dictionary), with how often one stands for the other."""
    inventory = spark.createDataFrame([(p,) for p in P.PHONES], "p string")
    pairs = inventory.select(F.col("p").alias("target")).join(F.broadcast(inventory.select(F.col("p").alias("alternative"))), F.col("target") != F.col("alternative"))
    n = instances(spark, d).groupBy(F.col("expected").alias("target"), F.col("observed").alias("alternative")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(n, ["target", "alternative"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""SELECT expected, id, confidence, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY coalesce(confidence, -1) DESC, id, start_ms, end_ms) AS r FROM {INSTANCES}) WHERE r <= 7""")
def manual_queue(spark, d):
    """The surest instances of each phone; those without a confidence come last."""
    order = [F.desc(F.coalesce("confidence", F.lit(-1.0))), F.asc("id"), F.asc("start_ms"), F.asc("end_ms")]
    return S.top_per_group(instances(spark, d), ["expected"], order, 7).select("expected", "id", "confidence", F.col("rank").cast("long"))


_FOLD = _mod100("CAST(segment AS VARCHAR)") + " % 5"


@query(f"""WITH r AS (SELECT *, {_FOLD} AS fold, CASE WHEN status = 'correct' THEN 1 ELSE 0 END AS y FROM {INSTANCES}) SELECT fold, y, count(*) AS n, count(DISTINCT segment) AS n_groups FROM r GROUP BY 1, 2""")
def group_folds(spark, d):
    """Five folds by a hash of the group, so that no group is in two; rows of each class in each."""
    rows = instances(spark, d).withColumn("fold", sha1_mod100(F.col("segment").cast("string")) % 5)
    return rows.groupBy("fold", F.when(F.col("status") == "correct", 1).otherwise(0).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment").alias("n_groups"))


@query(f"""WITH o AS (SELECT *, {_mod100("CAST(doc_id AS VARCHAR)")} % 5 AS fold FROM {OBSERVATIONS} WHERE quality IS NOT NULL), r AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY n_chars) + (count(*) OVER (PARTITION BY fold, n_chars) - 1) / 2.0 AS rk, n_chars FROM o),
a AS (SELECT fold, (sum(CASE WHEN quality = 1 THEN rk ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * sum(1 - quality), 0) AS auc, (sum(CASE WHEN quality = 1 AND n_chars >= 1000 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(quality), 0) + sum(CASE WHEN quality = 0 AND n_chars < 1000 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(1 - quality), 0)) / 2 AS bal FROM r GROUP BY 1)
SELECT count(*) AS folds, round(avg(greatest(auc, 1 - auc)), 8) AS auc_mean, round(stddev_pop(greatest(auc, 1 - auc)), 8) AS auc_std, round(avg(bal), 8) AS balanced_mean, round(stddev_pop(bal), 8) AS balanced_std FROM a""")
def fold_separation(spark, d):
    """AUC and balanced accuracy of each fold, then their means and spreads."""
    o = observations(spark, d).where("quality IS NOT NULL").withColumn("fold", sha1_mod100(F.col("doc_id").cast("string")) % 5)
    auc = A.separation(o, "fold", "n_chars", "quality").select("fold", "auc")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    y, high = F.col("quality") == 1, F.col("n_chars") >= 1000
    bal = o.groupBy("fold").agg(((rate_or_null(n(y & high), F.nullif(n(y), F.lit(0))) + rate_or_null(n(~y & ~high), F.nullif(n(~y), F.lit(0)))) / 2).alias("bal"))
    both = auc.join(bal, "fold")
    r = lambda c, name: F.round(c, 8).alias(name)
    return both.agg(F.count(F.lit(1)).alias("folds"), r(F.avg("auc"), "auc_mean"), r(F.stddev_pop("auc"), "auc_std"), r(F.avg("bal"), "balanced_mean"), r(F.stddev_pop("bal"), "balanced_std"))


@query(f"""SELECT class, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share, round(caught::DOUBLE / n, 6) AS detection FROM (SELECT {_CLASS} AS class, count(*) AS n, count(CASE WHEN status <> 'correct' THEN 1 END) AS caught FROM {INSTANCES} WHERE k % 4 = 0 GROUP BY 1)""")
def class_shares(spark, d):
    """Each class's share of the intended errors, and how many of its own are caught."""
    rows = instances(spark, d).where(F.col("k") % 4 == 0)
    per = rows.groupBy(P.phone_class(F.col("expected")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") != "correct", 1).otherwise(0)).alias("caught"))
    return per.select("class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"), F.round(F.col("caught") / F.col("n"), 6).alias("detection"))  # the window is over the classes


@query(f"""SELECT doc_id, len({_W}) AS n_words, len(list_distinct({_W})) AS n_distinct FROM documents""")
def computed_once(spark, d):
    """What a text costs is computed once for each distinct text and joined back by its digest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    once = docs.groupBy("key").agg(F.first("text").alias("text")).select("key", words(F.col("text")).alias("w"))
    once = once.select("key", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))
    return docs.select("doc_id", "key").join(once, "key").select("doc_id", "n_words", "n_distinct")


@query(f"""WITH r AS (SELECT phone, CASE WHEN k % 3 = 0 THEN 'accepted' WHEN k % 3 = 1 THEN 'uncertain' ELSE 'reject' END AS status FROM {PHONE_EVENTS}) SELECT phone, count(CASE WHEN status = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN status = 'reject' THEN 1 END) AS reject, count(CASE WHEN status = 'uncertain' THEN 1 END) AS uncertain, count(CASE WHEN status = 'accepted' THEN 1 END) >= 50 AS enough FROM r GROUP BY 1""")
def manual_coverage(spark, d):
    """Statuses of annotations, read from their JSON, by phone, and whether enough are accepted."""
    k = F.get_json_object("props", "$.k").cast("long") % 3
    rows = table(spark, d, "events").select(F.col("event_type").alias("phone"), F.when(k == 0, "accepted").when(k == 1, "uncertain").otherwise("reject").alias("status"))
    per = rows.groupBy("phone").pivot("status", ["accepted", "reject", "uncertain"]).agg(F.count(F.lit(1))).na.fill(0)
    return per.withColumn("enough", F.col("accepted") >= 50)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS first_at FROM events GROUP BY 1""")
def day_partitions(spark, d):
    """Rows by UTC day, with the first time as ISO text."""
    iso = F.concat(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), iso.alias("first_at"))


@query(f"""SELECT id, round_even((start_ms % 100000 + end_ms % 100000) / 2.0, 0)::BIGINT AS middle_ms, round_even((start_ms % 100000) * 16000 / 1000.0, 0)::BIGINT AS first_sample, CASE WHEN isfinite(v) THEN least(greatest(v, 0.0), 1.0) END AS clamped FROM (SELECT *, CASE WHEN k % 17 = 0 THEN 'NaN'::DOUBLE WHEN k % 17 = 1 THEN 'Infinity'::DOUBLE ELSE duration_ms / 50 END AS v FROM {INSTANCES})""")
def clamped_values(spark, d):
    """Middles and samples rounded to even, values clamped, those that aren't finite dropped."""
    v = F.when(F.col("k") % 17 == 0, F.lit("NaN").cast("double")).when(F.col("k") % 17 == 1, F.lit("Infinity").cast("double")).otherwise(F.col("duration_ms") / 50)
    rows = instances(spark, d).withColumn("v", v).withColumn("a", F.col("start_ms") % 100_000).withColumn("b", F.col("end_ms") % 100_000)
    finite = ~F.isnan("v") & (F.abs("v") != F.lit("Infinity").cast("double"))
    return rows.select("id", F.bround((F.col("a") + F.col("b")) / 2.0).cast("long").alias("middle_ms"), F.bround(F.col("a") * 16_000 / 1000.0).cast("long").alias("first_sample"), F.when(finite, F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0))).alias("clamped"))


@query("""WITH e AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - 0.01) / 0.5 * (CASE WHEN i % 2 = 1 THEN 0.5 ELSE -0.25 END))) - 0.02 AS margin, list_filter([CASE WHEN label % 2 = 1 THEN 'no_detector' END, CASE WHEN abs(embedding[1]) > 0.15 THEN 'feature_out_of_range' END, CASE WHEN vec_id % 7 = 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS why FROM embeddings)
SELECT vec_id, CASE WHEN len(why) = 0 THEN round(margin, 6) END AS margin, array_to_string(why, ',') AS reasons, len(why) = 0 AND margin > 0 AS override FROM e""")
def gated_detector(spark, d):
    """A linear detector that says why it doesn't speak."""
    weights = F.array(*[F.lit(0.5 if i % 2 == 0 else -0.25) for i in range(64)])
    x = F.transform("embedding", lambda v: (v.cast("double") - 0.01) / 0.5)
    why = F.array_compact(F.array(F.when(F.col("label") % 2 == 1, "no_detector"), F.when(F.abs(F.col("embedding")[0]) > 0.15, "feature_out_of_range"), F.when(F.col("vec_id") % 7 == 0, "low_confidence")))
    e = table(spark, d, "embeddings").select("vec_id", (dot(x, weights) - 0.02).alias("m"), why.alias("why"))
    free = F.size("why") == 0
    return e.select("vec_id", F.when(free, F.round("m", 6)).alias("margin"), F.array_join("why", ",").alias("reasons"), (free & (F.col("m") > 0)).alias("override"))


@query(f"""SELECT segment, n_targets, n_extra, round(total / nullif(n_scored, 0) * (n_targets::DOUBLE / nullif(n_targets + n_extra, 0)) * 100, 6) AS score, round(quality / nullif(n_quality, 0), 6) AS mean_quality FROM (SELECT segment, count(CASE WHEN k <> 13 THEN 1 END) AS n_targets, count(CASE WHEN k = 13 THEN 1 END) AS n_extra, count(CASE WHEN k <> 13 THEN confidence END) AS n_scored,
CAST(sum(CAST(CASE WHEN k <> 13 THEN confidence END AS DECIMAL(20,6))) AS DOUBLE) AS total, CAST(sum(CAST(CASE WHEN k <> 13 AND status = 'correct' THEN duration_ms END AS DECIMAL(20,6))) AS DOUBLE) AS quality, count(CASE WHEN k <> 13 AND status = 'correct' THEN duration_ms END) AS n_quality FROM {INSTANCES} GROUP BY 1)""")
def segment_scores(spark, d):
    """The mean score of a segment's targets, less for extras, and the mean quality of its right ones."""
    extra = F.col("k") == 13
    scored, good = F.when(~extra, F.col("confidence")), F.when(~extra & (F.col("status") == "correct"), F.col("duration_ms"))
    total = lambda c: F.sum(c.cast("decimal(20,6)")).cast("double")
    per = instances(spark, d).groupBy("segment").agg(F.sum(F.when(extra, 0).otherwise(1)).alias("n_targets"), F.sum(F.when(extra, 1).otherwise(0)).alias("n_extra"), F.try_divide(total(scored), F.count(scored)).alias("m"), F.try_divide(total(good), F.count(good)).alias("q"))
    share = F.try_divide(F.col("n_targets").cast("double"), F.col("n_targets") + F.col("n_extra"))
    return per.select("segment", "n_targets", "n_extra", F.round(F.col("m") * share * 100, 6).alias("score"), F.round("q", 6).alias("mean_quality"))


@query(f"""WITH r AS (SELECT CASE WHEN expected IN {sql_list(P.VOWELS)} THEN 'vowel' ELSE 'consonant' END AS category, k % 4 = 0 AS meant, k < 40 AS gop, confidence >= 0.2 AS sure, duration_ms > 60 AS far FROM {INSTANCES}), l AS (SELECT category, meant, unnest(['gop', 'abstain', 'atlas', 'full']) AS layer, unnest([gop, gop AND coalesce(sure, false), far, (gop AND coalesce(sure, false)) OR far]) AS hit FROM r)
SELECT category, layer, round(count(CASE WHEN meant AND hit THEN 1 END)::DOUBLE / nullif(count(CASE WHEN meant THEN 1 END), 0), 6) AS detection, round(count(CASE WHEN NOT meant AND hit THEN 1 END)::DOUBLE / nullif(count(CASE WHEN NOT meant THEN 1 END), 0), 6) AS false_alarm FROM l GROUP BY 1, 2""")
def decision_layers(spark, d):
    """Detection and false alarms of four decision layers by category, in one aggregation."""
    sure, gop, far = F.coalesce(F.col("confidence") >= 0.2, F.lit(False)), F.col("k") < 40, F.col("duration_ms") > 60
    layers = {"gop": gop, "abstain": gop & sure, "atlas": far, "full": (gop & sure) | far}
    meant, n = F.col("k") % 4 == 0, lambda c: F.sum(F.when(c, 1).otherwise(0))
    category = F.when(F.col("expected").isin(P.VOWELS), "vowel").otherwise("consonant")
    share = lambda a, b: F.round(rate_or_null(a, F.nullif(b, F.lit(0))), 6)
    per = instances(spark, d).groupBy(category.alias("category")).agg(n(meant).alias("m"), n(~meant).alias("o"), *[n(meant & c).alias(f"m_{k}") for k, c in layers.items()], *[n(~meant & c).alias(f"o_{k}") for k, c in layers.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("layer"), share(F.col(f"m_{k}"), F.col("m")).alias("detection"), share(F.col(f"o_{k}"), F.col("o")).alias("false_alarm")) for k in layers])
    return per.select("category", F.inline(rows))
