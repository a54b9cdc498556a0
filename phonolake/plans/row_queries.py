"""Splits, samples, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import dot, sha1_mod100, split_of
from ..operators.aggregates import exact_quantiles, prefix_sums  # noqa: I001
from ..operators import joins as J
from ..operators import sampling as S
from ..operators import windows as W
from .adapters import OBSERVATIONS, PHONE_EVENTS, observations, phone_events, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _mod100(x: str) -> str:
    out = "0"
    for k in range(5):
        out = f"(({out}) * 96 + ('0x' || substr(sha1({x}), {8 * k + 1}, 8))::BIGINT) % 100"
    return out


@query(f"""WITH s AS (SELECT DISTINCT user_id AS speaker, {_mod100("CAST(user_id AS VARCHAR)")} AS bucket FROM events)
SELECT speaker, bucket, CASE WHEN bucket < 90 THEN 'train' WHEN bucket < 95 THEN 'dev' ELSE 'test' END AS split_90_5_5,
CASE WHEN bucket < 90 THEN 'train' ELSE 'test' END AS split_90_10, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'dev' ELSE 'test' END AS split_80_10_10 FROM s""")
def speaker_split(spark, d):
    speakers = phone_events(spark, d).select("speaker").distinct()
    key = F.col("speaker").cast("string")
    return speakers.select("speaker", sha1_mod100(key).alias("bucket"), *[split_of(key, s).alias(f"split_{s}") for s in ("90_5_5", "90_10", "80_10_10")])


@query(f"""SELECT phone, event_id, rank FROM (SELECT phone, event_id, row_number() OVER (PARTITION BY phone ORDER BY sha1('7|' || phone || '|' || event_id)) AS rank FROM {PHONE_EVENTS}) WHERE rank <= 25""")
def hash_ordered_cap(spark, d):
    e = phone_events(spark, d)
    return S.cap_per_group(e, "phone", S.hash_key(F.lit("7"), F.col("phone"), F.col("event_id")), 25).select("phone", "event_id", F.col("rank").cast("long"))


@query(f"SELECT event_id, speaker, phone FROM {PHONE_EVENTS} WHERE abs((event_id * 31 + speaker * 17) % 13) = 0")
def modulo_sample(spark, d):
    return S.modulo_sample(phone_events(spark, d), F.col("event_id"), F.col("speaker"), 13).select("event_id", "speaker", "phone")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha1('3|' || source || '|' || doc_id)) AS i FROM documents),
f AS (SELECT source, i, doc_id, n_chars AS total, true AS taken FROM r WHERE i = 1
UNION ALL SELECT r.source, r.i, r.doc_id, CASE WHEN f.total < 20000 AND f.total + r.n_chars <= 20000 THEN f.total + r.n_chars ELSE f.total END, f.total < 20000 AND f.total + r.n_chars <= 20000 FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
SELECT source, doc_id FROM f WHERE taken""")
def budget_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    docs = docs.withColumn("key", S.hash_key(F.lit("3"), F.col("source"), F.col("doc_id")))
    return S.budget_fill(docs, "source", "key", "n_chars", 20_000, ["doc_id"])


@query("""WITH RECURSIVE r AS (SELECT source, list(n_chars::BIGINT ORDER BY sha1(concat_ws('|', '3', source, doc_id)), n_chars, doc_id) AS cs, list(doc_id ORDER BY sha1(concat_ws('|', '3', source, doc_id)), n_chars, doc_id) AS ids FROM documents WHERE n_chars IS NOT NULL GROUP BY source),
f AS (SELECT 0::BIGINT AS total, list({'own': 0::BIGINT, 'named': CASE WHEN source IS NULL THEN 0 ELSE 1 END, 'turn': CASE WHEN source IS NULL THEN '' ELSE sha1('3|group|' || source) END, 'g': source, 'at': 0::BIGINT, 'cs': cs, 'ids': ids}) AS gs, NULL::VARCHAR AS source, NULL::BIGINT AS doc_id FROM r
UNION ALL SELECT total + coalesce(c, 0), list_concat(list_filter(gs, lambda x: x.g IS DISTINCT FROM b.g), CASE WHEN c IS NULL THEN [] ELSE [{'own': b.own + c, 'named': b.named, 'turn': b.turn, 'g': b.g, 'at': b.at + k, 'cs': b.cs, 'ids': b.ids}] END), CASE WHEN c IS NOT NULL THEN b.g END, CASE WHEN c IS NOT NULL THEN b.ids[b.at + k] END
FROM (SELECT *, CASE WHEN k > 0 THEN b.cs[b.at + k] END AS c FROM (SELECT *, list_position(list_transform(b.cs[b.at + 1:], lambda x: x <= 60000 - total), true)::BIGINT AS k FROM (SELECT total, gs, list_sort(gs)[1] AS b FROM f WHERE len(gs) > 0))))
SELECT source, doc_id FROM f WHERE doc_id IS NOT NULL""")
def balanced_round_robin(spark, d):
    """Compared with a plain fold in the tests."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    docs = docs.withColumn("key", S.hash_key(F.lit("3"), F.col("source"), F.col("doc_id")))
    return S.balanced_fill(docs, "source", "key", "n_chars", 60_000, ["doc_id"], seed=3)


@query("""WITH t AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS i, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 0 END AS q FROM documents),
k AS (SELECT *, CASE WHEN q IS NULL THEN 3 WHEN q <= 0 THEN 2 WHEN i <= q THEN 0 ELSE 1 END AS tier FROM t)
SELECT lang, source, doc_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tier, n_chars DESC, doc_id) AS rank FROM k WHERE i <= 12) WHERE rank <= 12""")
def quota_selection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    out = S.quota_select(docs, "lang", "source", {"src0": 3, "src1": 2, "src2": 0}, 12, [F.desc("n_chars"), F.asc("doc_id")])
    return out.select("lang", "source", "doc_id", "tier", F.col("rank").cast("long"))


@query("SELECT o_custkey, arg_max(o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END * 1000000000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_primary(spark, d):
    order = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.col("o_orderkey"))
    return S.latest(table(spark, d, "orders"), "o_custkey", "o_orderkey", order)


@query(f"""SELECT provider, phone, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY n DESC, phone) AS rank FROM (SELECT provider, phone, count(*) AS n FROM {PHONE_EVENTS} GROUP BY 1, 2)) WHERE rank <= 3""")
def topk_per_group(spark, d):
    per = phone_events(spark, d).groupBy("provider", "phone").agg(F.count(F.lit(1)).alias("n"))
    return S.top_per_group(per, ["provider"], [F.desc("n"), F.asc("phone")], 3).select("provider", "phone", "n", F.col("rank").cast("long"))


@query("SELECT turn, conv_id, length(text) AS n FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
def tail_newest(spark, d):
    return table(spark, d, "conversations").select("turn", "conv_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(20,6))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def inner_three_way(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(20,6)")).cast("double").alias("quantity"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END AS has_urgent FROM customer""")
def exists_flag(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.exists_flag(table(spark, d, "customer").select("c_custkey"), urgent, "c_custkey", "has_urgent")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti(spark, d):
    return J.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(trim(b.text)) = lower(trim(d.text)))""")
def leak_guard(spark, d):
    key = F.sha2(F.lower(F.trim("text")), 256)
    docs = table(spark, d, "documents").select("doc_id", key.alias("key"))
    return J.pending(docs, table(spark, d, "benchmark").select(key.alias("key")), ["key"]).select("doc_id")


@query("""WITH p AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 100000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(p.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NOT NULL THEN p.c_acctbal ELSE b.c_acctbal END AS c_acctbal,
CASE WHEN p.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN 'replaced' WHEN p.c_custkey IS NOT NULL THEN 'added' ELSE 'kept' END AS origin FROM (SELECT c_custkey, c_acctbal FROM customer) b FULL JOIN p ON p.c_custkey = b.c_custkey""")
def upsert_overlay(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    patch = base.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(base.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 100_000_000))
    return J.overlay(base, patch, "c_custkey")


def _spans(e, phone_condition):
    end = F.col("start_us") + F.greatest((F.col("duration_ms") * 60_000_000).cast("long"), F.lit(1))
    return e.where(phone_condition).select("speaker", "event_id", F.col("start_us").alias("s"), end.alias("e"))


_SPAN = f"(SELECT speaker, event_id, start_us AS s, start_us + greatest(CAST(trunc(duration_ms * 60000000) AS BIGINT), 1) AS e, phone FROM {PHONE_EVENTS})"


@query(f"""WITH a AS (SELECT * FROM {_SPAN} WHERE phone = 'view'), b AS (SELECT * FROM {_SPAN} WHERE phone <> 'view'),
h AS (SELECT a.event_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, b.event_id AS match_id, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.event_id) AS r FROM a JOIN b ON a.speaker = b.speaker AND a.s < b.e AND a.e > b.s)
SELECT a.speaker, a.event_id, a.s, a.e, h.overlap, h.match_id FROM a LEFT JOIN h ON h.event_id = a.event_id AND h.r = 1""")
def interval_overlap_best(spark, d):
    e = phone_events(spark, d)
    right = _spans(e, F.col("phone") != "view").withColumnRenamed("event_id", "match_id")
    return J.overlap_best(_spans(e, F.col("phone") == "view"), right, "speaker", ("s", "e"), ("s", "e"), "event_id", "match_id", 6 * 3600 * 1_000_000)


@query(f"""WITH p AS (SELECT * FROM {PHONE_EVENTS} WHERE phone = 'purchase'), o AS (SELECT * FROM {PHONE_EVENTS} WHERE phone <> 'purchase')
SELECT event_id, nearest, distance FROM (SELECT p.event_id, o.event_id AS nearest, abs(o.start_us - p.start_us) AS distance, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(o.start_us - p.start_us), o.start_us) AS r FROM p LEFT JOIN o ON o.speaker = p.speaker) WHERE r = 1""")
def nearest_interval(spark, d):
    e = phone_events(spark, d)
    return J.nearest_before_after(e, "speaker", "start_us", "event_id", F.col("phone") == "purchase", "event_id").select("event_id", "nearest", "distance")


@query(f"SELECT event_id, phone, lag(phone) OVER w AS prev_phone, lead(phone) OVER w AS next_phone FROM {PHONE_EVENTS} WINDOW w AS (PARTITION BY speaker ORDER BY start_us, event_id)")
def neighbour_context(spark, d):
    return W.neighbours(phone_events(spark, d), "speaker", ["start_us", "event_id"], "phone").select("event_id", "phone", "prev_phone", "next_phone")


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) AS group_n, sum(n_chars) OVER (PARTITION BY source)::BIGINT AS group_total FROM documents")
def group_totals(spark, d):
    return W.with_group_totals(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars").select("doc_id", "group_n", "group_total")


@query(f"""WITH a AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER w < 14400000000 THEN 0 ELSE 1 END AS f FROM {PHONE_EVENTS} WINDOW w AS (PARTITION BY speaker ORDER BY start_us, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY speaker ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM a) SELECT speaker, island, min(start_us) AS start, max(start_us) AS "end", count(*) AS n FROM b GROUP BY 1, 2""")
def gap_islands(spark, d):
    return W.islands(phone_events(spark, d), "speaker", "start_us", "event_id", F.lit(4 * 3600 * 1_000_000))


@query(f"""WITH a AS (SELECT *, CASE WHEN lag(phone) OVER w IS NOT DISTINCT FROM phone THEN 0 ELSE 1 END AS f FROM {PHONE_EVENTS} WINDOW w AS (PARTITION BY speaker ORDER BY start_us, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY speaker ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a)
SELECT speaker, run, min(phone) AS phone, count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) / count(duration_ms) AS mean_score FROM b GROUP BY 1, 2""")
def run_collapse(spark, d):
    return W.runs(phone_events(spark, d), "speaker", ["start_us", "event_id"], "phone", "duration_ms")


@query(f"""WITH a AS (SELECT speaker, start_us, event_id, duration_ms > 40 AS f FROM {PHONE_EVENTS}), b AS (SELECT *, CASE WHEN lag(f) OVER w IS NOT DISTINCT FROM f THEN 0 ELSE 1 END AS nw FROM a WINDOW w AS (PARTITION BY speaker ORDER BY start_us, event_id)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY speaker ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT speaker, max(n)::BIGINT AS longest FROM (SELECT speaker, run, sum(f::INT) AS n FROM c GROUP BY 1, 2) GROUP BY 1""")
def longest_run(spark, d):
    return W.longest_run(phone_events(spark, d), "speaker", ["start_us", "event_id"], F.col("duration_ms") > 40)


@query(f"""SELECT event_id, coalesce(floor((lag(e) OVER w + s) / 2.0), s)::BIGINT AS lo, coalesce(floor((e + lead(s) OVER w) / 2.0), e)::BIGINT AS hi FROM (SELECT event_id, speaker, start_us // 1000 AS s, start_us // 1000 + CAST(trunc(duration_ms) AS BIGINT) AS e FROM {PHONE_EVENTS}) WINDOW w AS (PARTITION BY speaker ORDER BY s, e)""")
def midpoint_bounds(spark, d):
    start = F.floor(F.col("start_us") / 1000)
    e = phone_events(spark, d).select("event_id", "speaker", start.alias("s"), (start + F.col("duration_ms").cast("long")).alias("e"))
    return W.midpoint_bounds(e, "speaker", "s", "e", W.STRETCH // 1000).select("event_id", "lo", "hi")


@query(f"""WITH a AS (SELECT speaker, event_id, duration_ms, k, min(duration_ms) OVER p AS dl, max(duration_ms) OVER p AS dh, min(k) OVER p AS kl, max(k) OVER p AS kh FROM {PHONE_EVENTS} WINDOW p AS (PARTITION BY speaker)),
b AS (SELECT speaker, event_id, round(CASE WHEN dh - dl >= 1e-9 THEN (coalesce(duration_ms, dl) - dl) / (dh - dl) ELSE 0 END + CASE WHEN kh - kl >= 1e-9 THEN (coalesce(k, kl) - kl)::DOUBLE / (kh - kl) ELSE 0 END, 9) AS s, (dh - dl >= 1e-9)::INT + (kh - kl >= 1e-9)::INT AS u FROM a),
c AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS nx FROM b WINDOW w AS (PARTITION BY speaker ORDER BY s DESC, event_id))
SELECT speaker, event_id AS peak, CASE WHEN coalesce(u = 0 OR s - nx < 1e-9, false) THEN 'low_confidence' ELSE 'ok' END AS verdict FROM c WHERE r = 1""")
def minmax_peak(spark, d):
    return W.peak(phone_events(spark, d), "speaker", "event_id", ["duration_ms", "k"])


@query(f"SELECT DISTINCT phone, duration_ms, cume_dist() OVER (PARTITION BY phone ORDER BY duration_ms) AS rank FROM {PHONE_EVENTS}")
def cume_rank(spark, d):
    return W.cume_rank(phone_events(spark, d), "phone", "duration_ms")


@query("SELECT user_id AS speaker, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS parts, count(DISTINCT event_type) AS n_parts FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def split_leaks(spark, d):
    return J.overlaps_between(phone_events(spark, d), "speaker", "phone")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT label, i, quantile_cont(v[i], 0.5) AS c, (quantile_cont(v[i], 0.75) - quantile_cont(v[i], 0.25)) / 1.349 AS s FROM e, range(1, 65) t(i) GROUP BY label, i)
SELECT e.vec_id, round(sum(pow((e.v[m.i] - m.c) / greatest(m.s, 1e-9), 2)), 6) AS distance FROM e JOIN m ON e.label = m.label GROUP BY e.vec_id""")
def diagonal_mahalanobis(spark, d):
    long = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    q = exact_quantiles(long, ["label", "dim"], "x", [0.25, 0.5, 0.75])
    model = q.select("label", "dim", F.col("q")[1].alias("c"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(1e-9)).alias("s"))
    z = F.pow((F.col("x") - F.col("c")) / F.col("s"), F.lit(2.0))
    return long.join(model, ["label", "dim"]).groupBy("vec_id").agg(F.round(F.sum(z), 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10) AS v FROM embeddings), m AS (SELECT *, list_max(v) AS mx FROM e)
SELECT vec_id, round(v[label + 1] - mx - ln(list_sum(list_transform(v, lambda x: exp(x - mx)))), 6) AS log_prob, round(1 / (1 + exp(-(v[label + 1] - list_max(list_transform(range(1, 65), lambda i: CASE WHEN i = label + 1 THEN -1e300 ELSE v[i] END)) + 1))), 6) AS gop FROM m""")
def log_softmax_gop(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 10)
    e = table(spark, d, "embeddings").select("vec_id", "label", v.alias("v")).withColumn("mx", F.array_max("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("mx")))
    own = F.element_at("v", F.col("label") + 1)
    rest = F.array_max(F.transform("v", lambda x, i: F.when(i == F.col("label"), F.lit(-1e300)).otherwise(x)))
    return e.select("vec_id", F.round(own - F.col("mx") - F.log(total), 6).alias("log_prob"), F.round(1 / (1 + F.exp(-(own - rest + 1))), 6).alias("gop"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (CASE WHEN i % 2 = 1 THEN 0.5 ELSE -0.25 END))) - 0.01, 6) AS margin FROM embeddings""")
def linear_detector(spark, d):
    weights = F.array(*[F.lit(0.5 if i % 2 == 0 else -0.25) for i in range(64)])
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), weights) - 0.01, 6).alias("margin"))


@query(f"""WITH s AS (SELECT phone, quantile_cont(duration_ms, 0.5) AS m, (quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25)) / 1.349 AS sc FROM {PHONE_EVENTS} GROUP BY phone), z AS (SELECT event_id, CASE WHEN sc > 0 THEN (duration_ms - m) / sc END AS z FROM {PHONE_EVENTS} JOIN s USING (phone))
SELECT event_id, CASE WHEN z IS NULL THEN NULL WHEN z <= -1.0 THEN 'short' WHEN z >= 1.0 THEN 'long' ELSE 'expected' END AS note, round(exp(-0.5 * pow(z / 1.0, 2)), 6) AS score FROM z""")
def length_cue(spark, d):
    e = phone_events(spark, d)
    stats = exact_quantiles(e, ["phone"], "duration_ms", [0.25, 0.5, 0.75]).select("phone", F.col("q")[1].alias("m"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("sc"))
    z = F.when(F.col("sc") > 0, (F.col("duration_ms") - F.col("m")) / F.col("sc"))
    out = e.join(stats, "phone").select("event_id", z.alias("z"))
    note = F.when(F.col("z").isNull(), None).when(F.col("z") <= -1.0, "short").when(F.col("z") >= 1.0, "long").otherwise("expected")
    return out.select("event_id", note.alias("note"), F.round(F.exp(-0.5 * F.pow(F.col("z"), F.lit(2.0))), 6).alias("score"))


@query(f"""SELECT lang, threshold FROM (SELECT lang, n_chars AS threshold, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM {OBSERVATIONS} WHERE quality = 0) WHERE r = least(floor(0.05 * n)::BIGINT + 1, n)""")
def fp_ceiling_threshold(spark, d):
    """The highest score above which at most 5 % of the negatives lie: their counts by score, summed from the top."""
    neg = observations(spark, d).where("quality = 0").groupBy("lang", F.col("n_chars").alias("threshold")).agg(F.count(F.lit(1)).alias("c"))
    up = prefix_sums(neg, ["lang"], "threshold", ["c"], descending=True)
    return up.where(F.col("c_to") >= F.least(F.floor(0.05 * F.col("c_all")) + 1, F.col("c_all"))).groupBy("lang").agg(F.max("threshold").alias("threshold"))
