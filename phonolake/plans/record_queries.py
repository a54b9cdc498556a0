"""Keyed rows, orders, supplements, names and keys taken from texts and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.exprs import sha1_mod100, split_of
from ..operators import joins as J
from ..operators import records as R
from ..operators import sampling as S
from ..operators import windows as W
from ..sources import files
from .adapters import INSTANCES, PHONE_EVENTS, instances, phone_events, table
from .row_queries import _SPAN, _mod100, _spans

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT segment, arg_min(id, start_ms * 1000000 + id) AS id, arg_min(expected, start_ms * 1000000 + id) AS expected FROM {INSTANCES} GROUP BY 1""")
def first_instances(spark, d):
    return R.first_per_key(instances(spark, d), "segment", ["start_ms", "id"], ["id", "expected"])


@query("""SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def next_attempts(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.next_number(orders, ["c_custkey"], "o_orderkey", table(spark, d, "customer").select("c_custkey"))


@query("""SELECT conv_id, count(*) AS n_left, max(turn) AS last_number FROM conversations WHERE NOT (turn = 2 AND conv_id % 3 = 0) GROUP BY 1""")
def deleted_attempts(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    return R.without_attempt(turns, turns.where("turn = 2 AND conv_id % 3 = 0"), ["conv_id"], "turn")


@query("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier""")
def replaced_rows(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return R.replace_rows(base, base.where("s_suppkey % 7 = 0").select("s_suppkey", F.round(F.col("s_acctbal") * 2, 2).alias("s_acctbal")), ["s_suppkey"], "s_acctbal")


@query("""WITH s AS (SELECT l_suppkey, l_partkey, l_linenumber, l_quantity, l_orderkey FROM lineitem), k AS (SELECT l_suppkey, l_partkey, count(*) AS n, min(l_orderkey) AS v FROM s GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey, l_linenumber, count(*) AS nx, min(l_orderkey) AS vx FROM s GROUP BY 1, 2, 3),
p AS (SELECT p_partkey AS l_partkey, p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS l_suppkey, p_size % 7 + 1 AS line FROM part)
SELECT p.l_partkey, p.l_suppkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' WHEN nx = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN v WHEN n > 1 AND nx = 1 THEN vx END AS found FROM p LEFT JOIN k USING (l_suppkey, l_partkey) LEFT JOIN b ON b.l_suppkey = p.l_suppkey AND b.l_partkey = p.l_partkey AND b.l_linenumber = p.line""")
def source_lookup(spark, d):
    """Rows looked up by a key that may name none, one or several source rows."""
    top = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("top"))  # one row
    p = table(spark, d, "part").join(F.broadcast(top)).select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % F.col("top") + 1).alias("l_suppkey"), (F.col("p_size") % 7 + 1).alias("line"))
    return R.lookup(p, table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], ("line", "l_linenumber"), "l_orderkey").select("l_partkey", "l_suppkey", "outcome", "found")


_BUCKET = _mod100("CAST(user_id AS VARCHAR)")


@query(f"""SELECT user_id AS speaker, {_BUCKET} AS bucket, count(*) AS n FROM events WHERE {_BUCKET} <= 19 OR {_BUCKET} = 95 OR {_BUCKET} BETWEEN 40 AND 59 GROUP BY 1, 2""")
def bucket_subset(spark, d):
    """The rows of speakers whose buckets a text names."""
    bucket = sha1_mod100(F.col("speaker").cast("string"))
    return phone_events(spark, d).withColumn("bucket", bucket).where(F.col("bucket").isin(R.bucket_set("0..19, 95,40..59"))).groupBy("speaker", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT id, expected, segment % 10 AS p, sha1('11|' || id) AS k FROM {INSTANCES}), b AS (SELECT id, expected, k FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) AS r FROM s) WHERE r <= 10),
m AS (SELECT id, expected FROM s WHERE expected IN ('ʒ', 'œː', 'yː') AND id NOT IN (SELECT id FROM b) ORDER BY k LIMIT 15) SELECT id, expected, 'base' AS role FROM b UNION ALL SELECT id, expected, 'supplement' FROM m""")
def rare_supplement(spark, d):
    """A sample of each part in hash order, and rare phones that it lacks."""
    pool = instances(spark, d).select("id", "expected", (F.col("segment") % 10).alias("p"), S.hash_key(F.lit("11"), F.col("id")).alias("key"))
    base = S.cap_per_group(pool, "p", F.col("key"), 10).drop("rank")
    return R.supplement(base, pool, "id", F.col("expected").isin("ʒ", "œː", "yː"), F.col("key"), 15).select("id", "expected", "role")


@query(f"""SELECT split, id, r AS rank FROM (SELECT id, CASE WHEN segment % 10 < 8 THEN 'train' WHEN segment % 10 = 8 THEN 'dev' ELSE 'test' END AS split, row_number() OVER (PARTITION BY CASE WHEN segment % 10 < 8 THEN 'train' WHEN segment % 10 = 8 THEN 'dev' ELSE 'test' END ORDER BY id) AS r FROM {INSTANCES}) WHERE r <= 50""")
def first_per_split(spark, d):
    part = F.col("segment") % 10
    rows = instances(spark, d).select("id", F.when(part < 8, "train").when(part == 8, "dev").otherwise("test").alias("split"))
    return S.top_per_group(rows, ["split"], [F.asc("id")], 50).select("split", "id", F.col("rank").cast("long"))


@query(f"""SELECT segment, start_ms, end_ms, expected, id FROM (SELECT *, row_number() OVER (PARTITION BY segment, start_ms // 3600000, expected ORDER BY id) AS r FROM {INSTANCES}) WHERE r = 1""")
def unique_training_rows(spark, d):
    rows = instances(spark, d).withColumn("hour", F.floor(F.col("start_ms") / 3_600_000))
    return R.training_rows(rows, ["segment", "hour", "expected"], ["id"]).select("segment", "start_ms", "end_ms", "expected", "id")


@query(f"""SELECT id, provider, CASE provider WHEN 'p2' THEN 0 WHEN 'p0' THEN 1 ELSE 99 END AS place FROM {INSTANCES} ORDER BY place, label, id""")
def manifest_order(spark, d):
    """Rows in the order of providers, then of labels, then of ids as numbers."""
    place = F.coalesce(F.try_element_at(F.create_map(F.lit("p2"), F.lit(0), F.lit("p0"), F.lit(1)), F.col("provider")), F.lit(99))
    rows = instances(spark, d).select("id", "provider", place.alias("place"), "label", F.col("id").cast("string").alias("t"))
    return rows.orderBy("place", "label", F.try_to_number(F.col("t"), F.lit("999999999999999")), "t").select("id", "provider", "place")


@query(f"""WITH a AS (SELECT *, event_id % 2 = 0 AS prim FROM {_SPAN} WHERE phone = 'view'), b AS (SELECT *, event_id % 3 = 0 AS prim FROM {_SPAN} WHERE phone <> 'view'),
h AS (SELECT a.event_id, b.event_id AS match_id, b.prim AS is_primary, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, row_number() OVER (PARTITION BY a.event_id ORDER BY b.prim DESC, least(a.e, b.e) - greatest(a.s, b.s) DESC, b.event_id) AS r FROM a JOIN b ON a.speaker = b.speaker AND a.s < b.e AND a.e > b.s)
SELECT a.event_id, match_id, is_primary, overlap FROM a LEFT JOIN h ON h.event_id = a.event_id AND r = 1""")
def overlap_primary(spark, d):
    """The best overlapping interval, a primary one before any other, then the longest overlap."""
    e = phone_events(spark, d)
    left = _spans(e, F.col("phone") == "view")
    right = _spans(e, F.col("phone") != "view").withColumn("is_primary", F.col("event_id") % 3 == 0).withColumnRenamed("event_id", "match_id")
    return J.overlap_first(left, right, "speaker", "event_id", "match_id", "is_primary", 6 * 3600 * 1_000_000)


@query(f"""WITH p AS (SELECT event_id, speaker, start_us AS t FROM {PHONE_EVENTS} WHERE phone = 'purchase'), b AS (SELECT * FROM {_SPAN} WHERE phone <> 'purchase'),
c AS (SELECT p.event_id, b.event_id AS match_id, b.s <= p.t AND p.t < b.e AS inside, abs((b.s + b.e) // 2 - p.t) AS distance FROM p JOIN b USING (speaker))
SELECT p.event_id, c.match_id, c.inside, c.distance FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY inside DESC, distance, match_id) AS r FROM c) c ON c.event_id = p.event_id AND r = 1""")
def nearest_containing(spark, d):
    """The interval that contains a point, the nearest centre among several; without one the nearest centre of all."""
    e = phone_events(spark, d)
    points = e.where("phone = 'purchase'").select("event_id", "speaker", F.col("start_us").alias("t"))
    return J.nearest_containing(points, _spans(e, F.col("phone") != "purchase").withColumnRenamed("event_id", "match_id"), "speaker", "event_id", "match_id", 6 * 3600 * 1_000_000)


@query(f"""WITH a AS (SELECT speaker, start_us, event_id, duration_ms > 40 AS f FROM {PHONE_EVENTS}), b AS (SELECT *, CASE WHEN lag(f) OVER w IS NOT DISTINCT FROM f THEN 0 ELSE 1 END AS nw FROM a WINDOW w AS (PARTITION BY speaker ORDER BY start_us, event_id)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY speaker ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b), g AS (SELECT speaker, run, count(*) AS n, min(start_us) AS s, max(start_us) AS e FROM c WHERE f GROUP BY 1, 2)
SELECT speaker, n, s AS start_us, e AS end_us FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, s) AS r FROM g) WHERE r = 1""")
def longest_interval(spark, d):
    """Where the longest run of long events lies; speakers without one are left out."""
    return W.longest_interval(phone_events(spark, d), "speaker", ["start_us", "event_id"], F.col("duration_ms") > 40, "start_us")


@query("SELECT doc_id, nfc_normalize(regexp_replace(substr(text, 1, length(text)), '^[[:punct:]\\s]+|[[:punct:]\\s]+$', '', 'g')) AS clean FROM documents WHERE text IS NOT NULL")
def nfc_texts(spark, d):
    """Texts in composed form, without punctuation and white space around them."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", N.nfc(N.bare(F.col("text"))).alias("clean"))


@query("""SELECT word, lower(translate(regexp_replace(word, '[^\\p{L}\\p{N}_\\s''’]', '', 'g'), 'Iİ', 'ıi')) AS plain, replace(lower(translate(regexp_replace(word, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'), 'Iİ', 'ıi')), '''', '') AS edged FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''""")
def normalized_words(spark, d):
    """Two normal forms of every word."""
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct().where(F.col("word") != "")
    return w.select("word", N.plain_word(F.col("word")).alias("plain"), N.edged_word(F.col("word")).alias("edged"))


@query(r"""SELECT page_id, url, list_filter(string_split(url, '/'), lambda p: p <> '')[2] AS provider, coalesce(list_filter(string_split(url, '/'), lambda p: p <> '')[3], 'none') AS group_key, regexp_extract(url, '(\d+)(?:\D*)$', 1) AS number, regexp_matches(coalesce(list_filter(string_split(url, '/'), lambda p: p <> '')[3], ''), '^[A-Za-z0-9._-]+$') AND coalesce(list_filter(string_split(url, '/'), lambda p: p <> '')[3], '') NOT IN ('.', '..') AS safe FROM pages""")
def path_keys(spark, d):
    """Provider, group and number from the parts of a path, and whether the group may name a file."""
    parts = N.path_parts(F.col("url"))
    group = F.get(parts, F.lit(2))
    return table(spark, d, "pages").select("page_id", "url", F.get(parts, F.lit(1)).alias("provider"), F.coalesce(group, F.lit("none")).alias("group_key"), N.last_number(F.col("url")).alias("number"), N.safe_component(F.coalesce(group, F.lit(""))).alias("safe"))


_SHORT = "substr(sha1({0}), 1, 12)"


@query(f"""WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'common_voice' WHEN 1 THEN 'issai_tsc' WHEN 2 THEN 'audiobooks' WHEN 3 THEN 'podcasts' WHEN 4 THEN 'youtube' ELSE 'else' END AS provider, 'seg_' || lang || '_' || doc_id AS segment, 'root/' || source || '/file.wav' AS path, CASE WHEN doc_id % 5 = 0 THEN lang END AS client, CASE WHEN doc_id % 4 = 0 THEN 'train' WHEN doc_id % 4 = 1 THEN source ELSE '' END AS folder FROM documents)
SELECT doc_id, provider, CASE provider WHEN 'common_voice' THEN coalesce(client, 'common_voice_missing_' || {_SHORT.format("segment")}) WHEN 'issai_tsc' THEN 'issai_' || CASE WHEN folder IN ('train', 'dev', 'test') THEN folder ELSE split_part(segment, '_', 2) END WHEN 'audiobooks' THEN 'audiobook_' || {_SHORT.format("coalesce(nullif(folder, ''), split_part(path, '/', 2))")}
WHEN 'podcasts' THEN 'podcast_' || {_SHORT.format("coalesce(nullif(folder, ''), split_part(path, '/', 2))")} WHEN 'youtube' THEN 'youtube_' || {_SHORT.format("coalesce(nullif(folder, ''), split_part(path, '/', 2))")} ELSE 'legacy_unknown_' || {_SHORT.format("segment")} END AS speaker_id,
CASE provider WHEN 'common_voice' THEN CASE WHEN client IS NULL THEN 'missing_cv_client_id' ELSE 'validated.tsv.client_id' END WHEN 'issai_tsc' THEN 'issai_split_fallback' WHEN 'audiobooks' THEN 'book_folder' WHEN 'podcasts' THEN 'podcast_name' WHEN 'youtube' THEN 'yt_channel' ELSE 'unknown_provider' END AS speaker_source FROM r""")
def speaker_ids(spark, d):
    """Speaker ids and where they come from, by the rule of each provider."""
    n = F.col("doc_id")
    provider = F.element_at(F.array(*map(F.lit, ["common_voice", "issai_tsc", "audiobooks", "podcasts", "youtube", "else"])), (n % 6 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", provider.alias("provider"), F.concat(F.lit("seg_"), "lang", F.lit("_"), n.cast("string")).alias("segment"), F.concat(F.lit("root/"), "source", F.lit("/file.wav")).alias("path"), F.when(n % 5 == 0, F.col("lang")).alias("client"), F.when(n % 4 == 0, "train").when(n % 4 == 1, F.col("source")).otherwise("").alias("folder"))
    return docs.select("doc_id", "provider", N.speaker_of(*[F.col(c) for c in ("provider", "segment", "path", "client", "folder")]).alias("s")).select("doc_id", "provider", "s.*")


_FILLED = f"""(SELECT segment, (start_ms - min(start_ms) OVER (PARTITION BY segment)) // 1000 AS s, (start_ms - min(start_ms) OVER (PARTITION BY segment)) // 1000 + CAST(trunc(duration_ms * 300) AS BIGINT) AS e, expected || '|uncertain' AS l FROM {INSTANCES})"""


@query(f"""WITH r AS (SELECT *, max(s) OVER (PARTITION BY segment) + 5000 AS d FROM {_FILLED}), a AS (SELECT segment, d, s, e, l, greatest(s, 0) AS a, least(e, d) AS b FROM r),
c AS (SELECT *, coalesce(last_value(CASE WHEN b > a THEN b END IGNORE NULLS) OVER (PARTITION BY segment ORDER BY s, e, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, lead(1) OVER (PARTITION BY segment ORDER BY s, e, l) IS NULL AS fin FROM a),
p AS (SELECT segment, s, e, l, 0 AS k, c AS x, a AS y, '' AS t FROM c WHERE a > c UNION ALL SELECT segment, s, e, l, 1, a, b, l FROM c WHERE b > a UNION ALL SELECT segment, s, e, l, 2, CASE WHEN b > a THEN b ELSE c END, d, '' FROM c WHERE fin AND CASE WHEN b > a THEN b ELSE c END < d)
SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY s, e, l, k)::INTEGER AS i, x AS start_ms, y AS end_ms, t AS label FROM p""")
def gapless_tiers(spark, d):
    """The instances of a segment as a tier without gaps, as it goes into a TextGrid (its text is tested)."""
    w = Window.partitionBy("segment")
    rows = instances(spark, d)
    start = F.floor((F.col("start_ms") - F.min("start_ms").over(w)) / 1000)
    rows = rows.select("segment", start.alias("s"), (start + (F.col("duration_ms") * 300).cast("long")).alias("e"), F.concat("expected", F.lit("|uncertain")).alias("l"))
    rows = rows.withColumn("d", F.max("s").over(w) + 5000)
    return files.filled_intervals(rows, "segment", "s", "e", "l", "d")


@query("""SELECT role, coalesce(e, 'none') AS error, count(*) AS n, sum(v)::VARCHAR AS total FROM (SELECT role, try_cast(x AS BIGINT) AS v, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN x = '' THEN 'no_number' WHEN try_cast(x AS BIGINT) IS NULL THEN 'overflow' END AS e FROM (SELECT role, text, regexp_extract(text || repeat('9', CASE WHEN turn % 5 = 0 THEN 12 ELSE 0 END), '[0-9]+') AS x FROM conversations)) GROUP BY 1, 2""")
def isolated_errors(spark, d):
    """Numbers read from texts, all their digits; what fails, one that is too large included, is counted by reason and stops nothing.
    Every fifth turn has a dozen nines appended, so that some are."""
    text = F.col("text")
    digits = F.regexp_extract(F.concat(text, F.when(F.col("turn") % 5 == 0, "9" * 12).otherwise("")), "([0-9]+)", 1)
    number = digits.try_cast("long")
    why = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(digits == "", "no_number").otherwise("overflow")
    rows = table(spark, d, "conversations").select("role", files.isolated(number, number.isNotNull() & (F.trim(text) != ""), why).alias("x"))
    total = F.sum(F.col("x.value").cast("decimal(38,0)")).cast("string")
    return rows.groupBy("role", F.coalesce("x.error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query("""SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0 GROUP BY 1, 2""")
def insert_or_ignore(spark, d):
    """Rows appended but those whose key is there already, or comes twice: of the appended ones (some of them twice) a third is new."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    there, more = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 = 0")
    return J.insert_or_ignore(there, more.unionByName(docs.where("doc_id % 8 = 0")), ["doc_id"]).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT DISTINCT user_id AS speaker, {_BUCKET} AS b FROM events), p AS (SELECT speaker, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'dev' ELSE 'test' END AS a, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS c FROM s)
SELECT a, c, count(*) AS n_speakers FROM p GROUP BY 1, 2""")
def split_intersections(spark, d):
    """Speakers that two schemes put into each pair of splits; within a scheme no speaker is in two."""
    speakers = phone_events(spark, d).select("speaker").distinct()
    key = F.col("speaker").cast("string")
    return speakers.groupBy(split_of(key, "90_5_5").alias("a"), split_of(key, "80_10_10").alias("c")).agg(F.count(F.lit(1)).alias("n_speakers"))
