"""Signal measures over the given vectors, read as samples or as tracks, and windows over phone instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phones as P
from ..functions import signals as G
from .adapters import INSTANCES, instances, table
from .rule_queries import _CLASS

Q, SQL = {}, {}
RATE = 1600


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_SPECTRUM = f"""WITH e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 63))) AS x FROM embeddings),
m AS (SELECT vec_id, list_transform(range(0, 33), lambda k: sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * i * k / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * i * k / 64))), 2))) AS a FROM e),
p AS (SELECT vec_id, a, list_sum(a) AS t, list_sum(list_transform(range(0, 33), lambda k: k * {RATE} / 64.0 * a[k + 1])) / list_sum(a) AS c FROM m),
v AS (SELECT *, sqrt(list_sum(list_transform(range(0, 33), lambda k: pow(k * {RATE} / 64.0 - c, 2) * a[k + 1])) / t) AS s FROM p)"""


@query(f"""{_SPECTRUM} SELECT vec_id, round(c, 4) AS centroid, round(s, 4) AS bandwidth, round(list_sum(list_transform(range(0, 33), lambda k: pow((k * {RATE} / 64.0 - c) / s, 3) * a[k + 1])) / t, 4) AS skew, round(list_sum(list_transform(range(0, 33), lambda k: pow((k * {RATE} / 64.0 - c) / s, 4) * a[k + 1])) / t - 3, 4) AS kurtosis,
round(list_sum(list_transform(range(0, 20), lambda k: a[k + 1])) / t, 4) AS low_ratio, round((ln(1 + a[1]) + ln(1 + a[2]) + ln(1 + a[3])) / 3, 4) AS c0 FROM v""")
def spectral_measures(spark, d):
    """Spectral moments, the share of low frequencies and the first cepstrum-like bin."""
    s = table(spark, d, "embeddings").select("vec_id", G.spectrum(F.col("embedding").cast("array<double>"), RATE).alias("s"))
    r = lambda c: F.round(f"s.{c}", 4).alias(c)
    return s.select("vec_id", r("centroid"), r("bandwidth"), r("skew"), r("kurtosis"), r("low_ratio"), F.round(F.col("s.cepstrum")[0], 4).alias("c0"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE - list_avg(list_transform(embedding, lambda w: w::DOUBLE))) AS x FROM embeddings), c AS (SELECT vec_id, list_transform(range(3, 26), lambda l: round(list_sum(list_transform(range(1, 65 - l), lambda i: x[i] * x[i + l])), 9)) AS c FROM e)
SELECT vec_id, round({RATE}.0 / (list_position(c, list_max(c)) + 2), 4) AS f0, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda v: pow(v::DOUBLE, 2))) / 64) + 1e-12), 4) AS intensity_db FROM c JOIN embeddings USING (vec_id)""")
def pitch_and_intensity(spark, d):
    """The period by autocorrelation, and loudness."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(G.spectrum(x, RATE)["f0"], 4).alias("f0"), F.round(G.intensity(x), 4).alias("intensity_db"))


_SAMPLES = """(SELECT vec_id // 10 AS utterance, list_transform(flatten(list(embedding ORDER BY vec_id)), lambda x: x::DOUBLE * CASE WHEN vec_id // 10 % 4 = 0 THEN 0.01 ELSE 1 END) AS x FROM (SELECT vec_id, CASE WHEN vec_id % 10 IN (0, 1, 8) THEN list_transform(embedding, lambda v: v * 0.01::FLOAT) ELSE embedding END AS embedding FROM embeddings) GROUP BY vec_id // 10)"""


def utterances(spark, d):
    """Ten vectors in id order as the samples of an utterance; the first two and the ninth are quiet, and so is every fourth utterance."""
    e = table(spark, d, "embeddings")
    quiet = F.transform("embedding", lambda v: v * F.lit(0.01).cast("float"))
    x = F.when((F.col("vec_id") % 10).isin(0, 1, 8), quiet).otherwise(F.col("embedding"))
    per = e.select("vec_id", F.floor(F.col("vec_id") / 10).alias("utterance"), x.alias("x")).groupBy("utterance").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda r: r["x"])).alias("x"))
    return per.select("utterance", F.transform("x", lambda v: v.cast("double") * F.when(F.col("utterance") % 4 == 0, 0.01).otherwise(1.0)).alias("x"))


@query(f"""WITH f AS (SELECT utterance, x, len(x) AS n, unnest(list_sort(list_distinct(range(0, len(x) - 31, 16) || [len(x) - 32]))) AS s FROM (SELECT * FROM {_SAMPLES.replace("vec_id // 10 % 4 = 0", "any_value(vec_id // 10) % 4 = 0")})),
r AS (SELECT utterance, n, s, sqrt(list_sum(list_transform(x[s + 1:s + 32], lambda v: v * v)) / 32) AS rms FROM f), t AS (SELECT utterance, greatest(quantile_cont(rms, 0.2) * 3, 0.01) AS lim FROM r GROUP BY 1),
h AS (SELECT r.utterance, any_value(n) AS n, min(CASE WHEN rms >= lim THEN s END) AS a, max(CASE WHEN rms >= lim THEN s END) AS b FROM r JOIN t USING (utterance) GROUP BY 1)
SELECT utterance, CASE WHEN a IS NULL THEN 0 ELSE greatest(round_even(a * 1000.0 / {RATE}, 0)::BIGINT - 40, 0) END AS start_ms, CASE WHEN a IS NULL THEN greatest(round_even(n * 1000.0 / {RATE}, 0)::BIGINT, 1) ELSE least(round_even(least(n, b + 32) * 1000.0 / {RATE}, 0)::BIGINT + 40, greatest(round_even(n * 1000.0 / {RATE}, 0)::BIGINT, 1)) END AS end_ms, CASE WHEN a IS NULL THEN 'no_speech_fallback' ELSE 'ok' END AS status FROM h""")
def speech_regions(spark, d):
    return utterances(spark, d).select("utterance", G.speech_region(F.col("x"), RATE).alias("r")).select("utterance", "r.*")


@query(f"""WITH u AS {_SAMPLES.replace("vec_id // 10 % 4 = 0", "any_value(vec_id // 10) % 4 = 0")}, g AS (SELECT utterance, len(x) * 1000.0 / {RATE} AS ms, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) * 32768 / 40 AS r FROM u)
SELECT CASE WHEN ms < 250 THEN 'too_short' WHEN r < 10 THEN 'silent' ELSE 'ok' END AS status, count(*) AS n FROM g GROUP BY 1""")
def quality_gates(spark, d):
    u = utterances(spark, d)
    return u.groupBy(G.quality_gate(F.size("x") * 1000.0 / RATE, G.rms(F.col("x")) * 32768 / 40).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS {_SAMPLES.replace("vec_id // 10 % 4 = 0", "any_value(vec_id // 10) % 4 = 0")}, f AS (SELECT utterance, list_transform(range(0, len(x) // 3), lambda i: round(20 * log10(sqrt(list_sum(list_transform(x[i * 3 + 1:i * 3 + 3], lambda v: v * v)) / 3) + 1e-9), 9)) AS db FROM u),
c AS (SELECT utterance, db, list_min(db[1:greatest(floor(len(db) * 0.8)::INTEGER, 1)]) AS fl FROM f), a AS (SELECT *, list_position(db, fl) - 1 AS p0, list_max(db) - fl AS depth FROM c),
b AS (SELECT *, CASE WHEN depth >= 9 THEN list_min(list_filter(range(0, len(db)), lambda i: i >= p0 AND db[i + 1] >= fl + 9)) END AS bu FROM a) SELECT utterance, round(p0 * 3 * 1000.0 / {RATE}, 4) AS closure_ms, round(bu * 3 * 1000.0 / {RATE}, 4) AS burst_ms, round(depth, 4) AS depth_db, CASE WHEN bu IS NOT NULL THEN round(least(1.0, depth / 30.0), 4) END AS confidence FROM b""")
def closure_bursts(spark, d):
    """Closures and bursts of utterances, in frames of 2 ms."""
    b = utterances(spark, d).select("utterance", G.closure_burst(F.col("x"), RATE).alias("b"))
    return b.select("utterance", *[F.round(f"b.{c}", 4).alias(c) for c in ("closure_ms", "burst_ms", "depth_db", "confidence")])


@query("""SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda i: (i - 31.5) * embedding[i + 1]::DOUBLE)) / (64 * (64 * 64 - 1) / 12.0 * 5), 8) AS slope, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE)), 5) AS d0, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * cos(pi() * (i + 0.5) * 3 / 64))), 5) AS d3 FROM embeddings""")
def track_shapes(spark, d):
    """Slopes and cosine coefficients of the vectors as tracks."""
    c = G.cosine_transform(F.col("embedding"), 4)
    return table(spark, d, "embeddings").select("vec_id", F.round(G.slope(F.col("embedding"), 5.0), 8).alias("slope"), F.round(c[0], 5).alias("d0"), F.round(c[3], 5).alias("d3"))


_TIMES = f"(SELECT id, {_CLASS} AS kind, start_ms % 100000 AS a, start_ms % 100000 + CAST(trunc(duration_ms) AS BIGINT) + 1 AS b, CASE WHEN k % 3 <> 0 THEN start_ms % 100000 + 3 END AS va, CASE WHEN k % 3 <> 0 THEN start_ms % 100000 + k END AS vb FROM {INSTANCES})"


@query(f"""WITH t AS {_TIMES}, m AS (SELECT *, coalesce(va IS NOT NULL AND vb > va AND least(b, vb) > greatest(a, va), false) AS v FROM t), l AS (SELECT *, CASE WHEN v THEN greatest(a, va) ELSE a END AS lo, CASE WHEN v THEN least(b, vb) ELSE b END AS hi FROM m),
h AS (SELECT *, greatest(least(80, (hi - lo) * 0.6) / 2, 0.5) AS half, greatest(least(80, b - a), 1) AS w, CASE kind WHEN 'stop' THEN 150 WHEN 'affricate' THEN 150 WHEN 'sonorant' THEN 80 WHEN 'fricative' THEN 60 ELSE 90 END AS cw FROM l),
n AS (SELECT *, least(greatest(a, round_even((a + b) / 2.0, 0)::BIGINT - w // 2) + w, b) AS nr, least(100000, greatest(least(b, 100000), (a + least(b, 100000)) // 2 + cw // 2)) AS mid FROM h)
SELECT id, round(greatest(lo, (lo + hi) / 2.0 - half)::DOUBLE, 4) AS measure_start, round(least(hi, (lo + hi) / 2.0 + half)::DOUBLE, 4) AS measure_end, (CASE WHEN v THEN greatest(a, va) ELSE nr - w END)::BIGINT AS nucleus_start, (CASE WHEN v THEN least(b, vb) ELSE nr END)::BIGINT AS nucleus_end,
(CASE WHEN kind IN ('stop', 'affricate') THEN greatest(a - 30, 0) WHEN kind = 'sonorant' THEN a ELSE greatest(mid - cw, 0) END)::BIGINT AS class_start, (CASE WHEN kind IN ('stop', 'affricate', 'sonorant') THEN least(100000, greatest(least(b, 100000), a + cw)) ELSE mid END)::BIGINT AS class_end FROM n""")
def measurement_windows(spark, d):
    """The windows that a phone is measured in."""
    start = F.col("start_ms") % 100_000
    voiced = F.col("k") % 3 != 0
    t = instances(spark, d).select("id", P.phone_class(F.col("expected")).alias("kind"), start.alias("a"), (start + F.col("duration_ms").cast("long") + 1).alias("b"), F.when(voiced, start + 3).alias("va"), F.when(voiced, start + F.col("k")).alias("vb"))
    a, b, va, vb = (F.col(c) for c in ("a", "b", "va", "vb"))
    out = t.select("id", G.measurement_window(a, b, va, vb).alias("m"), G.nucleus_window(a, b, va, vb).alias("n"), G.class_window(F.col("kind"), a, b, F.lit(100_000)).alias("c"))
    long = lambda c: F.col(c).cast("long")
    return out.select("id", F.round(F.col("m.start_ms").cast("double"), 4).alias("measure_start"), F.round(F.col("m.end_ms").cast("double"), 4).alias("measure_end"), long("n.start_ms").alias("nucleus_start"), long("n.end_ms").alias("nucleus_end"), long("c.start_ms").alias("class_start"), long("c.end_ms").alias("class_end"))


@query(f"""WITH i AS (SELECT id, {_CLASS} AS class, id % (SELECT count(*) FROM embeddings) AS vec_id FROM {INSTANCES}), {_SPECTRUM.replace("WITH ", "")}, t AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: (i - 31.5) * embedding[i + 1]::DOUBLE)) / (64 * (64 * 64 - 1) / 12.0 * 5) AS slope, sqrt(list_sum(list_transform(embedding, lambda v: pow(v::DOUBLE, 2))) / 64) AS rms FROM embeddings)
SELECT id, class, round(rms, 5) AS rms, CASE WHEN class IN ('stop', 'affricate', 'fricative') THEN round(c, 4) END AS centroid, CASE WHEN class = 'fricative' THEN round(s, 4) END AS bandwidth, CASE WHEN class IN ('vowel', 'sonorant') THEN round(slope, 8) END AS slope, CASE WHEN class = 'sonorant' THEN round(list_sum(list_transform(range(0, 20), lambda k: a[k + 1])) / v.t, 4) END AS low_ratio FROM i JOIN v USING (vec_id) JOIN t USING (vec_id)""")
def extracted_features(spark, d):
    """What is measured of an instance depends on its class; the rest is null. Each stretch of samples is measured once."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))  # one row
    e = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    m = e.select("vec_id", G.rms(F.col("x")).alias("rms"), G.slope(F.col("x"), 5.0).alias("slope"), G.spectrum(F.col("x"), RATE).alias("s"))
    rows = instances(spark, d).select("id", P.phone_class(F.col("expected")).alias("class")).join(F.broadcast(n))
    rows = rows.withColumn("vec_id", F.col("id") % F.col("n")).join(m, "vec_id")
    of = lambda value, *classes: F.when(F.col("class").isin(*classes), value)
    return rows.select("id", "class", F.round("rms", 5).alias("rms"), of(F.round("s.centroid", 4), "stop", "affricate", "fricative").alias("centroid"), of(F.round("s.bandwidth", 4), "fricative").alias("bandwidth"), of(F.round("slope", 8), "vowel", "sonorant").alias("slope"), of(F.round("s.low_ratio", 4), "sonorant").alias("low_ratio"))
