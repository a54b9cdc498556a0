"""Formants, voicing, onsets, frication, voiced edges, resampling and frame decoding over the given vectors, read as samples or as scores."""

from __future__ import annotations

from math import exp, gcd, pi

from pyspark.sql import functions as F

from ..functions import tracks as T
from ..streaming import voice
from .adapters import PHONE_EVENTS, phone_events, table

Q, SQL = {}, {}
RATE = 1600


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def samples(spark, d):
    """Ten vectors in id order as the samples of an utterance: the first two and the ninth are quiet, and the first sixteen values
    of the fourth to the eighth come four times, so that these are voiced."""
    e = table(spark, d, "embeddings")
    x = F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 10
    again = F.flatten(F.array_repeat(F.slice(x, 1, 16), 4))
    own = F.when(k.isin(0, 1, 8), F.transform(x, lambda v: v * 0.01)).when(k.between(3, 7), again).otherwise(x)
    per = e.select("vec_id", F.floor(F.col("vec_id") / 10).alias("utterance"), own.alias("x")).groupBy("utterance")
    return per.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda r: r["x"])).alias("x"))


SAMPLES = """(SELECT vec_id // 10 AS utterance, flatten(list(x ORDER BY vec_id)) AS x FROM (SELECT vec_id, CASE WHEN vec_id % 10 IN (0, 1, 8) THEN list_transform(embedding, lambda v: v::DOUBLE * 0.01) WHEN vec_id % 10 BETWEEN 3 AND 7 THEN list_transform(range(0, 64), lambda i: embedding[i % 16 + 1]::DOUBLE) ELSE list_transform(embedding, lambda v: v::DOUBLE) END AS x FROM embeddings) GROUP BY 1)"""


def _burg_sql(source: str, keys: str, order: int) -> str:
    """Common table expressions b0 to b{order}: the coefficients a and the errors f and g after as many steps."""
    out = [f"b0 AS MATERIALIZED (SELECT {keys}, []::DOUBLE[] AS a, x[2:] AS f, x[:-2] AS g FROM {source})"]
    for i in range(order):
        k = "CASE WHEN list_sum(list_transform(range(1, len(f) + 1), lambda i: f[i] * f[i] + g[i] * g[i])) > 0 THEN -2 * list_sum(list_transform(range(1, len(f) + 1), lambda i: f[i] * g[i])) / list_sum(list_transform(range(1, len(f) + 1), lambda i: f[i] * f[i] + g[i] * g[i])) ELSE 0.0 END"
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT *, {k} AS k FROM b{i})")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT {keys}, list_transform(range(1, {i + 1}), lambda i: a[i] + k * a[{i + 1} - i]) || [k] AS a, list_transform(range(2, len(f) + 1), lambda i: f[i] + k * g[i]) AS f, list_transform(range(1, len(f)), lambda i: g[i] + k * f[i]) AS g FROM k{i + 1})")
    return ",\n".join(out)


@query(f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
{_burg_sql("x", "vec_id", 6)} SELECT vec_id, i::INTEGER - 1 AS i, round(a[i], 6) AS a FROM b6, range(1, 7) t(i)""")
def burg_models(spark, d):
    """All-pole models of the vectors."""
    a = T.burg_coefficients(F.col("embedding").cast("array<double>"), 6)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(a).alias("i", "a")).select("vec_id", "i", F.round("a", 6).alias("a"))


@query(f"""WITH u AS {SAMPLES}, e AS (SELECT utterance, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN x[1] ELSE x[i] - {exp(-2 * pi * 50 / RATE)!r} * x[i - 1] END) AS e FROM u),
w AS (SELECT utterance, j, list_transform(range(0, 80), lambda i: e[j * 12 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 79))) AS x FROM (SELECT *, unnest(range(0, (len(e) - 80) // 12 + 1)) AS j FROM e)),
{_burg_sql("w", "utterance, j", 2)}, r AS (SELECT utterance, j, CASE WHEN a[1] * a[1] < 4 * a[2] THEN acos(-a[1] / (2 * sqrt(a[2]))) * {RATE} / (2 * pi()) END AS hz, -ln(sqrt(a[2])) * {RATE} / pi() AS width FROM b2)
SELECT utterance, round((j * 12 + 40) * 1000.0 / {RATE}, 4)::DOUBLE AS t_ms, round(CASE WHEN hz > 50 AND hz < {RATE // 2 - 50} THEN hz END, 5) AS hz, round(CASE WHEN hz > 50 AND hz < {RATE // 2 - 50} THEN width END, 5) AS width FROM r""")
def formant_tracks(spark, d):
    """One resonance over time (order two, whose pole has a closed form; more are tested against plain numpy and against known resonances)."""
    track = T.formant_track(F.col("x"), RATE, n=1, order=2)
    rows = samples(spark, d).select("utterance", F.explode(track).alias("f"))
    return rows.select("utterance", F.round("f.t_ms", 4).alias("t_ms"), F.round(F.col("f.hz")[0], 5).alias("hz"), F.round(F.col("f.width")[0], 5).alias("width"))


_VOICING = f"""f AS (SELECT utterance, j, x[j * 16 + 1:j * 16 + 64] AS x FROM (SELECT *, unnest(range(0, (len(x) - 64) // 16 + 1)) AS j FROM u)),
l AS (SELECT utterance, j, x, unnest(range(2, 22)) AS lag FROM f), c AS (SELECT utterance, j, list_sum(list_transform(range(1, 65 - lag), lambda i: x[i] * x[i + lag])) AS s, sqrt(list_sum(list_transform(range(1, 65 - lag), lambda i: x[i] * x[i])) * list_sum(list_transform(range(1, 65 - lag), lambda i: x[i + lag] * x[i + lag]))) AS p FROM l),
s AS (SELECT utterance, j, round(greatest(max(CASE WHEN p > 1e-8 THEN s / p ELSE 0 END), 0), 9) AS strength FROM c GROUP BY 1, 2),
v AS (SELECT *, coalesce(last_value(CASE WHEN strength >= 0.5 THEN true WHEN strength < 0.35 THEN false END IGNORE NULLS) OVER (PARTITION BY utterance ORDER BY j), false) AS voiced FROM s)"""


@query(f"WITH u AS {SAMPLES}, {_VOICING} SELECT utterance, (j * 10)::DOUBLE AS t_ms, round(strength, 6) AS strength, voiced FROM v")
def voicing_tracks(spark, d):
    rows = samples(spark, d).select("utterance", F.explode(T.voicing_track(F.col("x"), RATE)).alias("f"))
    return rows.select("utterance", "f.t_ms", F.round("f.strength", 6).alias("strength"), "f.voiced")


@query(f"""WITH u AS {SAMPLES}, {_VOICING}, o AS (SELECT utterance, min(j * 10)::DOUBLE AS voicing_ms FROM v WHERE voiced GROUP BY 1),
b AS (SELECT utterance, list_transform(range(0, len(x) // 3), lambda i: sqrt(list_sum(list_transform(x[i * 3 + 1:i * 3 + 3], lambda v: v * v)) / 3)) AS r FROM u),
p AS (SELECT utterance, CASE WHEN list_max(r) >= 1e-4 THEN list_min(list_filter(range(0, len(r)), lambda i: r[i + 1] >= 0.5 * list_max(r))) * 3 * 1000.0 / {RATE} END AS burst_ms FROM b)
SELECT utterance, round(burst_ms, 4)::DOUBLE AS burst_ms, voicing_ms, round(voicing_ms - burst_ms, 4)::DOUBLE AS vot_ms FROM p LEFT JOIN o USING (utterance)""")
def voice_onsets(spark, d):
    """Bursts, the beginning of voicing, and the time from one to the other."""
    onset = T.voicing_onset_ms(T.voicing_track(F.col("x"), RATE))
    rows = samples(spark, d).select("utterance", T.burst_ms(F.col("x"), RATE).alias("b"), onset.alias("voicing_ms"))
    return rows.select("utterance", F.round("b", 4).alias("burst_ms"), "voicing_ms", F.round(F.col("voicing_ms") - F.col("b"), 4).alias("vot_ms"))


_DFT = "sqrt(pow(list_sum(list_transform(range(0, 8), lambda i: w[i + 1] * cos(2 * pi() * i * {k} / 8))), 2) + pow(list_sum(list_transform(range(0, 8), lambda i: w[i + 1] * sin(2 * pi() * i * {k} / 8))), 2))"


@query(f"""WITH u AS {SAMPLES}, w AS (SELECT utterance, j, list_transform(range(0, 8), lambda i: x[j * 8 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 7))) AS w, sqrt(list_sum(list_transform(x[j * 8 + 1:j * 8 + 8], lambda v: v * v)) / 8) AS r FROM (SELECT *, unnest(range(0, len(x) // 8)) AS j FROM u)),
h AS (SELECT utterance, j, r, round({" + ".join(_DFT.format(k=k) for k in (2, 3, 4))}, 9) AS hi FROM w), m AS (SELECT *, hi >= 0.5 * max(hi) OVER (PARTITION BY utterance) AS loud FROM h),
g AS (SELECT *, j - row_number() OVER (PARTITION BY utterance ORDER BY j) AS g FROM m WHERE loud), s AS (SELECT utterance, min(j) AS a, max(j) + 1 AS b FROM g GROUP BY utterance, g),
t AS (SELECT utterance, a, b FROM s QUALIFY row_number() OVER (PARTITION BY utterance ORDER BY b - a DESC, a) = 1),
y AS (SELECT utterance, count(*) AS n, greatest(3, count(*) // 2) AS half FROM h GROUP BY 1),
z AS (SELECT utterance, sum((j - (half - 1) / 2.0) * 20 * log10(r + 1e-9)) / any_value(half * (half * half - 1) / 12.0 * 5) AS rise FROM h JOIN y USING (utterance) WHERE j < half AND n >= 6 GROUP BY 1)
SELECT utterance, (a * 5)::DOUBLE AS start_ms, (b * 5)::DOUBLE AS end_ms, round(rise, 6) AS rise FROM t LEFT JOIN z USING (utterance)""")
def frication_intervals(spark, d):
    """The longest stretch of high-frequency energy, and how fast the utterance gets louder."""
    rows = samples(spark, d).select("utterance", T.frication_interval(F.col("x"), RATE, 400.0).alias("f"), T.rise_db_per_ms(F.col("x"), RATE).alias("r"))
    return rows.select("utterance", "f.start_ms", "f.end_ms", F.round("r", 6).alias("rise"))


@query(f"""WITH u AS {SAMPLES}, w AS (SELECT utterance, unnest([[0, NULL], [60, 330], [300, 345], [250, 262], [0, 70]]) AS span, len(x) AS n, x FROM u), b AS (SELECT utterance, coalesce(span[1], 0) AS from_ms, span[2] AS to_ms, least(coalesce(span[2], 1000000), round_even(n * 1000.0 / {RATE}, 0)::BIGINT) AS e, n, x FROM w),
r AS (SELECT *, round_even(from_ms * {RATE} / 1000.0, 0)::BIGINT AS p, least(n, round_even(e * {RATE} / 1000.0, 0)::BIGINT) AS q FROM b), g AS (SELECT utterance, from_ms, to_ms, q - p AS size, x[p + 1:q] AS x FROM r WHERE e - from_ms >= 20 AND q - p >= 32),
s AS (SELECT *, unnest(list_sort(list_distinct(range(0, size - 31, 16) || [size - 32]))) AS s FROM g), v AS (SELECT utterance, from_ms, to_ms, size, s, sqrt(list_sum(list_transform(x[s + 1:s + 32], lambda v: v * v)) / 32) AS v FROM s),
t AS (SELECT utterance, from_ms, to_ms, greatest(quantile_cont(v, 0.2) * 3, 0.01) AS lim FROM v GROUP BY ALL), h AS (SELECT v.utterance, v.from_ms, v.to_ms, any_value(size) AS size, min(s) AS a, max(s) AS z FROM v JOIN t ON v.utterance = t.utterance AND v.from_ms = t.from_ms AND v.to_ms IS NOT DISTINCT FROM t.to_ms WHERE v >= lim GROUP BY ALL),
o AS (SELECT utterance, from_ms, to_ms, from_ms + round_even(a * 1000.0 / {RATE}, 0)::BIGINT AS start_ms, from_ms + round_even(least(size, z + 32) * 1000.0 / {RATE}, 0)::BIGINT AS end_ms FROM h)
SELECT b.utterance, b.from_ms::BIGINT AS from_ms, b.to_ms::BIGINT AS to_ms, o.start_ms, o.end_ms FROM b LEFT JOIN o ON b.utterance = o.utterance AND b.from_ms = o.from_ms AND b.to_ms IS NOT DISTINCT FROM o.to_ms""")
def voiced_spans(spark, d):
    """What is loud within spans of an utterance: the whole, parts, one that is too short, a quiet one."""
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("from_ms"), F.lit(b).cast("long").alias("to_ms")) for a, b in ((0, None), (60, 330), (300, 345), (250, 262), (0, 70))])
    rows = samples(spark, d).select("utterance", "x", F.explode(spans).alias("s")).select("utterance", "x", "s.*")
    return rows.select("utterance", "from_ms", "to_ms", T.voiced_edges(F.col("x"), RATE, F.col("from_ms"), F.col("to_ms")).alias("e")).select("utterance", "from_ms", "to_ms", "e.*")


_TO = 1000
_UP, _DOWN = _TO // gcd(_TO, RATE), RATE // gcd(_TO, RATE)
_CUT = min(1.0, _UP / _DOWN)
_REACH = -(-T.CROSSINGS * _DOWN // _UP) if _UP < _DOWN else T.CROSSINGS


@query(f"""WITH u AS (SELECT utterance, list_transform(range(1, len(x) + 1), lambda i: (x[i] + x[len(x) + 1 - i]) / 2) AS x FROM {SAMPLES}), m AS (SELECT utterance, x, unnest(range(0, (len(x) * {_UP} + {_DOWN - 1}) // {_DOWN})) AS m FROM u),
k AS (SELECT utterance, m, x, unnest(range(m * {_DOWN} // {_UP} - {_REACH - 1}, m * {_DOWN} // {_UP} + {_REACH + 1})) AS k FROM m), t AS (SELECT utterance, m, coalesce(x[CASE WHEN k BETWEEN 0 AND len(x) - 1 THEN k + 1 END], 0) AS v, m * {_DOWN} / {_UP}::DOUBLE - k AS t FROM k)
SELECT utterance, m AS i, round(sum(v * {_CUT!r} * CASE WHEN abs(t) < 1e-12 THEN 1 ELSE sin(pi() * {_CUT!r} * t) / (pi() * {_CUT!r} * t) END * CASE WHEN abs(t) < {_REACH} THEN 0.5 + 0.5 * cos(pi() * t / {_REACH}) ELSE 0 END), 6) AS v FROM t GROUP BY 1, 2""")
def resampled(spark, d):
    """Two channels (an utterance and its reverse) mixed down and brought from 1600 to 1000 samples a second."""
    mono = T.mix_down(F.array("x", F.reverse("x")))
    rows = samples(spark, d).select("utterance", F.posexplode(T.resample(mono, RATE, _TO)).alias("i", "v"))
    return rows.select("utterance", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("""WITH f AS (SELECT vec_id // 10 AS utterance, vec_id % 10 * 2 + h AS frame, list_transform(embedding, lambda v, i: v::DOUBLE * 4 * (1 - 0.1 * h) + h * 0.001 * (i - 1)) AS s FROM embeddings, range(0, 2) t(h)),
p AS (SELECT utterance, frame, list_position(s, list_max(s)) % 6 AS token, 1 / list_sum(list_transform(s, lambda v: exp(v - list_max(s)))) AS p, count(*) OVER (PARTITION BY utterance) AS n, row_number() OVER (PARTITION BY utterance ORDER BY frame) - 1 AS k FROM f),
e AS (SELECT *, CASE WHEN token = lag(token) OVER w THEN 0 ELSE 1 END AS opens FROM p WINDOW w AS (PARTITION BY utterance ORDER BY frame)), r AS (SELECT *, sum(opens) OVER (PARTITION BY utterance ORDER BY frame) AS r FROM e)
SELECT utterance, min(token)::INTEGER AS token, round_even(min(k) * 400 / any_value(n)::DOUBLE, 0)::BIGINT AS start_ms, round_even((max(k) + 1) * 400 / any_value(n)::DOUBLE, 0)::BIGINT AS end_ms, round(avg(p), 9) AS confidence FROM r GROUP BY utterance, r HAVING min(token) NOT IN (0, 5)""")
def decoded_frames(spark, d):
    """Two frames a vector, whose 64 values are scores (of six tokens, by turns): the greatest of each frame, folded into runs without blanks."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    scores = F.transform("x", lambda v, i: v * 4 * (1 - 0.1 * F.col("h")) + F.col("h") * 0.001 * i)
    f = e.select(F.floor(F.col("vec_id") / 10).alias("utterance"), (F.col("vec_id") % 10 * 2 + F.col("h")).alias("frame"), T.frame_peak(scores).alias("p"))
    f = f.select("utterance", "frame", ((F.col("p.token") + 1) % 6).alias("token"), F.col("p.p").alias("p"))
    u = f.groupBy("utterance").agg(F.array_sort(F.collect_list(F.struct("frame", "token", "p"))).alias("f"))
    runs = T.decode_peaks(F.transform("f", lambda x: x["token"]), F.transform("f", lambda x: x["p"]), F.lit(400), [0, 5])
    rows = u.select("utterance", F.explode(runs).alias("r")).select("utterance", "r.*")
    return rows.withColumn("confidence", F.round("confidence", 9))


_HOUR = 3_600_000
#: Events come hours apart, so the limits are hours here.
LIMITS = voice.Limits(silence_ms=12 * _HOUR, least_speech_ms=4 * _HOUR, debounce_ms=6 * _HOUR, most_ms=150 * _HOUR, threshold=20.0)
_ENDS = f"CASE WHEN r.heard IS NULL THEN r.started + {LIMITS.most_ms} ELSE least(r.started + {LIMITS.most_ms}, greatest(r.last + {LIMITS.silence_ms}, r.heard + {LIMITS.least_speech_ms})) END"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT speaker AS k, start_us // 1000 AS t, duration_ms > {LIMITS.threshold} AS v, row_number() OVER (PARTITION BY speaker ORDER BY start_us // 1000, duration_ms) AS i, count(*) OVER (PARTITION BY speaker) AS n FROM {PHONE_EVENTS}),
r AS (SELECT k, i, n, t AS started, CASE WHEN v THEN t END AS above, NULL::BIGINT AS heard, NULL::BIGINT AS last, false AS over, NULL::BIGINT AS c_started, NULL::BIGINT AS c_heard, NULL::BIGINT AS c_end FROM e WHERE i = 1
UNION ALL SELECT k, i, n, started, CASE WHEN heard0 IS NOT NULL THEN above0 WHEN v THEN coalesce(above0, t) END, CASE WHEN heard0 IS NOT NULL THEN heard0 WHEN v AND t - coalesce(above0, t) >= {LIMITS.debounce_ms} THEN t END, CASE WHEN heard0 IS NULL THEN CASE WHEN v AND t - coalesce(above0, t) >= {LIMITS.debounce_ms} THEN t END WHEN v THEN t ELSE last0 END, over, c_started, c_heard, c_end
FROM (SELECT e.k, e.i, e.n, e.t, e.v, e.t >= {_ENDS} AS over, CASE WHEN e.t >= {_ENDS} THEN e.t ELSE r.started END AS started, CASE WHEN e.t < {_ENDS} THEN r.above END AS above0, CASE WHEN e.t < {_ENDS} THEN r.heard END AS heard0, CASE WHEN e.t < {_ENDS} THEN r.last END AS last0, r.started AS c_started, r.heard AS c_heard, {_ENDS} AS c_end FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)),
o AS (SELECT k, c_started AS started, c_heard AS heard, c_end AS ended FROM r WHERE over UNION ALL SELECT k, started, heard, {_ENDS} FROM r WHERE i = n)
SELECT k AS speaker, started AS started_ms, heard AS heard_ms, ended AS ended_ms, CASE WHEN ended = started + {LIMITS.most_ms} THEN 'limit' ELSE 'silence' END AS reason FROM o""")
def voice_recordings(spark, d):
    """Events as levels over time, cut into recordings by the voice-activity machine (its streaming form is tested against it)."""
    e = phone_events(spark, d).select("speaker", F.floor(F.col("start_us") / 1000).alias("t"), F.col("duration_ms").alias("level"))
    return voice.recordings(e, "speaker", "t", "level", LIMITS)
