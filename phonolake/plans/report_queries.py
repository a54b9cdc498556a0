"""Validation reports, posteriors, confusions, lexicon and curation audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import phones as P
from ..functions import sequences
from ..functions.exprs import rate_or_null
from ..operators import reports as R
from ..operators.aggregates import exact_quantiles, prefix_sums
from .adapters import INSTANCES, instances, sql_list, table
from .rule_queries import _CLASS, _LABEL_PHONE, _STATUS
from .text_queries import _EDITS, _OPS, _PAIRS, _pairs

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""SELECT provider AS model, count(*) AS total, round(sum(CASE WHEN status IN ('incorrect', 'missing') THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS hard_fp_rate, round(sum(CASE WHEN status = 'unscored' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS unscored_rate FROM {INSTANCES} GROUP BY 1""")
def model_comparison(spark, d):
    return R.rates(instances(spark, d), [F.col("provider").alias("model")], {"hard_fp_rate": F.col("status").isin("incorrect", "missing"), "unscored_rate": F.col("status") == "unscored"})


def validation_rows(spark, d):
    """Instances with the kind of their segment (CTL, W_NAT, W_ERR), whether the place is an intended error, and a score."""
    s = F.col("segment") % 3
    kind = F.when(s == 0, "CTL").when(s == 1, "W_NAT").otherwise("W_ERR")
    flagged = F.col("status").isin("incorrect", "missing")
    return instances(spark, d).withColumn("kind", kind).withColumn("intended", (kind == "W_ERR") & (F.col("k") % 4 == 0)).withColumn("flagged", flagged).withColumn("extra", F.col("k") == 13)


_ROWS = f"""(SELECT *, CASE segment % 3 WHEN 0 THEN 'CTL' WHEN 1 THEN 'W_NAT' ELSE 'W_ERR' END AS kind, segment % 3 = 2 AND k % 4 = 0 AS intended, status IN ('incorrect', 'missing') AS flagged, k = 13 AS extra FROM {INSTANCES})"""


@query(f"""WITH a AS (SELECT kind, CASE WHEN grouping(provider) = 1 THEN 'ALL' ELSE provider END AS speaker, count(*) AS total, count(CASE WHEN status = 'correct' THEN 1 END) AS correct, count(CASE WHEN status = 'incorrect' THEN 1 END) AS incorrect, count(CASE WHEN status = 'missing' THEN 1 END) AS missing, count(CASE WHEN flagged THEN 1 END) AS flagged,
CAST(sum(CAST(CASE WHEN NOT extra THEN confidence END AS DECIMAL(20,6))) AS DOUBLE) / count(CASE WHEN NOT extra THEN confidence END) AS m, count(CASE WHEN intended THEN 1 END) AS intended, count(CASE WHEN intended AND flagged THEN 1 END) AS caught FROM {_ROWS} GROUP BY GROUPING SETS ((kind), (kind, provider)))
SELECT kind, speaker, total, correct, incorrect, missing, flagged, round(m, 6) AS mean_score, CASE WHEN kind <> 'W_ERR' THEN round(flagged::DOUBLE / total, 4) END AS hard_fp_rate, CASE WHEN kind = 'W_ERR' THEN round(caught::DOUBLE / nullif(intended, 0), 4) END AS detection_rate, CASE WHEN kind = 'W_ERR' THEN round(caught::DOUBLE / nullif(flagged, 0), 4) END AS precision_rate FROM a""")
def kind_summary(spark, d):
    """Per kind, and per kind and speaker, in one aggregation: counts, mean score, false positives of what is right, detection of what is not."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    score = F.when(~F.col("extra"), F.col("confidence"))
    mean = F.sum(score.cast("decimal(20,6)")).cast("double") / F.count(score)
    per = validation_rows(spark, d).rollup("kind", "provider").agg(F.count(F.lit(1)).alias("total"), *[n(F.col("status") == s).alias(s) for s in ("correct", "incorrect", "missing")], n(F.col("flagged")).alias("n_flagged"), mean.alias("m"), n(F.col("intended")).alias("intended"), n(F.col("intended") & F.col("flagged")).alias("caught"), F.grouping_id().alias("g")).where("g < 3")
    wrong = F.col("kind") == "W_ERR"
    share = lambda a, b: F.round(rate_or_null(F.col(a), F.nullif(F.col(b), F.lit(0))), 4)
    return per.select("kind", F.when(F.col("g") == 1, "ALL").otherwise(F.col("provider")).alias("speaker"), "total", "correct", "incorrect", "missing", F.col("n_flagged").alias("flagged"), F.round("m", 6).alias("mean_score"), F.when(~wrong, share("n_flagged", "total")).alias("hard_fp_rate"), F.when(wrong, share("caught", "intended")).alias("detection_rate"), F.when(wrong, share("caught", "n_flagged")).alias("precision_rate"))


@query(f"""SELECT CASE WHEN status = 'missing' THEN '(missing)' ELSE {_CLASS} END AS phone_class, count(CASE WHEN kind <> 'W_ERR' THEN 1 END) AS native_total, count(CASE WHEN kind <> 'W_ERR' AND flagged THEN 1 END) AS native_flagged, round(count(CASE WHEN kind <> 'W_ERR' AND flagged THEN 1 END)::DOUBLE / nullif(count(CASE WHEN kind <> 'W_ERR' THEN 1 END), 0), 4) AS hard_fp_rate,
count(CASE WHEN intended THEN 1 END) AS err_intended, count(CASE WHEN intended AND flagged THEN 1 END) AS err_caught, round(count(CASE WHEN intended AND flagged THEN 1 END)::DOUBLE / nullif(count(CASE WHEN intended THEN 1 END), 0), 4) AS detection_rate FROM {_ROWS} GROUP BY 1""")
def phone_class_rates(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cls = F.when(F.col("status") == "missing", "(missing)").otherwise(P.phone_class(F.col("expected")))
    native, hit, meant = F.col("kind") != "W_ERR", F.col("flagged"), F.col("intended")
    per = validation_rows(spark, d).groupBy(cls.alias("phone_class")).agg(n(native).alias("native_total"), n(native & hit).alias("native_flagged"), n(meant).alias("err_intended"), n(meant & hit).alias("err_caught"))
    share = lambda a, b: F.round(rate_or_null(F.col(a), F.nullif(F.col(b), F.lit(0))), 4)
    return per.select("*", share("native_flagged", "native_total").alias("hard_fp_rate"), share("err_caught", "err_intended").alias("detection_rate"))


#: Speech-like frames: each vector's values as scores of as many tokens; ten vectors are an utterance of 20 ms frames.
_TOKENS = [*P.PHONES, *(f"x{i}" for i in range(64 - len(P.PHONES)))]
_FRAMES = f"""(SELECT vec_id // 10 AS utterance, vec_id % 10 * 20 AS s, vec_id % 10 * 20 + 20 AS e, label, {list(_TOKENS)}[i] AS token, embedding[i]::DOUBLE * 10 AS x FROM embeddings, range(1, 65) t(i))"""


def frames(spark, d):
    e = table(spark, d, "embeddings")
    long = e.select(F.floor(F.col("vec_id") / 10).alias("utterance"), (F.col("vec_id") % 10 * 20).alias("s"), (F.col("vec_id") % 10 * 20 + 20).alias("e"), "label", F.posexplode("embedding").alias("i", "x"))
    return long.select("utterance", "s", "e", "label", F.element_at(F.array(*map(F.lit, _TOKENS)), F.col("i") + 1).alias("token"), (F.col("x").cast("double") * 10).alias("x"))


_LOGP = f"(SELECT *, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY utterance, s)) AS logp FROM (SELECT *, max(x) OVER (PARTITION BY utterance, s) AS m FROM {_FRAMES}))"
#: Spans of an utterance: three phones of 70 ms each.
_SPANS = f"(SELECT u AS utterance, j AS span, j * 70 - 10 AS a, j * 70 + 60 AS b, {list(_TOKENS)}[(u + j) % 64 + 1] AS target FROM (SELECT DISTINCT vec_id // 10 AS u FROM embeddings), range(0, 3) t(j))"


def spans(spark, d):
    u = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("utterance")).distinct()
    j = u.select("utterance", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("span"))
    target = F.element_at(F.array(*map(F.lit, _TOKENS)), ((F.col("utterance") + F.col("span")) % 64 + 1).cast("int"))
    return j.select("utterance", "span", (F.col("span") * 70 - 10).alias("a"), (F.col("span") * 70 + 60).alias("b"), target.alias("target"))


@query(f"""WITH f AS {_LOGP}, x AS (SELECT p.utterance, p.span, token, sum(exp(logp)) AS total, count(*) AS n_frames FROM {_SPANS} p JOIN f ON f.utterance = p.utterance AND f.s < p.b AND f.e > p.a GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY utterance, span ORDER BY round(total / n_frames, 6) DESC, token) AS rank FROM x) SELECT utterance, span, token, n_frames, round(total / n_frames, 6) AS probability, rank FROM r WHERE rank <= 5""")
def posterior_candidates(spark, d):
    """The five likeliest tokens of each span by their mean posterior over the frames that overlap it."""
    return R.span_candidates(R.log_softmax(frames(spark, d), ["utterance", "s"], "x"), spans(spark, d), "utterance", 5)


@query(f"""WITH f AS {_LOGP}, x AS (SELECT p.utterance, p.span, p.target, f.s, f.token, f.logp FROM {_SPANS} p JOIN f ON f.utterance = p.utterance AND f.s < p.b AND f.e > p.a),
t AS (SELECT utterance, span, s, logp, row_number() OVER (PARTITION BY utterance, span ORDER BY round(logp, 9) DESC, s) AS r FROM x WHERE token = target), b AS (SELECT utterance, span, s, token, logp, row_number() OVER (PARTITION BY utterance, span, s ORDER BY round(logp, 9) DESC, token) AS r FROM x),
n AS (SELECT utterance, span, count(DISTINCT s) AS n_frames FROM x GROUP BY 1, 2)
SELECT t.utterance, t.span, t.s AS peak_ms, round(t.logp, 6) AS target_logprob, round(b.logp, 6) AS best_logprob, b.token AS observed, n_frames FROM t JOIN b ON b.utterance = t.utterance AND b.span = t.span AND b.s = t.s AND b.r = 1 JOIN n ON n.utterance = t.utterance AND n.span = t.span WHERE t.r = 1""")
def peak_frames(spark, d):
    """The frame of a span where its target is likeliest, and what is likeliest there."""
    return R.peak_frames(R.log_softmax(frames(spark, d), ["utterance", "s"], "x"), spans(spark, d), "utterance")


@query(f"""{_OPS}, tt AS (SELECT target, predicted, count(*) AS n, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, predicted) AS k FROM o WHERE op = 'substitution' GROUP BY 1, 2), x AS (SELECT target AS token, string_agg(predicted || ':' || n, ' ' ORDER BY k) AS top_confusions FROM tt WHERE k <= 5 GROUP BY 1),
a AS (SELECT target AS token, count(*) AS ref_count, count(CASE WHEN op = 'match' THEN 1 END) AS correct, count(CASE WHEN op = 'substitution' THEN 1 END) AS substituted, count(CASE WHEN op = 'deletion' THEN 1 END) AS deleted FROM o WHERE op <> 'insertion' GROUP BY 1)
SELECT a.*, round((substituted + deleted)::DOUBLE / ref_count, 4) AS error_rate, top_confusions FROM a LEFT JOIN x USING (token)""")
def confusion_report(spark, d):
    """Per token of the reference: uses, matches, substitutions, deletions, error rate, and its five commonest confusions (tested against a plain count)."""
    return R.confusions(_pairs(spark, d).select("grp", F.explode(sequences.align("r", "h")).alias("e")), 5)


@query(f"""{_OPS} SELECT * FROM (SELECT grp, target, predicted, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, target, predicted) AS rank FROM o WHERE op = 'substitution' GROUP BY 1, 2, 3) WHERE rank <= 15""")
def group_substitutions(spark, d):
    """The fifteen commonest substitutions of each group (tested with the confusions)."""
    ops = _pairs(spark, d).select("grp", F.explode(sequences.align("r", "h")).alias("e"))
    return R.top_substitutions(ops, "grp", 15)


_SHORT_WORDS = "list_filter({0}, lambda w: length(w) > 2)"


@query(f"""WITH RECURSIVE {_PAIRS.replace("a.tok AS r, b.tok AS h", _SHORT_WORDS.format("a.tok") + " AS r, " + _SHORT_WORDS.format("b.tok") + " AS h")}, {_EDITS} SELECT grp, count(*) AS n_utterances, sum(len(r))::BIGINT AS ref_len, sum(len(h))::BIGINT AS pred_len, sum(edits)::BIGINT AS edits, round(sum(edits)::DOUBLE / nullif(sum(len(r)), 0), 4) AS error_rate FROM e GROUP BY grp""")
def segmental_error_rate(spark, d):
    """Error rates without the tokens that don't count as segments (here: of one or two letters), by group."""
    keep = lambda c: F.filter(c, lambda w: F.length(w) > 2)
    p = _pairs(spark, d).select("grp", keep("r").alias("r"), keep("h").alias("h"))
    e = p.select("grp", F.size("r").alias("a"), F.size("h").alias("b"), sequences.token_edits(F.col("r"), F.col("h")).alias("edits"))
    per = e.groupBy("grp").agg(F.count(F.lit(1)).alias("n_utterances"), F.sum("a").alias("ref_len"), F.sum("b").alias("pred_len"), F.sum("edits").alias("edits"))
    return per.withColumn("error_rate", F.round(rate_or_null(F.col("edits"), F.nullif(F.col("ref_len"), F.lit(0))), 4))


@query(f"""SELECT expected AS phone, replace(expected, 'ː', '') AS short_phone, count(*) AS ref_count, count(CASE WHEN observed = expected THEN 1 END) AS correct, count(CASE WHEN observed <> expected THEN 1 END) AS substituted, count(CASE WHEN observed IS NULL THEN 1 END) AS deleted,
count(CASE WHEN observed = replace(expected, 'ː', '') THEN 1 END) AS shortened, round(count(CASE WHEN observed IS NULL OR observed <> expected THEN 1 END)::DOUBLE / count(*), 4) AS error_rate FROM {INSTANCES} WHERE expected IN {sql_list(P.LONG)} GROUP BY 1""")
def long_vowel_diagnostics(spark, d):
    """What becomes of long vowels, and how often it is their short partner."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e, o = F.col("expected"), F.col("observed")
    rows = instances(spark, d).where(e.isin(P.LONG))
    per = rows.groupBy(e.alias("phone"), P.short_of(e).alias("short_phone")).agg(F.count(F.lit(1)).alias("ref_count"), n(o == e).alias("correct"), n(o != e).alias("substituted"), n(o.isNull()).alias("deleted"), n(o == P.short_of(e)).alias("shortened"))
    return per.withColumn("error_rate", F.round(rate_or_null(F.col("substituted") + F.col("deleted"), F.col("ref_count")), 4))


@query(f"""SELECT check_name, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_name IS NULL OR p_name = '' THEN 'empty_word' END, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN 'duplicate_word' END, CASE WHEN split_part(p_type, ' ', 1) NOT IN ('STANDARD', 'SMALL', 'MEDIUM') THEN 'unknown_type' END,
CASE WHEN len(list_filter(string_split(lower(p_brand), ''), lambda c: c NOT IN {sql_list("brand#")})) > 0 THEN 'unknown_token' END], lambda x: x IS NOT NULL)) AS check_name FROM part) GROUP BY 1""")
def lexicon_audit(spark, d):
    """What is wrong with the entries of a lexicon: empty and repeated words, types and tokens that are not known."""
    p = table(spark, d, "part")
    checks = R.lexicon_checks("p_name", F.split_part("p_type", F.lit(" "), F.lit(1)), F.split(F.lower("p_brand"), ""), ["STANDARD", "SMALL", "MEDIUM"], list("brand#"))
    many = p.groupBy("p_name").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return p.join(many, "p_name", "left").select(F.explode(checks).alias("check_name")).groupBy("check_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH inv AS (SELECT unnest(['k', 'kʰ', 'c', 'cʰ']) AS phone), r AS (SELECT *, {_LABEL_PHONE} AS p, {_STATUS} AS ms FROM {INSTANCES})
SELECT phone, count(id) AS n, count(DISTINCT segment) AS n_speakers, count(CASE WHEN segment % 10 < 8 THEN id END) AS train, count(CASE WHEN segment % 10 = 8 THEN id END) AS dev, count(CASE WHEN segment % 10 = 9 THEN id END) AS test FROM inv LEFT JOIN r ON r.p = phone AND ms = 'accepted' GROUP BY phone""")
def curation_summary(spark, d):
    """Accepted labels, their speakers and splits for each phone that is wanted, with zeros."""
    rows = instances(spark, d).select("id", "segment", P.parsed_label(F.col("label")).alias("l")).where("l.status = 'accepted'").select("id", "segment", F.col("l.phone").alias("phone"))
    wanted = spark.createDataFrame([(p,) for p in ("k", "kʰ", "c", "cʰ")], "phone string")
    split = F.col("segment") % 10
    part = lambda c: F.count(F.when(c, F.col("id")))
    return F.broadcast(wanted).join(rows, "phone", "left").groupBy("phone").agg(F.count("id").alias("n"), F.countDistinct("segment").alias("n_speakers"), part(split < 8).alias("train"), part(split == 8).alias("dev"), part(split == 9).alias("test"))


@query(f"""SELECT expected AS phone, count(*) AS n, round(CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) / count(*), 6) AS mean_value, round(quantile_cont(duration_ms, 0.5), 6) AS median_value, round(quantile_cont(duration_ms, 0.1), 6) AS p10, round(quantile_cont(duration_ms, 0.25), 6) AS p25, round(quantile_cont(duration_ms, 0.75), 6) AS p75, round(quantile_cont(duration_ms, 0.9), 6) AS p90,
round((quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25)) / 1.349, 6) AS scale FROM {INSTANCES} WHERE duration_ms IS NOT NULL GROUP BY 1""")
def reference_distribution(spark, d):
    rows = instances(spark, d)
    q = exact_quantiles(rows, ["expected"], "duration_ms", [0.1, 0.25, 0.5, 0.75, 0.9])
    mean = rows.groupBy("expected").agg((F.sum(F.col("duration_ms").cast("decimal(20,6)")).cast("double") / F.count("duration_ms")).alias("m"))
    v = lambda i: F.round(F.col("q")[i], 6)
    return q.join(mean, "expected").select(F.col("expected").alias("phone"), "n", F.round("m", 6).alias("mean_value"), v(2).alias("median_value"), v(0).alias("p10"), v(1).alias("p25"), v(3).alias("p75"), v(4).alias("p90"), F.round((F.col("q")[3] - F.col("q")[1]) / 1.349, 6).alias("scale"))


#: Pairs of a target and an alternative that are compared (fixed values of this query).
_PAIRS_WANTED = [("a", "e"), ("a", "o"), ("e", "i"), ("i", "ɯ"), ("o", "u"), ("u", "y")]


@query(f"""WITH c AS (SELECT unnest({[a for a, _ in _PAIRS_WANTED]}) AS target, unnest({[b for _, b in _PAIRS_WANTED]}) AS alternative), s AS (SELECT expected, quantile_cont(duration_ms, 0.5) AS m, (quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25)) / 1.349 AS sc FROM {INSTANCES} GROUP BY 1)
SELECT target, alternative, count(*) AS n, round(avg(exp(-0.5 * pow((duration_ms - t.m) / t.sc, 2)) - exp(-0.5 * pow((duration_ms - a.m) / a.sc, 2))), 6) AS mean_margin FROM {INSTANCES} i JOIN c ON c.target = replace(i.expected, 'ː', '') JOIN s t ON t.expected = target JOIN s a ON a.expected = alternative WHERE segment % 10 = 8 AND t.sc > 0 AND a.sc > 0 GROUP BY 1, 2""")
def calibration_margins(spark, d):
    """Each instance of a target meets the alternatives it is compared with; the margin is its fit less theirs."""
    rows = instances(spark, d)
    q = exact_quantiles(rows, ["expected"], "duration_ms", [0.25, 0.5, 0.75])
    stats = q.select("expected", F.struct(F.col("q")[1].alias("m"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("sc")).alias("s"))
    pairs = spark.createDataFrame(_PAIRS_WANTED, "target string, alternative string")
    both = pairs.join(stats.select(F.col("expected").alias("target"), F.col("s").alias("t")), "target").join(stats.select(F.col("expected").alias("alternative"), F.col("s").alias("a")), "alternative").where("t.sc > 0 AND a.sc > 0")
    held = rows.where(F.col("segment") % 10 == 8).select(F.replace("expected", F.lit("ː")).alias("target"), "duration_ms")
    fit = lambda s: F.exp(-0.5 * F.pow((F.col("duration_ms") - F.col(f"{s}.m")) / F.col(f"{s}.sc"), F.lit(2.0)))
    return held.join(F.broadcast(both), "target").groupBy("target", "alternative").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(fit("t") - fit("a")), 6).alias("mean_margin"))


@query(f"""SELECT segment, phone, round(p, 6) AS probability FROM (SELECT segment, lower(trim(expected)) AS phone, max(confidence) AS p, row_number() OVER (PARTITION BY segment ORDER BY max(confidence) DESC NULLS LAST, lower(trim(expected))) AS r FROM {INSTANCES} GROUP BY 1, 2) WHERE r = 1""")
def merged_map_argmax(spark, d):
    """Token maps merged on normalised keys (the greater value stays), and the key of the greatest value: by (segment, key), then by segment."""
    per = instances(spark, d).groupBy("segment", F.lower(F.trim("expected")).alias("k")).agg(F.max("confidence").alias("v"))
    best = per.groupBy("segment").agg(F.min(F.struct(F.isnull("v").alias("none"), (-F.col("v")).alias("v"), "k")).alias("b"))
    return best.select("segment", F.col("b.k").alias("phone"), F.round(-F.col("b.v"), 6).alias("probability"))


_RARE = ["œː", "yː", "ɯː", "ʒ"]


@query(f"""WITH s AS (SELECT segment, list(expected ORDER BY start_ms, id) AS p FROM {INSTANCES} GROUP BY 1) SELECT segment, list_has_any(p, {_RARE}) AS has_rare, len(list_filter(p, lambda x: list_contains({_RARE}, x)))::INTEGER AS n_rare, len(list_filter(p, lambda x: NOT list_contains({[*P.SHORT, *P.LONG, *P.CONSONANTS]}, x))) = 0 AS inventory_ok FROM s""")
def rare_phones(spark, d):
    """Whether a segment has rare phones, how many, and whether all of its phones are in an inventory."""
    rare, known = F.col("expected").isin(_RARE), F.col("expected").isin([*P.SHORT, *P.LONG, *P.CONSONANTS])
    return instances(spark, d).groupBy("segment").agg(F.bool_or(rare).alias("has_rare"), F.sum(rare.cast("int")).cast("int").alias("n_rare"), F.bool_and(known).alias("inventory_ok"))


@query(f"""WITH a AS (SELECT segment, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(confidence) AS mc, min(start_ms) AS s, max(end_ms) AS e, string_agg(expected || ':' || (end_ms - start_ms), ' ' ORDER BY start_ms, id) AS phones FROM {INSTANCES} GROUP BY 1) SELECT segment, n::INTEGER AS phone_count, round(mc, 6) AS mean_confidence, s AS start_ms, e AS end_ms, phones FROM a""")
def alignment_json_round_trip(spark, d):
    """Alignments built as JSON with their summaries, and read again."""
    built = R.build_alignments(instances(spark, d), "segment")
    return R.read_alignments(built, "segment").select("segment", "phone_count", F.round("mean_confidence", 6).alias("mean_confidence"), "start_ms", "end_ms", F.array_join(F.transform("phones", lambda p: F.concat_ws(":", p["expected_phone"], (p["end_ms"] - p["start_ms"]).cast("string"))), " ").alias("phones"))


@query(f"""WITH s AS (SELECT segment, list(expected ORDER BY start_ms, id) AS p FROM {INSTANCES} GROUP BY 1), t AS (SELECT segment, p, flatten(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 5 = 0 THEN ['<spc>', p[i]] WHEN i % 3 = 0 THEN ['ˈ', p[i]] ELSE [p[i]] END)) AS tok FROM s),
x AS (SELECT segment, unnest(range(1, len(tok) + 1)) AS i, tok FROM t) SELECT segment, i AS position, tok[i] AS token, CASE WHEN tok[i] IN ('<spc>', 'ˈ') THEN NULL ELSE len(list_filter(tok[1:i], lambda c: c NOT IN ('<spc>', 'ˈ'))) END AS slot FROM x""")
def zipped_slots(spark, d):
    """Tokens with markers among them, each but the markers given the next slot of the alignment."""
    rows = instances(spark, d).select("segment", F.struct("start_ms", "id").alias("at"), "expected", F.lit(1).alias("one"))
    rows = prefix_sums(rows, ["segment"], "at", ["one"]).withColumn("i", F.col("one_to"))  # no task holds a segment
    before = F.floor((F.col("i") - 1) / 5) + F.floor((F.col("i") - 1) / 3) - F.floor((F.col("i") - 1) / 15)  # markers before this phone's own
    mark = F.when(F.col("i") % 5 == 0, "<spc>").when(F.col("i") % 3 == 0, "ˈ")
    place = F.col("i") + before
    own = F.array_compact(F.array(F.when(mark.isNotNull(), F.struct(place.alias("position"), mark.alias("token"), F.lit(None).cast("long").alias("slot"))), F.struct((place + mark.isNotNull().cast("int")).alias("position"), F.col("expected").alias("token"), F.col("i").alias("slot"))))
    return rows.select("segment", F.explode(own).alias("x")).select("segment", "x.*")


_SHORTER = {"the": "a", "of": "in", "to": "", "der": "die", "que": "de"}


@query(f"""{_OPS}, m AS (SELECT unnest({list(_SHORTER)}) AS token, unnest({list(_SHORTER.values())}) AS short), x AS (SELECT coalesce(target, predicted) AS token, op, predicted FROM o),
a AS (SELECT token, count(CASE WHEN op <> 'insertion' THEN 1 END) AS ref_count, count(CASE WHEN op = 'match' THEN 1 END) AS correct, count(CASE WHEN op = 'substitution' THEN 1 END) AS substituted, count(CASE WHEN op = 'deletion' THEN 1 END) AS deleted, count(CASE WHEN op = 'insertion' THEN 1 END) AS inserted, count(CASE WHEN op = 'substitution' AND predicted = short THEN 1 END) AS shortened FROM x JOIN m USING (token) GROUP BY 1)
SELECT *, round((substituted + deleted)::DOUBLE / nullif(ref_count, 0), 4) AS error_rate, round(shortened::DOUBLE / nullif(ref_count, 0), 4) AS shortened_rate FROM a""")
def token_diagnostics(spark, d):
    """What becomes of single tokens, insertions and shorter forms included (as of stress marks and long vowels)."""
    return R.token_diagnostics(_pairs(spark, d).select("grp", F.explode(sequences.align("r", "h")).alias("e")), _SHORTER)
