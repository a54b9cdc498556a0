"""Rules over phone instances: evidence, risk, labels, contrasts, gates, lengths, word senses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import phones as P
from ..functions import g2p, phonetics
from ..functions import names as N
from ..functions.exprs import WORD, empty_as, rate_or_null, words
from ..operators.aggregates import exact_quantiles
from .adapters import INSTANCES, instances, sql_list, table
from .likeness_sql import inventory_sql, likeness_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_TYPE = "CASE " + " ".join(f"WHEN expected IN {sql_list(ps)} THEN '{kind}'" for kind, ps in P.EVIDENCE.items()) + " ELSE 'model-observable' END"
_FIRST = "trim(split_part(trim(label), '|', 1))"
_GIVEN = "lower(trim(split_part(trim(label), '|', 2)))"
_ALONE = f"{_FIRST} IN ('reject', 'uncertain', 'accepted')"
_NAMED = f"CASE WHEN {_ALONE} THEN {_FIRST} WHEN {_GIVEN} <> '' THEN {_GIVEN} ELSE 'accepted' END"
_STATUS = f"CASE WHEN trim(label) = '' THEN 'empty' WHEN {_NAMED} IN ('accepted', 'uncertain', 'reject', 'empty') THEN {_NAMED} ELSE 'uncertain' END"
_LABEL_PHONE = f"CASE WHEN trim(label) = '' OR {_ALONE} OR {_FIRST} = '' THEN NULL ELSE {_FIRST} END"
_NOTES = "array_to_string(list_transform(string_split(trim(label), '|')[3:], lambda p: trim(p)), '|')"


@query(f"""WITH r AS (SELECT *, {_TYPE} AS evidence_type, {_STATUS} AS ms, {_LABEL_PHONE} AS mp FROM {INSTANCES}),
c AS (SELECT *, CASE WHEN evidence_type = 'manual-only' THEN CASE WHEN ms = 'accepted' AND mp = expected THEN 'supported' ELSE 'manual_review_required' END
WHEN evidence_type = 'feature-derived' THEN CASE WHEN duration_ms > 20 THEN 'supported' ELSE 'acoustic_mismatch' END WHEN observed IS DISTINCT FROM expected THEN 'model_mismatch' ELSE 'supported' END AS class FROM r)
SELECT expected AS phone, evidence_type, count(*) AS n, count(CASE WHEN observed = expected THEN 1 END) AS n_match, count(CASE WHEN ms = 'accepted' AND mp IS NOT NULL THEN 1 END) AS n_manual,
CASE WHEN evidence_type = 'manual-only' AND count(CASE WHEN ms = 'accepted' AND mp IS NOT NULL THEN 1 END) > 0 THEN 'supported' ELSE arg_min(class, CASE class WHEN 'manual_review_required' THEN 0 WHEN 'model_mismatch' THEN 1 WHEN 'acoustic_mismatch' THEN 2 ELSE 3 END) END AS evidence_class
FROM c GROUP BY expected, evidence_type""")
def evidence_report(spark, d):
    """Each phone's evidence: its type from the dictionary, the class of every instance, and the worst of them."""
    rows = instances(spark, d).join(F.broadcast(P.evidence_types(spark)), F.col("expected") == F.col("phone"))
    rows = rows.withColumn("l", P.parsed_label(F.col("label")))
    manual = (F.col("l.status") == "accepted") & F.col("l.phone").isNotNull()
    same = lambda c: F.coalesce(c == F.col("expected"), F.lit(False))
    kind = F.col("evidence_type")
    cls = F.when(kind == "manual-only", F.when(manual & same(F.col("l.phone")), "supported").otherwise("manual_review_required"))
    cls = cls.when(kind == "feature-derived", F.when(F.col("duration_ms") > 20, "supported").otherwise("acoustic_mismatch")).when(~same(F.col("observed")), "model_mismatch").otherwise("supported")
    rank = F.when(F.col("class") == "manual_review_required", 0).when(F.col("class") == "model_mismatch", 1).when(F.col("class") == "acoustic_mismatch", 2).otherwise(3)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.withColumn("class", cls).groupBy("phone", "evidence_type").agg(F.count(F.lit(1)).alias("n"), n(same(F.col("observed"))).alias("n_match"), n(manual).alias("n_manual"), F.min_by("class", rank).alias("worst"))
    return out.select("phone", "evidence_type", "n", "n_match", "n_manual", F.when((kind == "manual-only") & (F.col("n_manual") > 0), "supported").otherwise(F.col("worst")).alias("evidence_class"))


@query(f"""WITH inv AS (SELECT unnest([{", ".join(f"'{p}'" for p in [*P.PHONES, P.STRESS])}]) AS expected), t AS (SELECT expected, {_TYPE} AS evidence_type FROM inv),
a AS (SELECT expected, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(confidence) AS mc, count(CASE WHEN {_STATUS} = 'accepted' AND {_LABEL_PHONE} IS NOT NULL THEN 1 END) AS ok FROM {INSTANCES} GROUP BY expected)
SELECT expected AS phone, coalesce(n, 0) AS n, round(mc, 6) AS mean_confidence, CASE WHEN expected = '{P.STRESS}' THEN CASE WHEN coalesce(n, 0) > 0 THEN 'supported' ELSE 'low_count' END WHEN evidence_type = 'rule-only' THEN 'rule_only' WHEN evidence_type = 'feature-derived' THEN 'feature_missing'
WHEN coalesce(n, 0) = 0 THEN 'low_count' WHEN evidence_type = 'manual-only' THEN CASE WHEN ok > 0 THEN 'supported' ELSE 'manual_risk' END WHEN mc < 0.80 THEN 'alignment_risk' ELSE 'supported' END AS risk FROM t LEFT JOIN a USING (expected)""")
def risk_classes(spark, d):
    """Every phone of the inventory with its count, mean confidence and risk."""
    label = P.parsed_label(F.col("label"))
    ok = (label["status"] == "accepted") & label["phone"].isNotNull()
    mean = F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("confidence")
    per = instances(spark, d).groupBy(F.col("expected").alias("phone")).agg(F.count(F.lit(1)).alias("n"), mean.alias("mc"), F.sum(F.when(ok, 1).otherwise(0)).alias("ok"))
    rows = P.evidence_types(spark).join(per, "phone", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind, n = F.col("evidence_type"), F.col("n")
    some = lambda c, yes, no: F.when(c, yes).otherwise(no)
    risk = F.when(F.col("phone") == P.STRESS, some(n > 0, "supported", "low_count")).when(kind == "rule-only", "rule_only").when(kind == "feature-derived", "feature_missing").when(n == 0, "low_count")
    risk = risk.when(kind == "manual-only", some(F.col("ok") > 0, "supported", "manual_risk")).when(F.col("mc") < 0.80, "alignment_risk").otherwise("supported")
    return rows.select("phone", "n", F.round("mc", 6).alias("mean_confidence"), risk.alias("risk"))


@query(f"""SELECT id, {_LABEL_PHONE} AS phone, {_STATUS} AS status, CASE WHEN trim(label) = '' THEN '' WHEN {_NAMED} IN ('accepted', 'uncertain', 'reject', 'empty') THEN {_NOTES} WHEN {_NOTES} = '' THEN trim(label) ELSE {_NOTES} || '|' || trim(label) END AS notes,
trim(label) <> '' AND contains(trim(label), '|') AND CASE WHEN {_GIVEN} = '' THEN 'accepted' ELSE {_GIVEN} END NOT IN ('accepted', 'uncertain', 'reject') AS malformed FROM {INSTANCES}""")
def manual_labels(spark, d):
    return instances(spark, d).select("id", P.parsed_label(F.col("label")).alias("l")).select("id", "l.*")


@query(f"""SELECT expected || '→' || coalesce(observed, '') AS contrast, CASE WHEN observed IS NULL THEN 'missing' WHEN expected IN {sql_list(P.VOWELS)} THEN 'vowel' ELSE 'consonant' END AS class, count(*) AS n,
CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(confidence) AS mean_score FROM {INSTANCES} WHERE status IN ('incorrect', 'missing') GROUP BY 1, 2""")
def contrast_overrides(spark, d):
    """Overridden instances by contrast."""
    bad = instances(spark, d).where(F.col("status").isin("incorrect", "missing"))
    contrast = F.concat("expected", F.lit("→"), F.coalesce("observed", F.lit("")))
    return bad.groupBy(contrast.alias("contrast"), P.contrast_class(F.col("status"), F.col("expected"), F.col("observed")).alias("class")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("confidence")).alias("mean_score"))


_NEXT = f"(SELECT *, lag(expected) OVER w AS before, lead(expected) OVER w AS after FROM {INSTANCES} WINDOW w AS (PARTITION BY segment ORDER BY start_ms, id))"


def with_context(rows):
    w = Window.partitionBy("segment").orderBy("start_ms", "id")
    return rows.withColumn("before", F.lag("expected").over(w)).withColumn("after", F.lead("expected").over(w))


@query(f"""WITH r AS {_NEXT} SELECT subset, count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) AS total FROM (SELECT duration_ms, unnest(list_filter(['global_all', CASE WHEN expected IN ('kʰ', 'cʰ') THEN 'aspirated_only' END, CASE WHEN expected IN ('k', 'c') THEN 'plain_only' END,
CASE WHEN after IN ('a', 'aː') THEN 'back_context_all' END, CASE WHEN after IN ('a', 'aː') AND expected IN ('kʰ', 'cʰ') THEN 'back_context_aspirated' END, CASE WHEN after IN ('a', 'aː') AND expected IN ('k', 'c') THEN 'back_context_plain' END, CASE WHEN {_STATUS} = 'accepted' THEN 'curated' END], lambda x: x IS NOT NULL)) AS subset FROM r) GROUP BY subset""")
def context_subsets(spark, d):
    """Named subsets in one pass: an instance carries the names of all it belongs to."""
    rows = with_context(instances(spark, d))
    back, loud, plain = F.col("after").isin("a", "aː"), F.col("expected").isin("kʰ", "cʰ"), F.col("expected").isin("k", "c")
    tags = {"aspirated_only": loud, "plain_only": plain, "back_context_all": back, "back_context_aspirated": back & loud, "back_context_plain": back & plain, "curated": P.parsed_label(F.col("label"))["status"] == "accepted"}
    named = F.array_compact(F.array(F.lit("global_all"), *[F.when(c, name) for name, c in tags.items()]))
    return rows.select("duration_ms", F.explode(named).alias("subset")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("duration_ms").cast("decimal(20,6)")).cast("double").alias("total"))


#: A word of two senses in the given texts, and cues for either within four words or right after it.
SENSE = {"word": "the", "a": ["in", "of"], "b": ["to", "and"], "after_a": ["thing", "stone"], "after_b": ["river"]}
_W = "list_transform(regexp_extract_all(text, '" + WORD.replace("'", "''") + "'), lambda w: lower(translate(w, 'Iİ', 'ıi')))"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), k AS (SELECT * FROM t WHERE w[i] = 'the'),
s AS (SELECT doc_id, i, list_has_any(w[greatest(i - 4, 1):i + 4], ['in', 'of']) OR coalesce(w[i + 1] IN ('thing', 'stone'), false) AS a, list_has_any(w[greatest(i - 4, 1):i + 4], ['to', 'and']) OR coalesce(w[i + 1] IN ('river'), false) AS b FROM k)
SELECT doc_id, CASE WHEN a AND b THEN 'conflict' WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'uncertain' END AS sense, count(*) AS n FROM s GROUP BY 1, 2""")
def word_senses(spark, d):
    """The sense of every use of a word, by cues around it: one in conflict or without a cue stays open."""
    low = F.transform(words(F.col("text")), lambda w: F.lower(F.translate(w, "Iİ", "ıi")))
    docs = table(spark, d, "documents").select("doc_id", low.alias("w"))
    uses = docs.select("doc_id", "w", F.explode(F.filter(F.transform("w", lambda x, i: F.when(x == SENSE["word"], i + 1)), lambda i: i.isNotNull())).alias("i"))
    start = F.greatest(F.col("i") - 4, F.lit(1))
    near = F.slice("w", start, F.col("i") + 5 - start)
    after = F.get("w", F.col("i"))
    cue = lambda s: F.arrays_overlap(near, F.array(*map(F.lit, SENSE[s]))) | F.coalesce(after.isin(SENSE[f"after_{s}"]), F.lit(False))
    a, b = cue("a"), cue("b")
    sense = F.when(a & b, "conflict").when(a, "a").when(b, "b").otherwise("uncertain")
    return uses.groupBy("doc_id", sense.alias("sense")).agg(F.count(F.lit(1)).alias("n"))


_CLASS = f"CASE WHEN expected IN {sql_list(P.VOWELS)} THEN 'vowel' WHEN expected IN {sql_list(P.STOPS)} THEN 'stop' WHEN expected IN {sql_list(P.AFFRICATES)} THEN 'affricate' WHEN expected IN {sql_list(P.SONORANTS)} THEN 'sonorant' ELSE 'fricative' END"


@query(f"""WITH r AS (SELECT *, {_CLASS} AS c FROM {INSTANCES}), g AS (SELECT id, c AS class, list_filter([CASE WHEN duration_ms < 20 AND c NOT IN ('stop', 'affricate') THEN 'span_too_short' END, CASE WHEN c IN ('vowel', 'sonorant') AND k % 7 = 0 THEN 'formant_extraction_failed' END,
CASE WHEN list_contains({list(P.VOWEL_LETTERS)}, expected) AND k < 30 THEN 'insufficient_voicing' END, CASE WHEN duration_ms * 0.8 < 15 AND c NOT IN ('stop', 'affricate') THEN 'active_signal_too_short' END], lambda x: x IS NOT NULL) AS r FROM r)
SELECT id, class, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS confidence FROM g""")
def confidence_gate(spark, d):
    rows = instances(spark, d)
    reasons = P.confidence_reasons(F.col("expected"), F.col("duration_ms"), F.col("k") % 7 != 0, F.col("k") / 100, F.col("duration_ms") * 0.8)
    out = rows.select("id", P.phone_class(F.col("expected")).alias("class"), reasons.alias("r"))
    return out.select("id", "class", F.array_join("r", ",").alias("reasons"), F.when(F.size("r") == 0, 1.0).otherwise(0.0).alias("confidence"))


_V = "list_contains(" + str(list(P.VOWEL_LETTERS)) + ", substr({0}, 1, 1))"


@query(f"""WITH r AS (SELECT id, k % 9 <> 0 AS v, {_V.format("expected")} AND (coalesce({_V.format("before")}, false) OR coalesce({_V.format("after")}, false)) AS b FROM {_NEXT})
SELECT id, CASE WHEN NOT v THEN 0.0::DOUBLE WHEN b THEN 0.5 ELSE 1.0 END AS reliability, array_to_string(list_filter([CASE WHEN NOT v THEN 'voiced_edges_undetected' END, CASE WHEN b THEN 'vowel_vowel_neighbour' END], lambda x: x IS NOT NULL), ',') AS notes FROM r""")
def duration_reliability(spark, d):
    reliability, notes = P.duration_notes(F.col("expected"), F.col("before"), F.col("after"), F.col("k") % 9 != 0)
    return with_context(instances(spark, d)).select("id", reliability.alias("reliability"), F.array_join(notes, ",").alias("notes"))


@query(f"""WITH q AS (SELECT expected AS p, quantile_cont(duration_ms, 0.5) AS m, (quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25)) / 1.349 AS s FROM {INSTANCES} GROUP BY 1),
r AS (SELECT id, expected, after, duration_ms * 4 AS span, q.m, q.s, t.m AS sm, t.s AS ss, CASE WHEN q.s > 0 THEN (duration_ms * 4 - q.m) / q.s END AS z FROM {_NEXT} r JOIN q ON q.p = expected LEFT JOIN q t ON t.p = CASE WHEN expected IN {sql_list(P.LONG)} THEN replace(expected, 'ː', '') END),
n AS (SELECT *, CASE WHEN z IS NOT NULL AND expected IN {sql_list(P.LONG)} AND span <= least(CASE WHEN m * 0.75 > 0 THEN m * 0.75 END, CASE WHEN ss > 0 AND sm - 0.5 * ss > 0 THEN sm - 0.5 * ss END) THEN 'short' WHEN z < -2 THEN 'short' WHEN z > 2 THEN 'long' WHEN z IS NOT NULL THEN 'expected' END AS note FROM r)
SELECT id, round(z, 6) AS z, CASE WHEN note = 'long' AND expected IN {sql_list(P.SHORT)} AND span < greatest(CASE WHEN after IN {sql_list(P.SONORANTS)} THEN 175.0 ELSE 320.0 END, CASE WHEN s > 0 THEN m + 4 * s END) THEN 'expected'
WHEN note = 'short' AND expected IN {sql_list(P.LONG)} AND span > CASE WHEN ss > 0 THEN sm + 3 * ss ELSE 320.0 END THEN 'expected' ELSE note END AS note, round(exp(-0.5 * pow(z / 2.0, 2)), 6) AS score FROM n""")
def quantity_cues(spark, d):
    """Lengths against the phone's own distribution and, for long vowels, the short vowel's, with the running check's floors."""
    rows = with_context(instances(spark, d))
    stats = exact_quantiles(rows, ["expected"], "duration_ms", [0.25, 0.5, 0.75])
    stats = stats.select(F.col("expected").alias("phone"), F.struct(F.col("q")[1].alias("median"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("scale")).alias("s"))
    own, short = (stats.select(F.col("phone").alias(f"p{i}"), F.col("s").alias(f"s{i}")) for i in (0, 1))
    rows = rows.join(F.broadcast(own), F.col("expected") == F.col("p0")).join(F.broadcast(short), P.short_of(F.col("expected")) == F.col("p1"), "left")  # at most the inventory
    z, note, score = P.quantity_note(F.col("expected"), F.col("after"), F.col("duration_ms") * 4, F.col("s0"), F.col("s1"))
    return rows.select("id", F.round(z, 6).alias("z"), note.alias("note"), F.round(score, 6).alias("score"))


@query(f"""SELECT id, provider, duration_ms FROM {INSTANCES} WHERE provider IN ('p0', 'p2') AND status = 'correct' AND confidence >= 0.25 AND duration_ms BETWEEN 10 AND 60""")
def feature_scan(spark, d):
    """Of the wanted columns those that exist, under the filters that a loader pushes down."""
    rows = instances(spark, d)
    wanted = [c for c in ("id", "provider", "duration_ms", "f1_hz", "vot_ms") if c in rows.columns]
    return rows.where(F.col("provider").isin("p0", "p2") & (F.col("status") == "correct") & (F.col("confidence") >= 0.25) & F.col("duration_ms").between(10, 60)).select(*wanted)


@query("""SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN text IS NULL OR trim(text) = '' THEN 'missing' WHEN lang <> 'en' THEN 'other_split' ELSE 'keep' END AS outcome, coalesce(nullif(trim(source), ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1, 2""")
def manifest_filter(spark, d):
    """What a manifest keeps, and how much it skips for each reason (the first that applies)."""
    docs = table(spark, d, "documents")
    outcome = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 20_000, "long").when(F.col("text").isNull() | (F.trim("text") == ""), "missing").when(F.col("lang") != "en", "other_split").otherwise("keep")
    return docs.groupBy(outcome.alias("outcome"), empty_as(F.col("source"), "unknown").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT id, CASE WHEN k % 4 = 0 THEN expected || ' ' || coalesce(observed, '') END AS c1, CASE WHEN k % 4 = 1 THEN '' WHEN k % 4 = 2 THEN '["' || expected || '"]' END AS c2, expected AS c3 FROM {INSTANCES})
SELECT id, coalesce(array_to_string(nullif(list_filter(string_split(trim(c1), ' '), lambda x: x <> ''), []), '-'), array_to_string(nullif(CAST(json_extract_string(nullif(c2, ''), '$[*]') AS VARCHAR[]), []), '-'), c3) AS target FROM r""")
def first_targets(spark, d):
    """The first column that holds phones, each read in its own way: words, a JSON array, a single phone."""
    rows = instances(spark, d)
    c1 = F.when(F.col("k") % 4 == 0, F.concat("expected", F.lit(" "), F.coalesce("observed", F.lit(""))))
    c2 = F.when(F.col("k") % 4 == 1, "").when(F.col("k") % 4 == 2, F.concat(F.lit('["'), "expected", F.lit('"]')))
    some = lambda a: F.when(F.size(a) > 0, a)
    split = some(F.filter(F.split(F.trim(c1), " "), lambda x: x != ""))
    parsed = some(F.from_json(F.nullif(c2, F.lit("")), "array<string>"))
    return rows.select("id", F.array_join(F.coalesce(split, parsed, F.array("expected")), "-").alias("target"))


@query(f"""SELECT status, round(sum(CASE WHEN confidence IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS null_rate, count(*) AS n, printf('%.2f%%', 100.0 * sum(CASE WHEN confidence IS NULL THEN 1 ELSE 0 END) / count(*)) AS shown FROM {INSTANCES} GROUP BY status""")
def formatted_rates(spark, d):
    """Rates as numbers for machines and as text for reports."""
    per = instances(spark, d).groupBy("status").agg(F.sum(F.when(F.col("confidence").isNull(), 1).otherwise(0)).alias("k"), F.count(F.lit(1)).alias("n"))
    rate = rate_or_null(F.col("k"), F.col("n"))
    return per.select("status", F.round(rate, 4).alias("null_rate"), "n", F.format_string("%.2f%%", 100 * rate).alias("shown"))


_NOTE = "CASE k % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'expected' END"
_LENGTH_ONLY = f"replace(expected, 'ː', '') = replace(observed, 'ː', '') AND expected <> observed AND k % 2 = 0"
_TIMED = f"CASE WHEN NOT ({_LENGTH_ONLY}) THEN s WHEN (contains(expected, 'ː') AND {_NOTE} IN ('long', 'expected')) OR (NOT contains(expected, 'ː') AND {_NOTE} IN ('short', 'expected')) THEN greatest(s, 0.90) ELSE least(s, 0.58) END"


@query(f"""WITH inv AS (SELECT * FROM {inventory_sql()}), r AS (SELECT i.id, i.expected, i.observed, i.k, round({likeness_sql("a", "b")}, 6)::DOUBLE AS s FROM {INSTANCES} i JOIN inv a ON a.phone = i.expected JOIN inv b ON b.phone = i.observed), t AS (SELECT *, {_TIMED} AS u FROM r)
SELECT id, s AS likeness, round(CASE WHEN expected = observed THEN u WHEN k % 5 = 0 AND k % 2 = 0 THEN least(u + 0.07, 0.95) WHEN k % 5 = 0 AND k <= 45 THEN greatest(u - 0.05, 0) WHEN k % 5 = 1 AND k % 2 = 0 THEN greatest(u - 0.05, 0) ELSE u END, 6) AS adjusted FROM t""")
def contrast_likeness(spark, d):
    """Likeness of what was expected and what was observed, after evidence of duration and of a contrast."""
    rows = instances(spark, d).where("observed IS NOT NULL").join(F.broadcast(phonetics.likeness_table(spark).withColumnRenamed("target", "expected")), ["expected", "observed"])  # a dictionary
    k = F.col("k")
    note = F.when(k % 3 == 0, "short").when(k % 3 == 1, "long").otherwise("expected")
    timed = phonetics.with_duration(F.col("likeness"), F.col("expected"), F.col("observed"), note, k % 2 == 0)
    to = F.when(k % 5 == 0, F.col("expected")).when(k % 5 == 1, F.col("observed"))
    candidates = F.array(F.struct(to.alias("to"), (k % 2 == 0).alias("passed"), ((k - 50) / 100).alias("margin")))
    return rows.select("id", "likeness", F.round(phonetics.with_contrasts(timed, F.col("expected"), F.col("observed"), candidates), 6).alias("adjusted"))


@query(f"""WITH q AS (SELECT expected AS p, quantile_cont(duration_ms, 0.5) AS m, (quantile_cont(duration_ms, 0.75) - quantile_cont(duration_ms, 0.25)) / 1.349 AS s FROM {INSTANCES} GROUP BY 1), x AS (SELECT i.*, {_CLASS} AS class, CASE WHEN q.s > 0 THEN (duration_ms - q.m) / q.s END AS z FROM {INSTANCES} i JOIN q ON q.p = i.expected),
g AS (SELECT *, duration_ms < 20 AND class NOT IN ('stop', 'affricate') OR class IN ('vowel', 'sonorant') AND k % 7 = 0 OR list_contains({list(P.VOWEL_LETTERS)}, expected) AND k < 30 OR duration_ms * 0.8 < 15 AND class NOT IN ('stop', 'affricate') AS gated FROM x),
r AS (SELECT segment, CASE WHEN observed IS NULL THEN 'missing' WHEN gated THEN 'unscored' WHEN observed <> expected THEN 'incorrect' WHEN abs(z) > 2 THEN 'length' ELSE 'correct' END AS verdict, CASE WHEN NOT gated AND observed IS NOT NULL THEN CASE WHEN observed = expected THEN exp(-0.5 * pow(z / 2, 2)) ELSE 0.0 END END AS score FROM g)
SELECT segment, count(*) AS n, count(CASE WHEN verdict = 'correct' THEN 1 END) AS correct, count(CASE WHEN verdict = 'incorrect' THEN 1 END) AS incorrect, count(CASE WHEN verdict = 'missing' THEN 1 END) AS missing, count(CASE WHEN verdict = 'length' THEN 1 END) AS length, count(CASE WHEN verdict = 'unscored' THEN 1 END) AS unscored, round(100 * CAST(sum(CAST(score AS DECIMAL(20,9))) AS DOUBLE) / nullif(count(score), 0), 4) AS score FROM r GROUP BY 1""")
def coach_report(spark, d):
    """From instances to a segment's report in one plan: gates, lengths against the phone's distribution, verdicts, scores."""
    rows = instances(spark, d)
    q = exact_quantiles(rows, ["expected"], "duration_ms", [0.25, 0.5, 0.75])
    stats = q.select("expected", F.col("q")[1].alias("m"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("s"))
    rows = rows.join(F.broadcast(stats), "expected")  # at most the inventory
    gated = F.size(P.confidence_reasons(F.col("expected"), F.col("duration_ms"), F.col("k") % 7 != 0, F.col("k") / 100, F.col("duration_ms") * 0.8)) > 0
    rows = rows.withColumn("z", F.when(F.col("s") > 0, (F.col("duration_ms") - F.col("m")) / F.col("s"))).withColumn("gated", gated)
    same = F.col("observed") == F.col("expected")
    verdict = F.when(F.col("observed").isNull(), "missing").when(F.col("gated"), "unscored").when(~same, "incorrect").when(F.abs("z") > 2, "length").otherwise("correct")
    score = F.when(~F.col("gated") & F.col("observed").isNotNull(), F.when(same, F.exp(-0.5 * F.pow(F.col("z") / 2, F.lit(2.0)))).otherwise(0.0))
    rows = rows.select("segment", verdict.alias("verdict"), score.alias("score"))
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v)
    mean = F.try_divide(F.sum(F.col("score").cast("decimal(20,9)")).cast("double"), F.count("score"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[n(v) for v in ("correct", "incorrect", "missing", "length", "unscored")], F.round(100 * mean, 4).alias("score"))


_BASE = "coalesce(list_extract({v}, list_position({k}, regexp_replace({{0}}, '[ːʰ]$', ''))), regexp_replace({{0}}, '[ːʰ]$', ''))".format(v=list(P.VARIANTS.values()), k=list(P.VARIANTS))


@query(f"""WITH r AS (SELECT provider, status, confidence AS score, coalesce(expected <> observed AND {_BASE.format("expected")} = {_BASE.format("observed")}, false) AS variant, coalesce(expected IN {sql_list(P.VOWELS)} AND observed IN {sql_list(P.VOWELS)}, false) AS vowels FROM (SELECT provider, status, confidence, expected, CASE WHEN k % 6 = 0 AND status = 'incorrect' THEN {_BASE.format("expected")} ELSE observed END AS observed FROM {INSTANCES})),
k AS (SELECT *, vowels AND NOT variant AS v, NOT variant AND coalesce(score < 0.3, false) AS far FROM r),
b AS (SELECT provider, unnest(['baseline', 'allophonic', 'vowel_trust', 'vowel_trust_miss', 'vowel_or_far_cons', 'vowel_or_far_cons_miss']) AS band, unnest([status IN ('incorrect', 'missing'), status = 'incorrect' AND NOT variant OR status = 'missing', status = 'incorrect' AND v OR status = 'missing', status = 'incorrect' AND v, status = 'incorrect' AND (v OR far) OR status = 'missing', status = 'incorrect' AND (v OR far)]) AS hit FROM k)
SELECT provider, band, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS n_flagged FROM b GROUP BY 1, 2""")
def safety_bands(spark, d):
    """What six policies flag, from all that is wrong or missing to vowels only; some observed phones are surface variants."""
    observed = F.when((F.col("k") % 6 == 0) & (F.col("status") == "incorrect"), P.phonemic_base(F.col("expected"))).otherwise(F.col("observed"))
    rows = instances(spark, d).withColumn("seen", observed)
    flags = P.bands(F.col("status"), F.col("expected"), F.col("seen"), F.col("confidence"))
    per = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("int")).alias(name) for name, c in flags.items()])
    return per.unpivot(["provider", "n"], list(flags), "band", "n_flagged")


@query(f"""WITH r AS (SELECT id, CASE WHEN k % 3 = 0 THEN 'seen; ref_feature_id=' || (id * 7) || ' ok' WHEN k % 3 = 1 THEN 'ref_feature_id=' ELSE 'none' END AS notes FROM {INSTANCES} WHERE (id - 1) % 7 IN (1, 4)) SELECT id, CASE WHEN notes LIKE '%ref_feature_id=_%' THEN id * 7 END AS ref FROM r""")
def shard_rows(spark, d):
    """The rows of shards 2 and 5 of 7, and the ids that their notes refer to."""
    k, id_ = F.col("k"), F.col("id")
    notes = F.when(k % 3 == 0, F.concat(F.lit("seen; ref_feature_id="), (id_ * 7).cast("string"), F.lit(" ok"))).when(k % 3 == 1, "ref_feature_id=").otherwise("none")
    return instances(spark, d).where(N.in_shard(id_, "5,2/7")).select("id", N.noted_id(notes).alias("ref"))


@query(f"""WITH r AS (SELECT id, id % 6 AS c, expected AS a, coalesce(observed, 'k') AS b FROM {INSTANCES}) SELECT id, CASE WHEN c = 5 THEN '' WHEN c IN (1, 2, 4) THEN a || '-ˈ-' || b ELSE a || '-' || b END AS target FROM r""")
def first_of_five_targets(spark, d):
    """Phones from the first of five columns that isn't blank; columns of tokens and of transcriptions are read each in their way."""
    a, b = F.col("expected"), F.replace(F.coalesce("observed", F.lit("k")), F.lit("ɡ"), F.lit("g"))
    tokens, ipa = F.concat(F.lit(" "), a, F.lit("  "), b), F.concat(F.lit("/"), a, F.lit(".ˈ"), b, F.lit("/"))
    c = [F.when(F.col("id") % 6 == i, ipa if i in (1, 2, 4) else tokens).otherwise(F.lit(" ") if i % 2 else F.lit(None)) for i in range(5)]
    return instances(spark, d).select("id", F.array_join(g2p.target_phones(*c), "-").alias("target"))
