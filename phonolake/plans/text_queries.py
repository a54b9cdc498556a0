"""Text, pronunciation and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import g2p, phonetics, sequences
from ..functions import phones as P
from ..functions.exprs import WORD, error_rate, turkish_lower, words
from . import g2p_sql as G
from .adapters import table
from .likeness_sql import inventory_sql, likeness_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_W = "regexp_extract_all(text, '" + WORD.replace("'", "''") + "')"


def document_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_W}) AS word FROM documents) GROUP BY word")
def tokens(spark, d):
    """Uses of each word and documents that have it: a document gives its uses and its distinct words, which are summed alike."""
    w = F.transform(words(F.col("text")), lambda x: F.struct(x.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct(words(F.col("text"))), lambda x: F.struct(x.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    both = table(spark, d, "documents").select(F.inline(F.concat(w, once)))
    return both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("d").alias("n_docs"))


@query(f"SELECT doc_id, array_to_string({_W}, ' ') AS words, len({_W}) AS n_words FROM documents")
def listagg_words(spark, d):
    """All words of a text in their order, joined."""
    w = words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(w, " ").alias("words"), F.size(w).cast("long").alias("n_words"))


_LETTERS = "list_extract([" + ", ".join(f"'{x}'" for x in g2p.PHONES) + "], list_position([" + ", ".join(f"'{x}'" for x in g2p.LETTERS) + "], c))"


@query(f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest({_W}) AS word FROM documents))
SELECT word, replace(list_aggregate(list_filter(list_transform(regexp_split_to_array(lower(translate(word, 'Iİ', 'ıi')), ''), lambda c: CASE WHEN c = 'x' THEN 'ks' ELSE {_LETTERS} END), lambda p: p IS NOT NULL), 'string_agg', ''), '~', '') AS phones FROM w""")
def grapheme_map(spark, d):
    distinct = document_words(spark, d).select("word").distinct()
    phones = g2p.seed(F.col("word"))
    return distinct.select("word", F.when(phones != "", phones).alias("phones"))


_WORDS = f"(SELECT DISTINCT word FROM (SELECT unnest({_W}) AS word FROM documents))"
_COUNTED = f"(SELECT word, count(*) AS n FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY word)"


@query(f"WITH {G.chain(_WORDS)} SELECT word, source, NULL::VARCHAR AS type, coded, {G.spelled('coded')} AS ipa FROM said")
def g2p_full(spark, d):
    """Distinct words with their phones; golden words are tested as well."""
    return g2p.pronounce(document_words(spark, d), "word")


@query(f"WITH {G.chain(_WORDS)} SELECT phone, sum(n)::BIGINT AS n FROM (SELECT n, unnest({G.phones('coded')}) AS phone FROM said JOIN {_COUNTED} USING (word)) WHERE phone <> 'ˈ' GROUP BY phone")
def phone_inventory_counts(spark, d):
    """Phones of all words of the corpus: distinct words are transcribed once and weighted by their counts."""
    n = document_words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    coded = n.select("n", F.explode(g2p.strip_stress(g2p.phones(g2p.transcribe(F.col("word"))))).alias("phone"))
    return coded.groupBy("phone").agg(F.sum("n").alias("n"))


#: User turns (r) with the assistant's answers (h) as lists of words, and their edit distance row by row.
_PAIRS = f"""t AS (SELECT conv_id, turn, role, list_transform({_W}, lambda w: lower(w)) AS tok FROM conversations),
p AS (SELECT a.conv_id * 1000 + a.turn AS id, a.conv_id % 5 AS grp, a.tok AS r, b.tok AS h FROM t a JOIN t b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND b.turn = a.turn + 1 AND len(a.tok) > 0 AND len(b.tok) > 0)"""
_EDITS = """c AS (SELECT id, 0::BIGINT AS i, range(0, len(h) + 1) AS d FROM p
UNION ALL SELECT id, i, list_transform(range(1, len(best) + 1), lambda j: j + list_min(best[1:j])) FROM (
SELECT c.id, c.i + 1 AS i, list_prepend(c.i, list_transform(range(1, len(h) + 1), lambda j: least(c.d[j] + CASE WHEN h[j] = r[c.i + 1] THEN 0 ELSE 1 END, c.d[j + 1] + 1) - j - 1)) AS best FROM c JOIN p USING (id) WHERE c.i < len(r))),
e AS (SELECT p.*, c.d[len(h) + 1] AS edits FROM c JOIN p USING (id) WHERE c.i = len(r))"""




def _path(edit: int, match: int, names: tuple[str, str, str, str]) -> str:
    """The path back through a table of costs (c: id, i, d), a diagonal step first, then one in r, then one in h: o (id, op, target, predicted)."""
    same, other, lost, extra = names
    return f"""c AS (SELECT id, 0::BIGINT AS i, list_transform(range(0, len(h) + 1), lambda j: j * {edit}) AS d FROM p
UNION ALL SELECT id, i, list_transform(range(1, len(best) + 1), lambda j: j * {edit} + list_min(best[1:j])) FROM (
SELECT c.id, c.i + 1 AS i, list_prepend((c.i + 1) * {edit} - {edit}, list_transform(range(1, len(h) + 1), lambda j: least(c.d[j] + CASE WHEN h[j] = r[c.i + 1] THEN {match} ELSE {edit} END, c.d[j + 1] + {edit}) - (j + 1) * {edit})) AS best FROM c JOIN p USING (id) WHERE c.i < len(r))),
b AS (SELECT id, len(r) AS i, len(h) AS j, NULL::VARCHAR AS op FROM p UNION ALL SELECT id, i - CASE WHEN op = '{extra}' THEN 0 ELSE 1 END, j - CASE WHEN op = '{lost}' THEN 0 ELSE 1 END, op FROM (
SELECT b.id, b.i, b.j, CASE WHEN b.i > 0 AND b.j > 0 AND now.d[b.j + 1] = up.d[b.j] + CASE WHEN r[b.i] = h[b.j] THEN {match} ELSE {edit} END THEN CASE WHEN r[b.i] = h[b.j] THEN '{same}' ELSE '{other}' END WHEN b.i > 0 AND now.d[b.j + 1] = up.d[b.j + 1] + {edit} THEN '{lost}' ELSE '{extra}' END AS op
FROM b JOIN p USING (id) JOIN c now ON now.id = b.id AND now.i = b.i LEFT JOIN c up ON up.id = b.id AND up.i = b.i - 1 WHERE b.i > 0 OR b.j > 0)),
o AS (SELECT p.grp, b.op, CASE WHEN op <> '{extra}' THEN r[b.i + 1] END AS target, CASE WHEN op <> '{lost}' THEN h[b.j + 1] END AS predicted FROM b JOIN p USING (id) WHERE op IS NOT NULL)"""


_OPS = f"WITH RECURSIVE {_PAIRS}, {_path(1, 0, ('match', 'substitution', 'deletion', 'insertion'))}"


@query(f"""WITH RECURSIVE {_PAIRS}, {_EDITS} SELECT coalesce(grp::VARCHAR, 'ALL') AS grp, count(*) AS n, sum(edits)::BIGINT AS edits, sum(len(r))::BIGINT AS ref_len, sum(edits)::DOUBLE / sum(len(r)) AS error_rate, count(CASE WHEN edits = 0 THEN 1 END) AS n_exact FROM e GROUP BY ROLLUP (grp)""")
def token_error_rate(spark, d):
    """Edits over reference lengths, of each group and overall, in one aggregation."""
    edits = _pairs(spark, d).select("grp", F.size("r").alias("ref_len"), sequences.token_edits(F.col("r"), F.col("h")).alias("edits"))
    out = edits.rollup("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len"), (F.sum("edits") / F.sum("ref_len")).alias("error_rate"), F.sum((F.col("edits") == 0).cast("int")).alias("n_exact"))
    return out.withColumn("grp", F.coalesce(F.col("grp").cast("string"), F.lit("ALL"))).where("n > 0")


def _pairs(spark, d, *more):
    """User turns with the assistant turn that follows, whole, by one window over the conversation."""
    low = F.transform(words(F.col("text")), lambda w: F.lower(w))
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", low.alias("r"))
    t = t.withColumn("h", F.lead("r").over(w)).withColumn("next", F.lead(F.struct("role", "turn")).over(w))
    t = t.where((F.col("role") == "user") & (F.col("next.role") == "assistant") & (F.col("next.turn") == F.col("turn") + 1))
    t = t.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return t.select((F.col("conv_id") % 5).alias("grp"), "r", "h", *more).where((F.size("r") > 0) & (F.size("h") > 0))


@query(f"{_OPS} SELECT grp, op, target, predicted, count(*) AS n FROM o GROUP BY ALL")
def confusion_pairs(spark, d):
    """Edit operations between turns by kind and tokens; their numbers add up to the edit distances (tested)."""
    ops = _pairs(spark, d).select("grp", F.explode(sequences.align("r", "h")).alias("e"))
    return ops.groupBy("grp", "e.op", "e.target", "e.predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_PAIRS}, {_path(1 << 20, -1, ("correct", "incorrect", "missing", "extra"))} SELECT grp, op AS status, count(*) AS n FROM o GROUP BY ALL""")
def assessment_statuses(spark, d):
    """Statuses of the alignment that keeps the most matches, by group (their numbers are tested)."""
    rows = _pairs(spark, d).select("grp", F.explode(sequences.assess("r", "h")).alias("x"))
    return rows.groupBy("grp", "x.status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {G.chain(_WORDS)}, p AS (SELECT n, list_filter({G.phones('coded')}, lambda t: t <> 'ˈ') AS p FROM said JOIN {_COUNTED} USING (word)), x AS (SELECT n, p, unnest(range(1, len(p))) AS i FROM p), y AS (SELECT p[i] AS target, p[i + 1] AS observed, sum(n)::BIGINT AS n FROM x GROUP BY 1, 2), inv AS (SELECT * FROM {inventory_sql()})
SELECT target, observed, n, round({likeness_sql("a", "b")}, 6)::DOUBLE AS likeness FROM y JOIN inv a ON a.phone = target JOIN inv b ON b.phone = observed""")
def phone_likeness(spark, d):
    """Phones that follow each other in the corpus's words, weighted by counts, with their likeness from the dictionary (its values are tested)."""
    n = document_words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Without a filter on the phones: that would be moved below the count and transcribe every use of a word.
    steps = n.select("n", F.explode(phonetics.neighbours(g2p.strip_stress(g2p.phones(g2p.transcribe(F.col("word")))))).alias("x"))
    per = steps.groupBy("x.target", "x.observed").agg(F.sum("n").alias("n"))
    return per.join(F.broadcast(phonetics.likeness_table(spark)), ["target", "observed"])


@query("""WITH RECURSIVE f AS (SELECT vec_id // 10 AS u, list(list_transform(range(0, 5), lambda k: list_sum(list_transform(range(0, (63 - k) // 5 + 1), lambda j: embedding[j * 5 + k + 1]::DOUBLE))) ORDER BY vec_id) AS x, least(count(*), 5) AS n FROM embeddings GROUP BY 1),
v AS (SELECT u, 1::BIGINT AS t, list_transform(range(0, n), lambda k: CASE WHEN k = 0 THEN x[1][1]::DOUBLE ELSE '-Infinity'::DOUBLE END) AS b, list_transform(range(0, n), lambda k: false) AS came FROM f
UNION ALL SELECT v.u, t + 1, list_transform(range(0, n), lambda k: greatest(b[k + 1], CASE WHEN k = 0 THEN '-Infinity'::DOUBLE ELSE b[k] END) + x[t + 1][k + 1]::DOUBLE), list_transform(range(0, n), lambda k: k > 0 AND b[k] > b[k + 1]) FROM v JOIN f ON f.u = v.u WHERE t < len(x)),
p AS (SELECT u, len(x)::BIGINT AS t, (n - 1)::BIGINT AS k FROM f UNION ALL SELECT p.u, p.t - 1, p.k - v.came[p.k + 1]::BIGINT FROM p JOIN v ON v.u = p.u AND v.t = p.t WHERE p.t > 1)
SELECT u AS utterance, list(k::INTEGER ORDER BY t) AS path FROM p GROUP BY u""")
def viterbi_paths(spark, d):
    """Ten vectors in id order as the frames of an utterance, over as many targets as it has frames, five at most; a target's
    score is the sum of every fifth value (its paths are tested)."""
    one = lambda k: F.aggregate(F.filter("embedding", lambda v, i: i % 5 == k), F.lit(0.0), lambda s, v: s + v.cast("double"))
    frames = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("utterance")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.array(*[one(k) for k in range(5)]).alias("x")))).alias("f"))
    return frames.select("utterance", sequences.viterbi(F.transform("f", lambda s: s["x"]), F.least(F.size("f"), F.lit(5))).alias("path"))


@query("""SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'license') AND source <> (SELECT min(source) FROM documents)""")
def search_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "lang", "source", "text"))
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("source").alias("first"))  # one row
    return docs.join(F.broadcast(first)).where(F.contains(hay, F.lit("license")) & (F.col("source") != F.col("first"))).select("doc_id", "lang", "source")


@query("""SELECT key, count(*) AS n, sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT))::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key""")
def json_flatten(spark, d):
    pairs = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""SELECT CASE WHEN text LIKE '%password%' THEN 'secret' WHEN length(text) < 60 THEN 'too_short' WHEN lang = 'fr' THEN 'other_language' ELSE 'keep' END AS route, count(*) AS n FROM documents GROUP BY 1""")
def reject_routing(spark, d):
    route = F.when(F.contains("text", F.lit("password")), "secret").when(F.length("text") < 60, "too_short").when(F.col("lang") == "fr", "other_language").otherwise("keep")
    return table(spark, d, "documents").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT source AS value FROM documents ORDER BY value""")
def filter_options(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("value")).distinct().orderBy("value")


@query(f"""SELECT lower(translate(w, 'Iİ', 'ıi')) AS word, count(*) AS n FROM (SELECT unnest({_W}) AS w FROM documents) GROUP BY 1""")
def turkish_lower_counts(spark, d):
    docs = table(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("w"))
    return docs.groupBy(turkish_lower(F.col("w")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_of(spark, d):
    """A lexicon taken from the corpus itself: words with more than 50 uses, their letters as phones, long ones stressed in front."""
    n = document_words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 50").select("word")
    tokens = g2p.phones(g2p.seed(F.col("word")))
    kind = F.when(F.length("word") > 6, "stress").when(F.col("word").endswith("er"), "no_e_open").otherwise("")
    return n.select("word", F.array_join(tokens, " ").alias("phones"), kind.alias("type"), F.lit("").alias("ipa_detail"))


_LEX = f"(SELECT word, CASE WHEN length(word) > 6 THEN 'stress' WHEN ends_with(word, 'er') THEN 'no_e_open' ELSE '' END AS kind FROM {_COUNTED} WHERE n > 50)"


@query(f"WITH {G.chain(_WORDS, _LEX)} SELECT word, source, CASE WHEN source = 'exception' THEN kind END AS type, coded, {G.spelled('coded')} AS ipa FROM said")
def g2p_lexicon(spark, d):
    """Words with a lexicon that goes before the rules: sources, types, phones (golden words are tested, with and without a lexicon)."""
    return g2p.pronounce(document_words(spark, d), "word", lexicon_of(spark, d))


_TURNS = f"(SELECT conv_id * 1000 + turn AS turn_id, text, {_W} AS w FROM conversations)"
_ALLOWED = str([*P.PHONES, P.STRESS, P.SPACE])


@query(f"""WITH {G.chain(f"(SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM {_TURNS}))")}, t AS (SELECT * FROM {_TURNS}), e AS (SELECT turn_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), j AS (SELECT turn_id, i, {G.phones("coded")} AS p, replace({G.spelled("coded")}, '/', '') AS ipa FROM e JOIN said ON word = w[i]),
g AS (SELECT turn_id, flatten(list(CASE WHEN i = 1 THEN p ELSE ['<spc>'] || p END ORDER BY i)) AS tok, '/' || string_agg(ipa, ' ' ORDER BY i) || '/' AS ipa FROM j GROUP BY 1), v AS (SELECT t.turn_id, t.text, t.w, coalesce(tok, []) AS tok, ipa FROM t LEFT JOIN g USING (turn_id)),
y AS (SELECT *, list_filter(list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN NOT list_contains({_ALLOWED}, tok[i]) THEN 'unknown_token:' || tok[i] WHEN tok[i] = '<spc>' AND (i = 1 OR i = len(tok)) THEN 'space_token_boundary' WHEN tok[i] = '<spc>' AND tok[i - 1] = '<spc>' THEN 'consecutive_space_tokens' END), lambda r: r IS NOT NULL) AS why FROM v)
SELECT turn_id, len(tok)::INTEGER AS token_count, ipa, len(why)::INTEGER AS n_warnings, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN len(w) = 0 THEN 'no_word_tokens' ELSE why[1] END AS drop_reason FROM y""")
def training_tokens(spark, d):
    """Whole turns as phones with space tokens, and why a turn is dropped (tested against single words)."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    out = g2p.transcribe_texts(turns, "turn_id", "text")
    return out.select("turn_id", "token_count", "ipa", F.size("warnings").alias("n_warnings"), "drop_reason")


@query(f"""WITH {G.chain(_WORDS)} SELECT 'grapheme_map' AS name, count(*) AS n, count(*)::BIGINT AS n_fired FROM s0 {" ".join(f"UNION ALL SELECT '{name}', count(*), count(CASE WHEN a.x <> b.x THEN 1 END) FROM s{k} a JOIN s{k - 1} b USING (word)" for k, (name, _) in enumerate(G.STEPS, 1))}""")
def g2p_steps(spark, d):
    """How often each rule changes a word of the corpus (tested: the last step gives the transcription)."""
    w = document_words(spark, d).select("word").distinct()
    steps = w.select(F.explode(g2p.trace(F.col("word"))).alias("s"))
    return steps.groupBy("s.name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.fired").cast("int")).alias("n_fired"))


#: Transcriptions as others write them: some phones by another name, and a symbol that is none in every fifth word.
_WRITTEN = "replace(replace({0}, 'ɡ', 'g'), 'd͡ʒ', 'dʒ') || CASE WHEN length(word) % 5 = 0 THEN '§' ELSE '' END"
_NAMES = sorted([*P.PHONES, P.STRESS, "dʒ"], key=len, reverse=True)


@query(f"""WITH {G.chain(_WORDS)}, o AS (SELECT source, word, {_WRITTEN.format(G.spelled("coded"))} AS ipa FROM said),
t AS (SELECT source, unnest(regexp_extract_all(replace(replace(ipa, '/', ''), '.', ''), '{"|".join([*_NAMES, "."])}')) AS t FROM o)
SELECT source, CASE WHEN t = 'g' THEN 'ɡ' WHEN t = 'dʒ' THEN 'd͡ʒ' WHEN list_contains({_NAMES}, t) THEN t ELSE '?' || t END AS phone, count(*) AS n FROM t GROUP BY 1, 2""")
def parsed_ipa(spark, d):
    """The corpus's transcriptions, written another way, parsed again: how often each phone and each unknown symbol is found."""
    w = g2p.pronounce(document_words(spark, d), "word")
    other = F.replace(F.replace("ipa", F.lit("ɡ"), F.lit("g")), F.lit("d͡ʒ"), F.lit("dʒ"))
    p = w.select("source", g2p.parse_ipa(F.concat(other, F.when(F.length("word") % 5 == 0, "§").otherwise(""))).alias("p"))
    found = p.select("source", F.explode(F.concat("p.phones", F.transform("p.unknown", lambda x: F.concat(F.lit("?"), x)))).alias("phone"))
    return found.groupBy("source", "phone").agg(F.count(F.lit(1)).alias("n"))


_SOFT = f"(SELECT DISTINCT translate(word, 'gG', 'ğĞ') AS word FROM {_WORDS} WHERE regexp_matches(word, '[gG]'))"


@query(f"WITH {G.chain(_SOFT)} SELECT word, source, coded FROM said")
def soft_g_words(spark, d):
    """Every word of the corpus that has a g, with a soft g instead (the corpus has none of its own): the rule in all its places."""
    w = document_words(spark, d).where(F.col("word").rlike("[gG]")).select(F.translate("word", "gG", "ğĞ").alias("word"))
    return g2p.pronounce(w, "word").select("word", "source", "coded")


@query(f"""WITH RECURSIVE {_PAIRS}, {_EDITS}, x AS (SELECT grp, len(r) AS n, edits, id FROM e UNION ALL SELECT grp, 0, len(h), id FROM p WHERE id % 3 = 0 UNION ALL SELECT grp, 0, 0, id FROM p WHERE id % 7 = 0)
SELECT grp, count(*) AS n, round(avg(CASE WHEN n > 0 THEN edits / n::DOUBLE WHEN edits = 0 THEN 0.0 ELSE 1.0 END), 9) AS mean_rate, count(CASE WHEN n = 0 THEN 1 END) AS n_empty FROM x GROUP BY 1""")
def empty_reference_rates(spark, d):
    """Mean error rates of single pairs, some of them with an empty reference: wrong, unless nothing was said."""
    # The pairs are read once; an empty reference has as many edits as words were said.
    case = lambda n, e: F.struct(n.cast("int").alias("n"), e.cast("int").alias("e"))
    every = case(F.size("r"), sequences.token_edits(F.col("r"), F.col("h")))
    some, none = (F.when(F.col("id") % k == 0, case(F.lit(0), e)) for k, e in ((3, F.size("h")), (7, F.lit(0))))
    rows = _pairs(spark, d, "id").select("grp", F.inline(F.array_compact(F.array(every, some, none))))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error_rate(F.col("e"), F.col("n"))), 9).alias("mean_rate"), F.sum((F.col("n") == 0).cast("int")).alias("n_empty"))
