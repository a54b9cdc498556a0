"""Report operators: rates, posteriors over spans, confusions, lexicon checks, token maps, alignments as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rate_or_null


def rates(df: DataFrame, by: list[Column], flags: dict[str, Column]) -> DataFrame:
    """Rows of each group and the shares (four digits) of those with a flag."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("total"), *[F.round(rate_or_null(F.sum(F.when(c, 1).otherwise(0)), n), 4).alias(name) for name, c in flags.items()])


def log_softmax(rows: DataFrame, frame: list[str], score: str) -> DataFrame:
    """Adds logp to long rows of a frame's scores: two windows over the frame, which has as many rows as there are tokens."""
    w = Window.partitionBy(*frame)
    rows = rows.withColumn("_m", F.max(score).over(w))
    return rows.withColumn("logp", F.col(score) - F.col("_m") - F.log(F.sum(F.exp(F.col(score) - F.col("_m"))).over(w))).drop("_m")


def _overlapping(frames: DataFrame, spans: DataFrame, key: str, bin_ms: int = 200) -> DataFrame:
    """Rows of frames (s, e) that overlap a span (a, b) of the same key. Both are dealt out by time bins as well, so that a
    long utterance is spread; a pair counts in the bin where its overlap starts."""
    bins = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / bin_ms), F.floor((F.col(y) - 1) / bin_ms)))
    joined = frames.withColumn("_bin", bins("s", "e")).join(spans.withColumn("_bin", bins("a", "b")), [key, "_bin"])
    return joined.where("s < b AND e > a").where(F.floor(F.greatest("s", "a") / bin_ms) == F.col("_bin")).drop("_bin")


def span_candidates(frames: DataFrame, spans: DataFrame, key: str, k: int) -> DataFrame:
    """The k likeliest tokens of each span by mean posterior over its frames. frames: key, s, e, token, logp; spans: key, span, a, b."""
    per = _overlapping(frames, spans, key).groupBy(key, "span", "token").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.exp("logp")).alias("_t"))
    per = per.select(key, "span", "token", "n_frames", F.round(F.col("_t") / F.col("n_frames"), 6).alias("probability"))
    rank = F.row_number().over(Window.partitionBy(key, "span").orderBy(F.desc("probability"), "token"))
    return per.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def peak_frames(frames: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Of each span the frame (s) where the span's target is likeliest, the first among equals, and the likeliest token there."""
    rows = _overlapping(frames, spans, key).withColumn("_l", F.round("logp", 9))
    per = rows.groupBy(key, "span", "s").agg(
        F.max(F.when(F.col("token") == F.col("target"), F.col("logp"))).alias("target_logprob"),
        F.min(F.struct((-F.col("_l")).alias("l"), "token", "logp")).alias("best"),
    )
    best = per.where(F.col("target_logprob").isNotNull()).groupBy(key, "span").agg(F.min(F.struct((-F.round("target_logprob", 9)).alias("l"), "s", "target_logprob", "best")).alias("x"))
    n = rows.groupBy(key, "span").agg(F.countDistinct("s").alias("n_frames"))
    return best.join(n, [key, "span"]).select(key, "span", F.col("x.s").alias("peak_ms"), F.round("x.target_logprob", 6).alias("target_logprob"), F.round("x.best.logp", 6).alias("best_logprob"), F.col("x.best.token").alias("observed"), "n_frames")


def confusions(ops: DataFrame, k: int) -> DataFrame:
    """Per token of the reference: uses, matches, substitutions, deletions, error rate and its k commonest confusions. ops: e (op, target, predicted)."""
    per = ops.where("e.op <> 'insertion'").groupBy(F.col("e.target").alias("token"), F.col("e.op").alias("op"), F.col("e.predicted").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    n = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0))
    counts = per.groupBy("token").agg(F.sum("n").alias("ref_count"), n("match").alias("correct"), n("substitution").alias("substituted"), n("deletion").alias("deleted"))
    counts = counts.withColumn("error_rate", F.round(rate_or_null(F.col("substituted") + F.col("deleted"), F.col("ref_count")), 4))
    w = Window.partitionBy("token").orderBy(F.desc("n"), "predicted")
    top = per.where("op = 'substitution'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    top = top.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "predicted", "n"))), lambda x: F.concat_ws(":", x["predicted"], x["n"].cast("string"))), " ").alias("top_confusions"))
    return counts.join(top, "token", "left")


def top_substitutions(ops: DataFrame, by: str, k: int) -> DataFrame:
    """The k commonest substitutions of each group."""
    per = ops.where("e.op = 'substitution'").groupBy(by, F.col("e.target").alias("target"), F.col("e.predicted").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "target", "predicted")).cast("long")).where(F.col("rank") <= k)


def lexicon_checks(word: str, kind: Column, tokens: Column, kinds: list[str], inventory: list[str]) -> Column:
    """Array of what is wrong with an entry; the column `repeated` tells whether its word occurs again."""
    odd = F.size(F.filter(tokens, lambda t: (t != "") & ~t.isin(inventory))) > 0
    blank = F.col(word).isNull() | (F.col(word) == "")
    return F.array_compact(F.array(F.when(blank, "empty_word"), F.when(F.col("repeated"), "duplicate_word"), F.when(~kind.isin(kinds), "unknown_type"), F.when(odd, "unknown_token")))


def token_diagnostics(ops: DataFrame, shorter: dict[str, str]) -> DataFrame:
    """Per token of interest: uses, matches, substitutions, deletions, insertions, error rate, and how often it became its shorter
    form. shorter: the tokens and their shorter forms (an empty one: none). ops: e (op, target, predicted)."""
    token = F.coalesce("e.target", "e.predicted")  # an insertion is one of what it inserts
    short = F.create_map(*[F.lit(x) for kv in shorter.items() for x in kv])
    rows = ops.where(token.isin(list(shorter))).groupBy(token.alias("token"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    op = F.col("e.op")
    shortened = F.coalesce((op == "substitution") & (F.col("e.predicted") == F.try_element_at(short, "e.target")), F.lit(False))
    out = rows.agg(n(op != "insertion").alias("ref_count"), n(op == "match").alias("correct"), n(op == "substitution").alias("substituted"), n(op == "deletion").alias("deleted"), n(op == "insertion").alias("inserted"), n(shortened).alias("shortened"))
    share = lambda c: F.round(rate_or_null(c, F.nullif(F.col("ref_count"), F.lit(0))), 4)
    return out.withColumns({"error_rate": share(F.col("substituted") + F.col("deleted")), "shortened_rate": share(F.col("shortened"))})


def merge_maps(df: DataFrame, entries: str) -> DataFrame:
    """Adds merged: a map of the normalised keys to their greatest values. entries: array of (key, value); null values count as absent."""
    known = F.filter(F.transform(entries, lambda e: F.struct(F.lower(F.trim(e[e_key(df, entries, 0)])).alias("k"), e[e_key(df, entries, 1)].alias("v"))), lambda e: e["v"].isNotNull())
    keys = F.array_distinct(F.transform(known, lambda e: e["k"]))
    best = F.transform(keys, lambda k: F.array_max(F.transform(F.filter(known, lambda e: e["k"] == k), lambda e: e["v"])))
    return df.withColumn("merged", F.map_from_arrays(keys, best))


def e_key(df: DataFrame, column: str, i: int) -> str:
    return df.schema[column].dataType.elementType.fields[i].name


def map_argmax(m: Column) -> Column:
    """token, value of the greatest value; the least key among equals."""
    best = F.array_min(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.struct(best["k"].alias("token"), (-best["v"]).alias("value"))


PHONES_JSON = "struct<schema_version: int, phones: array<struct<expected_phone: string, observed_model_phone: string, start_ms: bigint, end_ms: bigint, confidence: double>>>"
SUMMARY_JSON = "struct<phone_count: int, mean_confidence: double, start_ms: bigint, end_ms: bigint>"


def build_alignments(rows: DataFrame, by: str) -> DataFrame:
    """by, alignment_json, summary_json of each segment's instances in order of start and id."""
    phone = F.struct("start_ms", "id", F.struct(F.col("expected").alias("expected_phone"), F.col("observed").alias("observed_model_phone"), "start_ms", "end_ms", "confidence").alias("p"))
    mean = F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("confidence")
    per = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(phone)), lambda x: x["p"]).alias("phones"), mean.alias("mean_confidence"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    summary = F.struct(F.size("phones").alias("phone_count"), "mean_confidence", "start_ms", "end_ms")
    return per.select(by, F.to_json(F.struct(F.lit(1).alias("schema_version"), "phones")).alias("alignment_json"), F.to_json(summary).alias("summary_json"))


def read_alignments(df: DataFrame, by: str) -> DataFrame:
    return df.select(by, F.from_json("alignment_json", PHONES_JSON).alias("a"), F.from_json("summary_json", SUMMARY_JSON).alias("s")).select(by, "s.*", "a.phones")
