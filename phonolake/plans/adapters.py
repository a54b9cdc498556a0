"""Domain views over the tables that are given: phone events, segments, utterance pairs, observations, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phones import PHONES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phone, speaker, provider, duration_ms, start_ms (microseconds since 1970), event_id, k (from the JSON payload)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("phone"), F.col("user_id").alias("speaker"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"), F.col("value").alias("duration_ms"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("start_us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


#: The same view for the comparison in SQL.
PHONE_EVENTS = """(SELECT event_id, event_type AS phone, user_id AS speaker, 'p' || (user_id % 4) AS provider, value AS duration_ms, epoch_us(ts) AS start_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, lang, source, n_chars, quality, toxic."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


OBSERVATIONS = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def _phone(number):
    return F.element_at(F.array(*map(F.lit, PHONES)), (number % len(PHONES) + 1).cast("int"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone instances made from the events: id, segment (the user), provider, expected and observed phone (null: missing),
    status, start_ms, end_ms, duration_ms, confidence (null where k ends in 1), label (a manual one, in all its forms), k."""
    e = phone_events(spark, sf_dir)
    expected, other = _phone(F.col("event_id") * 5), _phone(F.col("event_id") * 5 + F.col("k"))
    observed = F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 3 == 0, other).otherwise(expected)
    start = F.floor(F.col("start_us") / 1000)
    rows = e.select(F.col("event_id").alias("id"), F.col("speaker").alias("segment"), "provider", expected.alias("expected"), observed.alias("observed"), start.alias("start_ms"), (start + F.col("duration_ms").cast("long") + 1).alias("end_ms"), "duration_ms", "k", F.when(F.col("k") % 10 != 1, F.col("k") / 100).alias("confidence"))
    status = F.when(F.col("observed").isNull(), "missing").when(F.col("observed") == F.col("expected"), "correct").when(F.col("k") % 5 == 0, "unscored").otherwise("incorrect")
    forms = [F.col("expected"), F.concat("expected", F.lit(" | reject|x|y")), F.lit(" "), F.lit("uncertain"), F.concat("expected", F.lit("|odd|note")), F.concat("expected", F.lit("| Accepted"))]
    label = F.element_at(F.array(*forms), (F.col("id") % 6 + 1).cast("int"))
    return rows.withColumn("status", status).withColumn("label", label)


_LIST = "[" + ", ".join(f"'{p}'" for p in PHONES) + "]"
INSTANCES = f"""(SELECT *, CASE WHEN observed IS NULL THEN 'missing' WHEN observed = expected THEN 'correct' WHEN k % 5 = 0 THEN 'unscored' ELSE 'incorrect' END AS status,
[expected, expected || ' | reject|x|y', ' ', 'uncertain', expected || '|odd|note', expected || '| Accepted'][id % 6 + 1] AS label FROM (
SELECT event_id AS id, speaker AS segment, provider, {_LIST}[event_id * 5 % 49 + 1] AS expected, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN {_LIST}[(event_id * 5 + k) % 49 + 1] ELSE {_LIST}[event_id * 5 % 49 + 1] END AS observed,
start_us // 1000 AS start_ms, start_us // 1000 + CAST(trunc(duration_ms) AS BIGINT) + 1 AS end_ms, duration_ms, k, CASE WHEN k % 10 <> 1 THEN k / 100.0 END AS confidence FROM {PHONE_EVENTS}))"""


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
