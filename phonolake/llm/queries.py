"""The queries of this subpackage, each an operator applied to its whole table, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, fingerprints, forest, gif, langid, mixing, neighbours, packing, periods, records, sharding, suffixes, toxicity
from .common import documents


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _fold(n: int) -> Column:
    """crc32 of the id as text, mod n; ids that are null are in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_marginal_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "mix_n", "mix_copy", "mix_key")


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return placed.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_frames(gif.store_texts(documents(spark, sf_dir))).drop("frames")


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = records.encode_to_folder(documents(spark, sf_dir))
    read = records.read_shuffled(spark, folder, records.with_starts(index))
    return read.select("doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op11_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("filter")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold few long runs, so every tenth document is made periodic first (periods.plant)."""
    found = periods.collapse_runs(documents(spark, sf_dir), periods.plant)
    longest = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = neighbours.score(docs, neighbours.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pack_best_fit, op2_prefix_free_dedup, op3_marginal_unigram_langid, op4_poisson_mixing, op5_quartile_digest, op6_two_pass_shuffle, op7_gif_columns, op8_binary_records, op9_compression_toxicity, op10_lsh_forest, op11_survival_words, op12_periodic_runs, op13_neighbour_votes)
}
ORACLE_SQL: dict[str, str] = {"op4_poisson_mixing": mixing.SQL, "op10_lsh_forest": forest.SQL, "op11_survival_words": audit.SQL}
