"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonolake.llm import forest, mixing, packing, suffixes, toxicity
from phonolake.llm.common import documents, remove, remove_at_exit, scratch_dir
from phonolake.session import ship

#: A repeated passage is cut if it has over so many words.
PASSAGE_WORDS = 50
#: Passages are looked for from so many bytes on, which hardly any 51 words fall short of.
PASSAGE_BYTES = 192
#: Distinct words that a packing worker remembers, twice so many at most: here it runs beside an executor whose heap earlier stages have filled.
PACKING_WORDS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier marks as toxic go."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    ship(spark)
    return forest.one_of_each(docs).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur again anywhere are cut out of all texts; every document stays, with what is left of it."""
    ship(spark)
    return suffixes.without_repeats(docs, PASSAGE_BYTES, over_words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights by Poisson replication: documents repeat, or leave, by it."""
    return mixing.mix(docs).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048; one row for each piece of a document."""
    ship(spark)
    return packing.pack(docs, max_units=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't tell the stages' models and signatures; tests hold each stage against a plain version of what it decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written, the last one's when the application ends."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), scratch_dir(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    remove_at_exit(spark, before)
    return docs
