"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on_key, materialize, number_among_equal


def shuffle_to_shards(df: DataFrame, n_shards: int = 8, bucket_bytes: int = 32 << 20, least_buckets: int = 64, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row at a place of a seeded global permutation and deal the places out to n_shards shards.

    Pass one scatters the rows uniformly into buckets of about bucket_bytes by a seeded hash of id and text (and, for
    rows that repeat both, of where they are read, so that no bucket fills with one document). Pass two
    takes one bucket at a time into memory, Fisher-Yates shuffles it and writes it to the shared folder. A row's
    place in the whole is the rows of all buckets before its own plus its place there; the shard is that place modulo
    n_shards and the slot what is left, so that the shards' counts are at most one apart and each one's slots have no gap.
    Returns doc_id, text, bucket, position, shard, slot, read from the written buckets.

    Null texts and ids are kept as they are (nulls first in the order before the shuffle, which only fixes the
    result); repeated rows each get a slot; an empty table gives no rows; other columns are not carried.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    n_buckets = max(least_buckets, -(-total // bucket_bytes))

    def shuffle_bucket(key: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        order = np.random.default_rng([seed, key[0].as_py()]).permutation(len(bucket))  # Fisher-Yates
        return bucket.take(pa.array(order)).append_column("position", pa.array(np.arange(len(bucket))))

    numbered = number_among_equal(rows, "doc_id", "text", "number")
    scattered = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "number"), F.lit(n_buckets)).cast("int")).drop("number")
    shuffled = scattered.groupBy("bucket").applyInArrow(shuffle_bucket, "doc_id long, text string, bucket int, position long")
    buckets = materialize(shuffled, "shards")
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each bucket
    starts = buckets.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("position")
    out = join_on_key(buckets, starts, "bucket")
    return out.withColumn("shard", F.pmod(place, F.lit(n_shards)).cast("int")).withColumn("slot", F.floor(place / n_shards)).drop("_start")
