"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A side is broadcast up to so many bytes, as measured.
BROADCAST_BYTES = 32 << 20
#: A key that holds more than this share of all rows is hot; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 5000


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Called by a task that keeps values in its Python worker from batch to batch: what other operators keep there goes.

    Workers live on from stage to stage; without this a pipeline's caches, and what Arrow keeps for its next batches, would add up.
    """
    if others := [n for n in _held if n != owner]:
        for name in others:
            _held.pop(name)()
        pa.default_memory_pool().release_unused()
    _held[owner] = clear


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder. Where none is set, a local master gets a temporary one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="phonolake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def remove(spark: SparkSession, path: str) -> None:
    store, folder = _folder(spark, path)
    store.delete(folder, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """A table that a result is read from goes when the application ends."""
    store, folder = _folder(spark, path)
    store.deleteOnExit(folder)


_inside: ContextVar[str | None] = ContextVar("_inside", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables materialized within are removed at the end, but for those to keep."""
    path = scratch_dir(spark, name)
    token = _inside.set(path)
    try:
        yield
    finally:
        _inside.reset(token)
        remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, inside = df.sparkSession, _inside.get()
    own = keep or not inside
    path = scratch_dir(spark, name) if own else f"{inside}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own:
        remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that the table has already (in whatever case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: str = "text") -> Column:
    """Digest of a text as 16 bytes."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def number_among_equal(df: DataFrame, id_col: str, text_col: str | None, name: str) -> DataFrame:
    """Adds a column that tells apart the rows of one id (and text): a text like '7', or null for rows that are alone.

    Which of several equal rows has which number depends on how they are read; all rows that are alone are the same
    however the table is partitioned.
    """
    same, n, again = free_names(df, "_same", "_n", "_again")
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("null")), *([F.coalesce(F.col(text_col), F.lit(""))] if text_col else [])]
    keyed = df.withColumn(same, F.xxhash64(*parts))
    repeated = keyed.groupBy(same).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(same, F.lit(1).alias(again))
    repeated = materialize(repeated, "repeated-rows")
    numbered = join_on_key(keyed.withColumn(name, F.monotonically_increasing_id().cast("string")), repeated, same)
    return numbered.withColumn(name, F.when(F.col(again).isNotNull(), F.col(name))).drop(same, again)


def hash_sample(df: DataFrame, rows: int, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """About `rows` of the n rows, chosen by a hash of the id; whatever n is, the share is not rounded."""
    return df.where(F.xxhash64(F.lit(seed), id_col).cast("double") / F.lit(2.0**64) + 0.5 < F.lit(min(1.0, rows / max(1, n))))


def bytes_of(df: DataFrame) -> int:
    """About the bytes of a table, measured."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def join_on_key(left: DataFrame, right: DataFrame, key: str | list[str], broadcast_bytes: int = BROADCAST_BYTES, salts: int = 32, how: str = "left") -> DataFrame:
    """Join of a large table, whose keys may be hot, with one row for each key.

    The right side is measured: up to broadcast_bytes it is broadcast, beyond them the left rows are salted (by where
    they are read, so that equal rows part as well) and the right rows repeated for each salt, so that no key meets
    in one task.
    """
    if bytes_of(right) <= broadcast_bytes:
        return left.join(F.broadcast(right), key, how)
    (salt,) = free_names(left, "_salt")
    salted = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*([key] if isinstance(key, str) else key), salt], how).drop(salt)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], sizes: DataFrame, how: str = "left") -> DataFrame:
    """Join of rows with one row for each key, where few keys are hot and there may be many others.

    sizes: the key, n (rows of the left side). Keys with more than HOT_SHARE of all rows, a bounded number of them, are
    broadcast with their right rows (or salted, if these are large); the others are joined by a shuffle in which none
    is large.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    keys = [key] if isinstance(key, str) else key
    hot = sizes.where(F.col("n") > max(1000, int(total * HOT_SHARE))).select(*keys)
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = materialize(hot, "hot-keys")
    own = right.join(F.broadcast(hot), keys, "left_semi")
    some = left.join(F.broadcast(hot), keys, "left_semi")
    some = some.join(F.broadcast(own), keys, how) if how == "left_semi" else join_on_key(some, own, keys, how=how)
    return some.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))
