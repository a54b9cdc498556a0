"""Tables made of parts, each of which counts from the moment it is published: appends that are whole or absent, and can be repeated.

path/parts/<part>: Parquet. path/manifest/<name>: one line, the part that stands under that name. A part is written first,
then its manifest; a run that is killed leaves a part that no manifest names. Publishing under a name again replaces what
stood there. Any store that Spark writes to will do: a manifest that isn't whole yet doesn't count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """{name: part} of what is published, one entry a run or batch; empty where there is nothing yet.

    Only the absence of the folder means that: any other failure to read it is raised.
    """
    store, folder = _store(spark, f"{path}/manifest")
    if not store.exists(folder):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(folder) if f.isFile()]
    if not names:
        return {}
    rows = spark.read.schema("value string").text([f"{path}/manifest/{n}" for n in sorted(names)]).select(F.input_file_name().alias("file"), "value").collect()
    return {r["file"].rsplit("/", 1)[1]: r["value"].removesuffix(".") for r in rows if r["value"].endswith(".")}


def publish(df: DataFrame, path: str, name: str) -> str:
    """Writes a part and puts it under a name (letters, digits, '-'); what stood there goes."""
    spark = df.sparkSession
    if not name or not name.replace("-", "").isalnum():
        raise ValueError(f"not a name: {name!r}")
    part = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/parts/{part}")
    before = manifest(spark, path).get(name)
    store, file = _store(spark, f"{path}/manifest/{name}")
    out = store.create(file, True)
    out.write(bytearray(f"{part}.\n".encode()))
    out.close()
    if before:
        store.delete(_store(spark, f"{path}/parts/{before}")[1], True)
    return part


def published(spark: SparkSession, path: str, schema: T.StructType | str, names: Callable[[str], bool] = lambda name: True) -> DataFrame:
    """All rows of the published parts (under the names asked for), with the name as column _part."""
    parts = {n: p for n, p in manifest(spark, path).items() if names(n)}
    empty = spark.createDataFrame([], schema)
    if not parts:
        return empty.withColumn("_part", F.lit(None).cast("string"))
    rows = spark.read.schema(empty.schema).parquet(*[f"{path}/parts/{p}" for p in parts.values()])
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("_part", F.regexp_replace(folder, "-[0-9a-f]{32}$", ""))


def compute_missing(df: DataFrame, keys: list[str], cache: str, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Results for all keys, from a cache where it has them; the others are computed and published first.

    A run that fails or is killed adds nothing; a cache that can't be read raises. Two runs at once may compute the same
    keys: the rows of the part that sorts first count.
    """
    spark = df.sparkSession
    known = published(spark, cache, schema)
    missing = df.join(known.select(*keys).distinct(), keys, "left_anti")
    found = compute(missing)
    if not missing.isEmpty():
        publish(found, cache, uuid.uuid4().hex)
    rows = published(spark, cache, schema)
    first = rows.groupBy(*keys).agg(F.min("_part").alias("_part")).join(df.select(*keys).distinct(), keys, "left_semi")
    return rows.join(first, [*keys, "_part"], "left_semi").drop("_part")


def append_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], run: str, compute: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Appends each row of a stream once: a batch stands under the run and its number, so that one that is replayed replaces itself.

    Rows whose keys an earlier batch of the run has published, or that come twice in a batch, are left out before they
    are computed; so a stream that is started anew without its checkpoint, over sources that it has seen, adds nothing.
    run: a hash of all that the results depend on (models, settings); another run computes all anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = f"{run}-{number:012d}"
        spark = batch.sparkSession
        parts = [p for n, p in manifest(spark, path).items() if n.startswith(f"{run}-") and n != own]
        rows = batch.dropDuplicates(keys)
        if parts:
            done = spark.read.parquet(*[f"{path}/parts/{p}" for p in parts]).select(*keys).distinct()
            rows = rows.join(done, keys, "left_anti")
        publish(compute(rows), path, own)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_recordings(df: DataFrame, path: str, name: str) -> None:
    """Adds recordings (id, created_at, payload and what they are looked up by) to an index and to objects by day.

    Both are published under the same name, the index last: what it lists is there.
    """
    day = F.date_format("created_at", "yyyy-MM-dd")
    unsafe = df.where(F.col("id").isNull() | F.col("id").isin("", ".", "..") | F.col("id").rlike(r"[/\\]"))
    if not unsafe.isEmpty():
        raise ValueError("an id must be a file name")
    publish(df.select("id", day.alias("day"), "payload").repartition("day").sortWithinPartitions("day", "id"), f"{path}/objects", name)
    publish(df.withColumn("day", day).drop("payload"), f"{path}/index", name)


def list_recordings(spark: SparkSession, path: str, schema: str, limit: int = 100, where: str = "true") -> DataFrame:
    """The newest recordings that a condition holds for, newest first."""
    return published(spark, f"{path}/index", schema).drop("_part").where(where).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def open_recording(spark: SparkSession, path: str, schema: str, id_: str) -> str:
    """A recording's payload: its day and part from the index, so that one part's row groups of that day are read. The latest of several."""
    if id_ in ("", ".", "..") or "/" in id_ or "\\" in id_:
        raise ValueError("an id must be a file name")
    at = published(spark, f"{path}/index", schema).where(F.col("id") == id_).orderBy(F.desc("created_at")).first()
    if at is None:
        raise FileNotFoundError(id_)
    objects = published(spark, f"{path}/objects", "id string, day string, payload string", lambda n: n == at["_part"])
    return objects.where((F.col("day") == at["day"]) & (F.col("id") == id_)).first()["payload"]
