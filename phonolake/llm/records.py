"""Length-delimited binary records of token ids, with a separate offset index.

A shard file is a run of records; each is framed as
    length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4 bytes), payload, masked CRC-32 of the payload (4 bytes),
all little-endian. A payload is the document's number (8 bytes, signed), a null mark (1 byte), the bytes per id
(1 byte), and the ids. The index of a shard holds one row for each record: file, record, place, length, ids. With it a
reader can open any record by itself, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, remove_at_exit, scratch_dir, text_rows
from .tokens import SPACED_WORDS, default_path, encoder

INDEX = "file string, record int, place long, length long, n_tokens long"
_MASK_DELTA = 0xA282EAD8  # fixed value of the masked-checksum format


def masked(data: bytes) -> int:
    """A checksum that stays sound when data holds checksums itself: rotated by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, place: int) -> tuple[bytes, int]:
    """(payload, place of the next record); raises ValueError for a damaged record."""
    head = bytes(data[place : place + 8])
    (n,), (c,) = struct.unpack("<Q", head), struct.unpack("<I", data[place + 8 : place + 12])
    if c != masked(head):
        raise ValueError(f"damaged length at {place}")
    payload = bytes(data[place + 12 : place + 12 + n])
    if len(payload) != n or struct.unpack("<I", data[place + 12 + n : place + 16 + n])[0] != masked(payload):
        raise ValueError(f"damaged payload at {place}")
    return payload, place + 16 + n


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def write_bytes(uri: str, data: bytes) -> None:
    """Through the store's own file system; a file appears whole or not at all, so a repeated task does no harm."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def write_records(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids, then end_id, in ascending doc_id order, as record files; returns the index.

    Rows are range-partitioned by doc_id and each task writes its range as files of about shard_bytes (one is held
    in memory at a time): part-<task>-<file>.rec, with part-<task>-<file>.idx (Parquet) beside it. Reading the names
    in order reads the documents in order. Ties of doc_id are ordered by text; null ids come first; null and empty
    texts have the end id only; an empty table writes nothing.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        e = encoder(path, SPACED_WORDS)
        width = 2 if max(e.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        me, n = TaskContext.get().partitionId(), 0
        buffer, index = bytearray(), []

        def flush() -> pd.DataFrame:
            nonlocal n, buffer, index
            name = f"part-{me:07d}-{n:05d}"
            out = pd.DataFrame(index, columns=["record", "place", "length", "n_tokens"]).astype({"record": "int32"})
            out.insert(0, "file", f"{name}.rec")
            write_bytes(f"{folder}/{name}.rec", bytes(buffer))
            sink = io.BytesIO()
            pq.write_table(pa.Table.from_pandas(out, preserve_index=False), sink)
            write_bytes(f"{folder}/{name}.idx", sink.getvalue())
            n, buffer, index = n + 1, bytearray(), []
            return out

        for pdf in batches:
            docs = pdf["doc_id"].astype("Int64")
            for i in range(0, len(pdf), 256):
                for d, ids in zip(docs.iloc[i : i + 256], e.encode(pdf["text"].iloc[i : i + 256].tolist()), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    record = frame(serialize(None if d is pd.NA else int(d), ids, width))
                    index.append((len(index), len(buffer), len(record), len(ids)))
                    buffer += record
                    if len(buffer) >= shard_bytes:
                        yield flush()
        if index:
            yield flush()

    return text_rows(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(task, INDEX)


def read_records(spark, folder: str) -> DataFrame:
    """All documents of a folder of record files: file, record, doc_id, token_ids (binary, unsigned 32-bit), n_tokens.

    The files are read by Spark's own reader, so any store will do; every checksum is verified.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, data in zip(pdf["path"], pdf["content"], strict=True):
                name, data, place, k, rows = uri.rpartition("/")[2], memoryview(data), 0, 0, []
                while place < len(data):
                    payload, place = unframe(data, place)
                    doc_id, ids = deserialize(payload)
                    rows.append((name, k, doc_id, ids.tobytes(), len(ids)))
                    k += 1
                    if len(rows) == 1000 or place >= len(data):
                        out = pd.DataFrame(rows, columns=["file", "record", "doc_id", "token_ids", "n_tokens"])
                        yield out.astype({"doc_id": "Int64"})
                        rows = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder).select("path", "content")
    return files.mapInPandas(task, "file string, record long, doc_id long, token_ids binary, n_tokens long")


def read_shuffled(spark, folder: str, index: DataFrame, seed: int = 0, handles: int = 64) -> DataFrame:
    """The records that an index names, opened one by one at their places, in a seeded order over all files.

    Returns the index's columns, doc_id and token_ids. A task holds the index rows of a batch, opens each of its files
    once and reads the places there in ascending order; every checksum is verified.
    """
    (order,) = free_names(index, "_order")
    names, kinds = index.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        open_files: dict = {}
        for pdf in batches:
            found: list = [None] * len(pdf)
            rows = sorted(zip(pdf["file"], pdf["place"], pdf["length"], range(len(pdf)), strict=True))
            for name, place, length, i in rows:
                f = open_files.get(name)
                if f is None:
                    if len(open_files) >= handles:
                        open_files.pop(next(iter(open_files))).close()
                    f = open_files[name] = store.open_input_file(f"{root}/{name}")
                payload, _ = unframe(f.read_at(length, place), 0)
                found[i] = deserialize(payload)
            out = pdf[names].reset_index(drop=True)
            out["doc_id"] = pd.array([d for d, _ in found], dtype="Int64")
            out["token_ids"] = [ids.tobytes() for _, ids in found]
            yield out

    shuffled = index.withColumn(order, F.xxhash64(F.lit(seed), "file", "record")).repartitionByRange(order).sortWithinPartitions(order)
    return shuffled.mapInPandas(task, f"{kinds}, doc_id long, token_ids binary")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start to index rows: the ids of all documents before each one, in file order.

    The sums by file (one row for each file, however many documents there are) are summed on; within a file the window
    is partitioned by the file, which is of a bounded size.
    """
    by_file = index.groupBy("file").agg(F.sum("n_tokens").alias("_in_file"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = by_file.select("file", F.coalesce(F.sum("_in_file").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "file").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def encode_to_folder(df: DataFrame, **kw) -> tuple[str, DataFrame]:
    """Writes to a fresh shared folder; (folder, index)."""
    spark = df.sparkSession
    folder = scratch_dir(spark, "records")
    write_records(df, folder, **kw).write.parquet(f"{folder}/index")
    remove_at_exit(spark, folder)
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")
