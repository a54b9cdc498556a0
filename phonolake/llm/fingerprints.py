"""Locality-sensitive document fingerprints: a quartile bucket digest and its difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_rows

BUCKETS = 256
#: Of the bytes in a sliding window of five, the triplets that are counted: the first with two of the others.
TRIPLETS = [(a, b) for b in range(2, 5) for a in range(1, b)]
#: A difference of this much or more is a likeness of 0; unrelated texts differ by about as much.
MOST_DIFFERENCE = 1.25 * BUCKETS
_tables = np.stack([np.random.default_rng(5 + k).permutation(BUCKETS).astype(np.uint8) for k in range(5)])


def fingerprint(data: bytes) -> bytes:
    """Two bits for each bucket (the quartile of its count among all), then a byte for the length on a log scale.

    A text of under five bytes is filled up with zero bytes for counting.
    """
    t = np.frombuffer(data if len(data) >= 5 else data.ljust(5, b"\0"), np.uint8)
    n = len(t) - 4
    at = [_tables[k][t[k : k + n]] for k in range(5)]
    counts = np.zeros(BUCKETS, np.int64)
    for a, b in TRIPLETS:
        counts += np.bincount(at[0] ^ at[a] ^ at[b], minlength=BUCKETS)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > q).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return packed.tobytes() + bytes([min(255, round(12 * np.log2(len(data) + 1)))])


def difference(a: bytes, b: bytes) -> float:
    """Bucket by bucket the quartiles' distance (a distance of all three counts double), plus the lengths' distance."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    d = sum(_far[np.abs((x[:-1] >> s & 3).astype(np.int8) - (y[:-1] >> s & 3).astype(np.int8))].sum() for s in (0, 2, 4, 6))
    return float(d + abs(int(x[-1]) - int(y[-1])) / 2)


_far = np.array([0, 1, 2, 6])


def likeness(a: bytes, b: bytes) -> float:
    """From 1 for equal digests down to 0."""
    return max(0.0, 1.0 - difference(a, b) / MOST_DIFFERENCE)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare(doc_id, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    e = edited(text, following).encode()
    f = fingerprint(e)
    return doc_id, len(text), hashlib.sha256(e).hexdigest(), own.hex(), f.hex(), likeness(own, f), likeness(own, next_own)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and its text as edited with the next document's, in ascending doc_id order.

    One range partitioning by doc_id; each task walks its range with a look ahead of one row. The last row of a range
    needs the first of the next range: both, two rows for each range, are written with the rest and joined afterwards.

    Ties of doc_id are ordered by text, null ids come first; null texts are empty ones; the last document's next is
    the first (its own, if it is alone); repeated rows are documents of their own; an empty table gives no rows.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me, before, rows = TaskContext.get().partitionId(), None, []

        def out() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["kind", "part", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64", "n_chars": "Int64"})

        for pdf in batches:
            for d, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                own = fingerprint(text.encode())
                if before is None:
                    rows.append(("head", me, text, d, len(text), None, own.hex(), None, None, None))
                else:
                    rows.append(("row", me, None, *compare(*before, text, own)))
                before = d, text, own
                if len(rows) >= 2000:
                    yield out()
                    rows = []
        if before:
            d, text, own = before
            rows.append(("tail", me, text, d, len(text), None, own.hex(), None, None, None))
        if rows:
            yield out()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = pdf["doc_id"].astype("Int64")
            rows = [compare(d, t, bytes.fromhex(f), nt, bytes.fromhex(nf)) for d, t, f, nt, nf in zip(docs, pdf["text"], pdf["fingerprint"], pdf["next_text"], pdf["next_fingerprint"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")]).astype({"doc_id": "Int64"})

    ordered = text_rows(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = materialize(ordered.mapInPandas(task, f"kind string, part int, text string, {FIELDS}"), "fingerprints")
    heads, tails = walked.where("kind = 'head'"), walked.where("kind = 'tail'")
    w = Window.orderBy("part")  # over one row for each range, without texts
    after = heads.select("part", F.lead("part").over(w).alias("next"), F.min("part").over(w).alias("first"))
    after = after.select("part", F.coalesce("next", "first").alias("next"))
    firsts = heads.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = tails.select("part", "doc_id", "text", "fingerprint").join(after, "part").join(firsts, "next")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    return walked.where("kind = 'row'").select(names).unionByName(last.mapInPandas(ends, FIELDS))
