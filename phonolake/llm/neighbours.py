"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are the classes of three bytes in a row, what the words around a place look like, and its words, all
hashed into TERMS places. Weighted by their logarithmic counts and by how rare they are over all documents, they are
projected onto the leading singular directions of the labelled documents. A document is compared with every labelled one,
block by block, and its K nearest vote with weights that grow with the cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, text_rows

#: Labelled documents that the space is fitted on and that vote, at most, about. They are broadcast: SAMPLE_DOCS x DIMENSIONS x 4 bytes.
SAMPLE_DOCS = 8_000
TERMS = 4096
DIMENSIONS = 64
K = 15
#: A neighbour's weight is its cosine (zero if negative) to this power.
SHARPNESS = 8
#: Labelled vectors that are multiplied at once.
BLOCK = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _classes() -> np.ndarray:
    """Of each byte: one class for small letters (and bytes of other scripts), one for capitals, one for digits; each other character is its own."""
    out = np.arange(256)
    out[128:] = ord("a")
    for first, last in ("az", "AZ", "09"):
        out[ord(first) : ord(last) + 1] = ord(first)
    return out


_CLASS = _classes().astype(np.int64)
#: Places of terms: byte classes take the first half, words and their surroundings the other.
_HALF = TERMS // 2


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _to_the(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept, for as long texts as any task has seen up to 1 MiB."""
    if n <= len(_powers[0]):
        return [x[:n] for x in _powers]
    out = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n <= 1 << 20:
        _powers[:] = out
    return out


def word_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each word of a text in UTF-8, by differences of one running sum."""
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _to_the(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    h = (total[end] - total[start]) * inverse[start]
    return (h ^ h >> np.uint64(31)) * np.uint64(_BASE) >> np.uint64(20)


def terms(text: str) -> np.ndarray:
    """Counts of a whole text's terms."""
    b = np.frombuffer(text.encode(errors="surrogatepass"), np.uint8)
    c, n = _CLASS[b], np.zeros(TERMS, np.float32)
    if len(c) >= 3:
        n[:_HALF] = np.bincount((c[:-2] * 31 + c[1:-1] * 997 + c[2:] * 7919) % _HALF, minlength=_HALF)
    h = word_hashes(b).astype(np.int64)
    for d in (1, 2, 3, 4):  # words that come again at a distance
        n[_HALF + d] = (h[d:] == h[:-d]).sum()
    n[_HALF:] += np.bincount(8 + h % (_HALF - 8), minlength=_HALF)
    return n


@dataclass
class Model:
    rarity: np.ndarray  # of each term
    directions: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # of the labelled documents, of length 1 (or 0)
    labels: np.ndarray  # the share of their marks that is 1
    prior: float


def weigh(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def project(counts: np.ndarray, rarity: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return of_length_one(weigh(counts, rarity) @ directions)


def of_length_one(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0).astype(np.float32)


def leading_directions(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    return q


def vote(model: Model, vectors: np.ndarray, k: int = K) -> np.ndarray:
    """Each vector's score: its k nearest labelled vectors, found in exact products with one block of them after another.

    Of equally near ones those that come first in the model vote. Vectors of length 0, and those that no labelled one
    is near to, get the share of the labels that are 1.
    """
    best, mark = np.full((len(vectors), 0), -2.0, np.float32), np.zeros((len(vectors), 0), np.float32)
    for b in range(0, len(model.vectors), BLOCK):
        near = vectors @ model.vectors[b : b + BLOCK].T
        best = np.hstack([best, near])
        mark = np.hstack([mark, np.broadcast_to(model.labels[b : b + BLOCK], near.shape)])
        if best.shape[1] > k:
            top = np.sort(np.argpartition(-best, k - 1, axis=1)[:, :k], axis=1)
            best, mark = np.take_along_axis(best, top, 1), np.take_along_axis(mark, top, 1)
    w = np.maximum(best, 0).astype(np.float64) ** SHARPNESS
    total = w.sum(1)
    return np.where(total > 1e-9, (w * mark).sum(1) / np.maximum(total, 1e-9), model.prior)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many there are: over the whole table, one row from each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(TERMS + 1, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                n[:-1] += terms(t) > 0
            n[-1] += len(pdf)
        yield pd.DataFrame({"n": [n.tolist()]})

    parts = rows.select("text").mapInPandas(count, "n array<bigint>").select(F.posexplode("n").alias("term", "n"))
    sums = dict(parts.groupBy("term").agg(F.sum("n")).collect())
    n = np.array([sums.get(i, 0) for i in range(TERMS + 1)])
    return n[:-1], int(n[-1])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, holds_out: Callable = lambda fold: fold % 3 == 1) -> Model:
    """A model from labelled documents that aren't held out: about sample_docs of them, chosen by a hash of the id.

    Held out are those whose crc32(doc_id as text) mod 3 is 1. The rarity of terms is counted over all documents.
    Where marks of one document conflict, it votes with their mean. Without any label all scores are 0.5.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IS NOT NULL").where(~holds_out(fold))
    known = known.groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("mark"))
    chosen = hash_sample(known, sample_docs, known.count(), 13)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "n": [zlib.compress(terms(t).astype("<f4").tobytes(), 1) for t in pdf["text"]]})

    rows = text_rows(docs).join(chosen, "doc_id").select("doc_id", "text", "mark").mapInPandas(count, "doc_id long, mark double, n binary").toPandas()
    rows = rows.sort_values(["doc_id", "n"])
    seen, n = document_frequencies(text_rows(docs))
    rarity = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    weighted = np.zeros((len(rows), TERMS), np.float32)
    for k, b in enumerate(rows["n"]):
        weighted[k] = weigh(np.frombuffer(zlib.decompress(b), "<f4")[None], rarity)
    directions = leading_directions(weighted, DIMENSIONS)
    mark = rows["mark"].to_numpy(np.float32)
    return Model(rarity, directions, of_length_one(weighted @ directions), mark, float(mark.mean()) if len(mark) else 0.5)


def score_column(spark: SparkSession, model: Model):
    """A function of a text column that gives each whole text's score."""
    shared = spark.sparkContext.broadcast(model)  # of a bounded size, see SAMPLE_DOCS

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for k in range(0, len(texts), 512):
            counts = np.stack([terms(t) for t in texts.iloc[k : k + 512]])
            out.append(vote(m, project(counts, m.rarity, m.directions)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every document, from its whole text.

    Null and empty texts have no terms and get the share of the labels that are 1; null ids and repeated rows are
    kept; an empty table gives no rows; other columns are not read.
    """
    return text_rows(df, id_col, text_col).select("doc_id", score_column(df.sparkSession, model)("text").alias("score"))
