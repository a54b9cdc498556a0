"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text, one on ordinary text.

A window is a word with the space before it (long words are cut), in lower case and UTF-16, so that a match of
letters weighs enough against the cost of pointing to it. Its excess is how many bytes longer it is when compressed
with the ordinary dictionary than when compressed with the ordinary and the toxic one. A document's score is a
logistic function, calibrated on labelled documents left out of the dictionaries, of its largest excesses and of how
many windows pass the calibrated excess.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, hash_sample, hold, materialize, scratch, text_rows

#: Labelled documents that dictionaries and calibration are fitted on, at most, about.
SAMPLE_DOCS = 8_000
SAMPLE_BYTES = 256 << 20  # of whole texts that the fit holds on the driver
ORDINARY_BYTES = 65_536
TOXIC_BYTES = 4_096
LEVEL = 12
LONGEST = 48
#: Words that begin with the same characters (the space is one) count as one stem.
STEM = 5


def windows(text: str) -> list[str]:
    out = []
    for w in text.lower().split():
        w = " " + w
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def _bytes(s: str) -> bytes:
    return s.encode("utf-16-le", "surrogatepass")


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]
    limit: float


class Scorer:
    """Excesses of windows, each distinct one compressed once; held in two generations of at most max_known each."""

    def __init__(self, model: Model, max_known: int = 200_000):
        self.model, self.max_known, self.known, self.older = model, max_known, {}, {}
        self.a, self.b = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)
        self.lead = model.ordinary[-400:-300]  # known to both, so that short windows are compressed at all
        self.base = len(self.a.compress(self.lead)) - len(self.b.compress(self.lead))

    def excess(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > self.max_known:
            self.older, self.known = self.known, {}
        known = self.known
        for w in set(ws).difference(known):
            x = self.older.get(w)
            if x is None:
                raw = self.lead + _bytes(w)
                x = len(self.a.compress(raw)) - len(self.b.compress(raw)) - self.base
            known[w] = x
        return np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))

    def features(self, text: str) -> list[float]:
        x = self.excess(windows(text))
        top = np.sort(np.append(x, [0.0, 0.0, 0.0]))[:-4:-1]
        over = float((x >= self.model.limit).sum())
        return [top[0], top[1], top[2], np.log1p(over), np.log1p(over) - np.log1p(len(x))]

    def score(self, text: str) -> float:
        m = self.model
        z = m.weights[0] + float(np.dot(m.weights[1:], (np.array(self.features(text)) - m.mean) / m.scale))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _dictionary(words: list[str], size: int, rng: random.Random) -> bytes:
    rng.shuffle(words)
    samples = [_bytes("".join(words[i : i + 8])) for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own text
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(texts: list[str], toxic: list[int], calibrate: list[bool], seed: int = 7) -> Model:
    """Dictionaries from the texts not kept for calibration; then the excess limit and the logistic function from the others.

    Toxic samples are the words of toxic texts that, or whose stems, occur in some surroundings there and hardly in
    ordinary texts: what ordinary text has as well tells nothing, and it would crowd the rest out of a small dictionary.
    Surroundings (the word before) are counted instead of texts, so that copies of a text count once.
    """
    rng = random.Random(seed)
    seen: dict[str, set[int]] = defaultdict(set)  # hashes of surroundings, in toxic texts
    stems: dict[str, set[int]] = defaultdict(set)
    plain: Counter[str] = Counter()
    plain_stems: Counter[str] = Counter()
    size: Counter[bool] = Counter()
    for i in sorted(range(len(texts)), key=lambda i: texts[i]):
        if calibrate[i]:
            continue
        ws = windows(texts[i])
        size[bool(toxic[i])] += len(ws)
        if not toxic[i]:
            plain.update(ws)
            plain_stems.update(w[:STEM] for w in ws if len(w) > STEM)
            continue
        for before, w in zip([""] + ws, ws, strict=False):
            seen[w].add(zlib.crc32(before.encode("utf-8", "surrogatepass")))
            if len(w) > STEM:
                stems[w[:STEM]].add(zlib.crc32(f"{before}{w}".encode("utf-8", "surrogatepass")))

    def lift(n: int, ordinary: int) -> float:
        return (n / max(1, size[True])) / ((ordinary + 1) / max(1, size[False]))

    rooted = {x for x, c in stems.items() if len(c) >= 4 and lift(len(c), plain_stems[x]) >= 8}
    marked = [w for w in sorted(seen) if w[:STEM] in rooted or len(seen[w]) >= 3 and lift(len(seen[w]), plain[w]) >= 5]
    known = sorted(plain)
    usual = rng.choices(known, [min(plain[w], 40) for w in known], k=200_000) if known else []
    model = Model(_dictionary(usual, ORDINARY_BYTES, rng), _dictionary([w for w in marked for _ in range(min(len(seen[w]), 400))], TOXIC_BYTES, rng), [0.0] * 6, [0.0] * 5, [1.0] * 5, 4.0)
    del seen, stems, plain, plain_stems, known, usual
    held = [(t, y) for t, y, c in zip(texts, toxic, calibrate, strict=True) if c]
    if not held:
        return model
    scorer, y = Scorer(model, 100_000), np.array([float(y) for _, y in held])
    tops = np.array([scorer.excess(windows(t)).max(initial=0.0) for t, _ in held])
    limits = np.arange(2.0, 13.0)
    right = [((tops >= v) == (y > 0)).mean() for v in limits]
    model.limit = float(limits[int(np.argmax(right))])
    x = np.array([scorer.features(t) for t, _ in held])
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    x = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
    model.weights = w.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) mod 5 is not 0: about sample_docs of them, chosen by a hash.

    Of these, in the order of the hash, it learns from those whose whole texts fit sample_bytes together; a document that
    doesn't fit is passed over, and later ones are still tried. Where labels of one document conflict, toxic counts.
    """
    spark, fold = docs.sparkSession, F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic IS NOT NULL").where(fold % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(known, sample_docs, known.count(), 3)
    with scratch(spark, "toxicity-fit"):
        rows = materialize(text_rows(docs).join(chosen, "doc_id").select("doc_id", "text", "toxic", (fold % 5 == 1).alias("calibrate")), "sample")
        sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"))
        total, fits, over = 0, [], False
        for r in sizes.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").collect():  # a row for each document of the sample
            if total + r["n"] <= sample_bytes:
                total += r["n"]
                fits.append((r["doc_id"],))
            else:
                over = True
        if over:
            rows = rows.join(F.broadcast(spark.createDataFrame(fits, "doc_id long")), "doc_id", "left_semi")
        sample = rows.toPandas().sort_values(["doc_id", "text"])
    return fit(sample["text"].tolist(), sample["toxic"].astype(int).tolist(), sample["calibrate"].tolist())


_scorers: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The worker's own scorer of a model, kept from task to task."""
    hold("toxicity", _scorers.clear)
    key = hash((model.ordinary, model.toxic, tuple(model.weights)))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score_column(spark: SparkSession, model: Model):
    """A function of a text column that gives each whole text's score."""
    shared = spark.sparkContext.broadcast(model)  # of a fixed size: two dictionaries and a few numbers

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(scorer(shared.value).score)

    return of


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every document, from its whole text.

    Null and empty texts have no window and get the score that this has; null ids and repeated rows are kept; an
    empty table gives no rows; other columns are not read.
    """
    return text_rows(df, id_col, text_col).select("doc_id", score_column(df.sparkSession, model)("text").alias("score"))


def drop_toxic(df: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose texts score less than limit, with all their columns."""
    (name,) = free_names(df, "_toxicity")
    scored = df.withColumn(name, score_column(df.sparkSession, model)(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.where(F.col(name) < limit).drop(name)
