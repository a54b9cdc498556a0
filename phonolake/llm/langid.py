"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the products of the pieces' probabilities; a forward algorithm computes it,
for all languages and for many words of one length at once. The probabilities are learnt by expectation maximisation
with the same sums. A text's likelihood is that of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, hold, materialize, text_rows
from .tokens import default_path

#: Documents that the probabilities are learnt from, at most, about.
SAMPLE_DOCS = 12_000
ROUNDS = 3
#: Words of more letters are summed one by one, their segments at once, and not held; others many at once.
LONGEST = 24
UNKNOWN = 1e-7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_letter = re.compile(r"[^\W\d_]")


def words(text: str) -> list[str]:
    return ["▁" + w for w in text.split()]


class Pieces:
    """The vocabulary, looked up by hash for many substrings at once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = sorted(set(pieces))
        self.known = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        h = np.array([int(self.prefixes(self.codes([p]))[0, -1]) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids, self.n = h[order], order, len(pieces)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def codes(ws: list[str]) -> np.ndarray:
        """Code points of words of one length."""
        return np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(ws), -1)

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def arcs(self, ws: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, which words, piece or -1 for an unknown letter) for all places in order of `to`."""
        p = self.prefixes(self.codes(ws))
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                power.append(power[-1] * _BASE)
        n = p.shape[1] - 1
        for to in range(1, n + 1):
            for at in range(max(0, to - self.longest), to):
                h = p[:, to] - p[:, at] * power[to - at]
                w = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                k = np.searchsorted(self.hashes, h[w])
                k[k == self.n] = 0
                hit = self.hashes[k] == h[w]
                w, ids = w[hit], self.ids[k[hit]]
                if at == to - 1 and len(w) < len(ws):
                    rest = np.setdiff1d(np.arange(len(ws)), w, assume_unique=True)
                    w, ids = np.concatenate([w, rest]), np.concatenate([ids, np.full(len(rest), -1)])
                if len(w):
                    yield at, to, w, ids

    def lattice(self, w: str) -> np.ndarray:
        """For each place of a word after the first and each length the piece of that length that ends there: -1 for an
        unknown letter, NONE where there is no such piece."""
        c = self.codes([w])[0].astype(np.uint64) + np.uint64(1)
        out, h = np.full((len(c), min(self.longest, len(c))), NONE, np.int32), np.zeros(len(c), np.uint64)
        out[:, 0] = -1
        for size in range(1, out.shape[1] + 1):
            h = h[: len(c) - size + 1] * _BASE + c[size - 1 :]
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(self.hashes, h[at])
            k[k == self.n] = 0
            hit = self.hashes[k] == h[at]
            out[at[hit] + size - 1, size - 1] = self.ids[k[hit]]
        return out


#: No piece, in a lattice.
NONE = -2
#: Places of a long word that are summed side by side: so many segments of so many places.
SEGMENT, SEGMENTS = 24, 2048


def log_sums(weight: np.ndarray) -> np.ndarray:
    """Log of a[0], a[1], ... where a[0] = 1 and a[t] is the sum over sizes of weight[t - 1, size - 1] * a[t - size].

    The last places are a state that every place changes linearly. Segments of places are taken at once: first the change
    that each makes as a whole, then, one after the other, the states between them, then the places within each from
    its own state. States are rescaled from segment to segment.
    """
    n, size = weight.shape
    total, state, log = np.zeros(n + 1), np.eye(size)[0], 0.0
    for begin in range(0, n, SEGMENT * SEGMENTS):
        some = weight[begin : begin + SEGMENT * SEGMENTS]
        count = -(-len(some) // SEGMENT)
        c = np.zeros((count * SEGMENT, size))
        c[: len(some)], c[len(some) :, 0] = some, 1.0  # what fills up the last segment changes nothing
        c = c.reshape(count, SEGMENT, size)
        change = np.broadcast_to(np.eye(size), (count, size, size))
        for j in range(SEGMENT):
            change = np.concatenate([np.einsum("sl,slk->sk", c[:, j], change)[:, None], change[:, :-1]], axis=1)
        states, logs = np.empty((count, size)), np.empty(count)
        for k in range(count):
            states[k], logs[k] = state, log
            state = change[k] @ state
            top = max(float(state.max()), 1e-300)
            state, log = state / top, log + np.log(top)
        inner = np.empty((count, SEGMENT))
        for j in range(SEGMENT):
            inner[:, j] = np.einsum("sl,sl->s", c[:, j], states)
            states = np.concatenate([inner[:, j : j + 1], states[:, :-1]], axis=1)
        total[begin + 1 : begin + 1 + len(some)] = (np.log(np.maximum(inner, 1e-300)) + logs[:, None]).ravel()[: len(some)]
    return total


def _weights(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(lattice == NONE, 0.0, p[lattice])  # the unknown letter is the last


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # pieces (the unknown letter last) x languages
    path: str


def forward_long(v: Pieces, w: str, probability: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language."""
    lattice = v.lattice(w)
    return np.array([log_sums(_weights(lattice, p))[-1] for p in probability.T])


def expected_long(v: Pieces, w: str, n: float, p: np.ndarray) -> Iterator[tuple[int, float]]:
    """(piece, expected count) of the pieces in one word of any length that occurs n times, in one language."""
    lattice = v.lattice(w)
    weight, size = _weights(lattice, p), len(w)
    ahead, mirrored = log_sums(weight), np.zeros_like(weight)
    for k in range(1, weight.shape[1] + 1):  # from the end back: a piece of size k that ends at t begins at t - k
        mirrored[k - 1 :, k - 1] = weight[k - 1 :, k - 1][::-1]
    behind = log_sums(mirrored)[::-1]
    counts = np.zeros(v.n + 1)
    for k in range(1, weight.shape[1] + 1):
        to = np.flatnonzero(weight[:, k - 1] > 0) + 1
        x = np.exp(ahead[to - k] + np.log(weight[to - 1, k - 1]) + behind[to] - ahead[size])
        counts += np.bincount(np.where(lattice[to - 1, k - 1] < 0, v.n, lattice[to - 1, k - 1]), weights=n * x, minlength=v.n + 1)
    found = np.flatnonzero(counts)
    yield from zip(found.tolist(), counts[found].tolist(), strict=True)


def forward(v: Pieces, ws: list[str], probability: np.ndarray) -> np.ndarray:
    """Log probability of each of the words (all of one length, LONGEST at most) in each language."""
    a = np.zeros((len(ws[0]) + 1, len(ws), probability.shape[1]))
    a[0] = 1
    for at, to, w, ids in v.arcs(ws):
        a[to][w] += a[at][w] * probability[ids]
    return np.log(np.maximum(a[-1], 1e-300))


def expected(v: Pieces, ws: list[str], n: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of one length that occur n times, in one language."""
    length = len(ws[0])
    a, b = np.zeros((length + 1, len(ws))), np.zeros((length + 1, len(ws)))
    a[0] = b[-1] = 1
    arcs = list(v.arcs(ws))
    for at, to, w, ids in arcs:
        a[to][w] += a[at][w] * probability[ids]
    for at, to, w, ids in sorted(arcs, key=lambda x: -x[0]):
        b[at][w] += b[to][w] * probability[ids]
    out, z = np.zeros(v.n + 1), np.maximum(a[-1], 1e-300)
    for at, to, w, ids in arcs:
        out += np.bincount(np.where(ids < 0, v.n, ids), weights=n[w] * a[at][w] * probability[ids] * b[to][w] / z[w], minlength=v.n + 1)
    return out


def _by_length(ws: list[str], most: int = 5_000) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(ws):
        groups.setdefault(len(w), []).append(i)
    for g in groups.values():
        yield from (g[i : i + most] for i in range(0, len(g), most))


def train(df: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn from documents (doc_id, text, lang) with a language and crc32(doc_id as text) mod 3 other than 1.

    About sample_docs of them, chosen by a hash of the id, are counted; what comes to the driver are sums for each piece
    and language, bounded by the vocabulary.
    """
    path = path or default_path("piece_bpe_32k.model")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(F.coalesce(fold, F.lit(0)) != 1)
    chosen = hash_sample(known, sample_docs, known.count(), 5)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                c = Counter(w for t in part["text"] for w in words(t))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    counts = materialize(chosen.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    v = pieces(path)
    p = np.full((v.n + 1, max(1, len(languages))), 1.0 / (v.n + 1))
    p[-1] = UNKNOWN
    for _ in range(rounds if languages else 0):
        shared = df.sparkSession.sparkContext.broadcast((path, languages, p))  # vocabulary x languages

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            path, languages, p = shared.value
            v, total = pieces(path), np.zeros_like(p)
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    ws, n, k = part["word"].tolist(), part["n"].to_numpy(np.float64), languages.index(lang)
                    for g in _by_length(ws):
                        if len(ws[g[0]]) <= LONGEST:
                            total[:, k] += expected(v, [ws[i] for i in g], n[g], p[:, k])
                    for w, m in zip(ws, n, strict=True):
                        if len(w) > LONGEST:
                            for piece, x in expected_long(v, w, m, p[:, k]):
                                total[piece, k] += x
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = counts.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        c = np.full(p.shape, 0.02)
        c[sums["piece"], sums["lang"]] += sums["n"]
        p = c / c.sum(0)
        p[-1] = UNKNOWN
        shared.unpersist()
    return Model(languages, p, path)


class Identifier:
    """Scores texts; the likelihoods of known words are held, up to max_known."""

    def __init__(self, model: Model, max_known: int = 500_000):
        self.model, self.v, self.max_known = model, pieces(model.path), max_known
        self.known: dict[str, int] = {}
        self.table = np.zeros((max_known, len(model.languages)), np.float32)

    def learn(self, new: list[str]) -> None:
        for g in _by_length(new):
            at = len(self.known)
            self.table[at : at + len(g)] = forward(self.v, [new[i] for i in g], self.model.probability)
            self.known.update(zip((new[i] for i in g), range(at, at + len(g)), strict=True))

    def identify(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, share of the likelihood) of each text; the share is of likelihoods to the power 1/sqrt(words)."""
        every_word = [words(t) for t in texts]
        ws = [[w for w in own if len(w) <= LONGEST] for own in every_word]
        long = [[w for w in own if len(w) > LONGEST] for own in every_word]
        every = set().union(*ws)
        if len(self.known) + len(every) > self.max_known:
            self.known = {}
            if len(every) > self.max_known:
                self.table = np.zeros((len(every), self.table.shape[1]), np.float32)
        self.learn([w for w in every if w not in self.known])
        out = []
        for t, own, rest in zip(texts, ws, long, strict=True):
            if not self.model.languages or not _letter.search(t):
                out.append(("und", 0.0))
                continue
            s = self.table[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))].sum(0, dtype=np.float64)
            for w in rest:
                s = s + forward_long(self.v, w, self.model.probability)
            e = np.exp((s - s.max()) / np.sqrt(len(own) + len(rest)))
            k = int(np.argmax(s))  # the first in the alphabet, if likelihoods are equal
            out.append((self.model.languages[k], float(e[k] / e.sum())))
        return out


_identifiers: dict[int, Identifier] = {}


def identifier(model: Model) -> Identifier:
    """The worker's own identifier of a model, kept from task to task."""
    hold("langid", _identifiers.clear)
    key = hash((model.path, tuple(model.languages), model.probability.tobytes()))
    if key not in _identifiers:
        _identifiers.clear()
        _identifiers[key] = Identifier(model)
    return _identifiers[key]


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every document, from its whole text.

    `und` with score 0 for texts that are null, empty or without a letter, and if no language has been learnt; null ids
    and repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = identifier(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                found = own.identify(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return text_rows(df, id_col, text_col).mapInPandas(task, "doc_id long, lang_pred string, score double")
