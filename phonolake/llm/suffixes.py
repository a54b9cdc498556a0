"""Removal of repeated passages: exact matches of a fixed length, found by prefix-free parsing.

A rolling hash triggers phrase ends: position a is a trigger if it has the least hash of 16 bytes among the first
REACH positions of some window of `length` bytes. Each window thus belongs to one trigger, which depends on the
window's bytes alone, so equal windows sit alike around equal triggers. What lies before a trigger is a suffix of a
phrase (the dictionary), what lies after it a suffix of the parse; the text between two triggers is never sorted
byte by byte. Rows are triggers, about two for REACH bytes of text.

1. Every trigger's seed (the bytes after it that all of its windows share) and hull (all bytes that its windows
   touch) are hashed and counted. A trigger whose seed is alone is done, one whose hull occurs twice is removed whole.
2. The others are dealt out by their seed. A task sorts the reversed phrases and the parse suffixes it holds, which
   gives both suffix arrays with their common prefixes, and combines them: windows that start r bytes before their
   trigger are equal when their triggers are in the same class of phrase suffixes of r bytes and in the same class of
   parse suffixes of length - r bytes.
3. Seeds with more different surroundings than a task should hold are split by r instead, again and again, with
   counts of equal seeds and hulls in between, down to single windows: no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, hold, join_hot, materialize, scratch, text_key, text_rows

#: Bytes that the rolling hash covers.
GRAM = 16
#: Of a seed with more different surroundings than this, the windows are split.
MOST_TOGETHER = 512
#: Contexts that a task sorts at once.
CHUNK = 16_384
#: So many starts are taken together when the windows of a seed are split.
SPLITS = (32, 4, 1)

_byte = np.random.default_rng(11).integers(1 << 32, size=256, dtype=np.uint32)


def reach_of(length: int) -> int:
    """REACH for windows of `length` bytes: three quarters of them, so that seeds are long enough to tell."""
    return max(8, 3 * length // 4 // 32 * 32)


_context = "doc_id long, key binary, a int, lo int, hi int, n long, ctx binary, seed long, hull long"


def triggers(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, lo, hi): the triggers and, for each, the least and greatest r so that the window from a - r is its own."""
    reach = reach_of(length)
    n = len(t) - length + reach  # positions that may be triggers
    h = _byte[t[: n + GRAM - 1]]
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint32(0x9E3779B1 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    v = h.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= reach:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < reach:  # two windows of `step` that overlap
        v = np.minimum(v[: -(reach - step)], v[reach - step :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window; never falls
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.append(first[1:] - 1, len(at) - 1)
    a = at[first]
    return a, a - last, a - first


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def parse(docs: DataFrame, length: int) -> DataFrame:
    """The triggers of every text: num (the row's own number), doc_id, key (the text's digest), a, lo, hi, seed, hull."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("suffixes", lambda: None)
        h64, own = xxhash.xxh3_64_intdigest, length - reach_of(length) + 1
        columns, num = ["num", "doc_id", "key", "a", "lo", "hi", "seed", "hull"], TaskContext.get().partitionId() << 33
        for pdf in batches:
            parts, held = [], 0
            for d, key, text in zip(pdf["doc_id"].astype("Int64"), pdf["key"], pdf["text"], strict=True):
                raw = text.encode()
                if len(raw) < length:
                    continue
                a, lo, hi = triggers(np.frombuffer(raw, np.uint8), length)
                seed = np.array([h64(raw[x : x + own]) for x in a.tolist()], np.uint64).view(np.int64)
                hull = np.array([h64(raw[x - q : x + length - p], p << 16 | q) for x, p, q in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
                parts.append((num, d, key, a, lo, hi, seed, hull))
                num += 1
                held += len(a)
                if held > 50_000:
                    yield _stacked(parts, columns)
                    parts, held = [], 0
            if parts:
                yield _stacked(parts, columns)

    return docs.mapInPandas(task, "num long, doc_id long, key binary, a int, lo int, hi int, seed long, hull long")


def _stacked(parts: list[tuple], columns: list[str]) -> pd.DataFrame:
    n = [len(p[3]) for p in parts]
    cols = [np.repeat(np.array([p[0] for p in parts], np.int64), n), pd.array(np.repeat(np.array([p[1] for p in parts], object), n), dtype="Int64"), np.repeat(np.array([p[2] for p in parts], object), n)]
    return pd.DataFrame(dict(zip(columns, cols + [np.concatenate([p[k] for p in parts]) for k in range(3, 8)], strict=True)))


def repeated_windows(ctx: list[bytes], lo: np.ndarray, hi: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each context (bytes from a - hi to a + length - lo) and each r, whether the window from a - r occurs twice.

    n: how often each context occurs.
    """
    m, reach = len(ctx), reach_of(length)
    right, left = np.zeros((m, length), np.uint8), np.zeros((m, reach), np.uint8)
    for i, (c, q) in enumerate(zip(ctx, hi.tolist(), strict=True)):
        b = np.frombuffer(c, np.uint8)
        right[i, : len(b) - q] = b[q:]
        left[i, :q] = b[:q][::-1]

    def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order, and of each in that order the common prefix with the one before."""
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        s = rows[order]
        differ = s[1:] != s[:-1]
        return order, np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), rows.shape[1])])

    parse_order, parse_lcp = suffix_array(right)
    phrase_order, phrase_lcp = suffix_array(left)
    parse_class, phrase_class = np.empty(m, np.int64), np.empty(m, np.int64)
    out = np.zeros((m, reach), bool)
    for r in range(int(lo.min()), int(hi.max()) + 1):
        here = np.flatnonzero((lo <= r) & (r <= hi))
        if not len(here):
            continue
        parse_class[parse_order] = np.cumsum(parse_lcp < length - r)
        phrase_class[phrase_order] = np.cumsum(phrase_lcp < r)
        _, which = np.unique(phrase_class[here] * (m + 1) + parse_class[here], return_inverse=True)
        out[here, r] = np.bincount(which, weights=n[here])[which] > 1
    return out


def _sorted_by_task(contexts: DataFrame, length: int) -> DataFrame:
    """Stage 2: key, s, e (removed bytes) of contexts dealt out by seed."""

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi, a = (rows[c].to_numpy(np.int64) for c in ("lo", "hi", "a"))
        twice = repeated_windows(rows["ctx"].tolist(), lo, hi, rows["n"].to_numpy(np.int64), length)
        edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, r0 = np.nonzero(edge == 1)
        _, r1 = np.nonzero(edge == -1)  # beyond the run's last
        return pd.DataFrame({"key": rows["key"].to_numpy()[i], "s": a[i] - r1 + 1, "e": a[i] - r0 + length})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                rows = pd.concat(held, ignore_index=True)
                whole = rows["seed"] != rows["seed"].iloc[-1]  # the last seed may go on
                if whole.any():
                    yield spans(rows[whole].reset_index(drop=True))
                held, n = [rows[~whole]], int((~whole).sum())
        if n:
            yield spans(pd.concat(held, ignore_index=True))

    return contexts.repartition("seed").sortWithinPartitions("seed").mapInPandas(task, "key binary, s int, e int")


def _split(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Each context's windows in groups of `width` starts, each with its own seed, hull and bytes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h64 = xxhash.xxh3_64_intdigest
        names = [x.split()[0] for x in _context.split(", ")]
        for pdf in batches:
            rows = []
            docs = pdf["doc_id"].astype("Int64")
            for d, key, a, lo, hi, n, ctx in zip(docs, pdf["key"], pdf["a"], pdf["lo"], pdf["hi"], pdf["n"], pdf["ctx"], strict=True):
                for j in range(lo // width, hi // width + 1):
                    p, q = max(lo, j * width), min(hi, (j + 1) * width - 1)
                    seed = h64(ctx[hi - j * width : hi + length - (j + 1) * width + 1], width << 16 | j)
                    hull = ctx[hi - q : hi + length - p]
                    rows.append((d, key, a, p, q, n, hull, _signed(seed), _signed(h64(hull, p << 16 | q))))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return contexts.select("doc_id", "key", "a", "lo", "hi", "n", "ctx").mapInPandas(task, _context)


_CLASS = ["seed", "hull", "lo", "hi"]


def _classes(rows: DataFrame, own: tuple[str, ...] = ("doc_id", "key", "a")) -> DataFrame:
    """Of each class of equal hulls: how often it occurs (count), its first row by its own columns, its seed's occurrences and classes."""
    classes = rows.groupBy(*_CLASS).agg(F.sum("n").alias("count"), F.min(F.struct(*own)).alias("first"))
    seeds = classes.groupBy("seed").agg(F.sum("count").alias("seed_count"), F.count(F.lit(1)).alias("together"), F.min("count").alias("rarest"))
    return classes.join(seeds.where("seed_count > 1"), "seed")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """key, spans (array of s, e; may overlap) for the texts that have repeated windows. docs: doc_id, key, text."""
    with scratch(docs.sparkSession, "suffixes"):
        return materialize(_repeated_spans(docs, length), "spans", keep=True)


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    found = materialize(parse(docs, length), "triggers")
    # Shuffled are numbers of rows; the ids and digests that they stand for are joined to what is left.
    names = materialize(found.groupBy("num").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key")), "numbers")
    own = found.drop("doc_id", "key")
    classes = materialize(_classes(own.withColumn("n", F.lit(1).cast("long")), ("num", "a")), "classes")
    several = classes.where("count > 1")
    whole = join_hot(own, several.select(*_CLASS), _CLASS, several.select(*_CLASS, F.col("count").alias("n")), "left_semi")
    whole = whole.groupBy("num").agg(F.collect_set(F.struct((F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + length).alias("e"))).alias("at"))  # at most a document's own triggers
    spans = whole.join(names, "num").select("key", F.explode("at").alias("x")).select("key", "x.s", "x.e").distinct()

    # Contexts: a row for each class of a seed that has some class of one member.
    open_ = classes.where("rarest = 1").select("first.num", "first.a", "lo", "hi", F.least("count", F.lit(2)).cast("long").alias("n"), "seed", "hull", "together")
    by_doc = open_.groupBy("num").agg(F.collect_list(F.struct("a", "lo", "hi", "n", "seed", "hull", "together")).alias("at")).join(names, "num")  # at most a document's own triggers
    got = docs.alias("d").join(by_doc.alias("o"), F.expr("d.key = o.key AND d.doc_id <=> o.doc_id")).select("d.doc_id", "d.key", F.encode("d.text", "UTF-8").alias("raw"), F.explode("at").alias("x"))
    ctx = F.substring(F.col("raw"), F.col("x.a") - F.col("x.hi") + 1, F.lit(length) + F.col("x.hi") - F.col("x.lo"))
    contexts = materialize(got.select("doc_id", "key", "x.a", "x.lo", "x.hi", "x.n", ctx.alias("ctx"), "x.seed", "x.hull", "x.together"), "contexts")
    spans = spans.unionByName(_sorted_by_task(contexts.where(F.col("together") <= MOST_TOGETHER).drop("together"), length))

    rest = contexts.where(F.col("together") > MOST_TOGETHER)
    for width in SPLITS:
        rows = materialize(_split(rest, width, length), f"split-{width}")
        known = rows.join(_classes(rows).drop("together"), _CLASS)
        known = materialize(known, f"known-{width}") if width > 1 else known
        spans = spans.unionByName(known.where("count > 1").select("key", (F.col("a") - F.col("hi")).alias("s"), (F.col("a") - F.col("lo") + length).alias("e")))
        alone, stands = F.col("count") == 1, F.struct("doc_id", "key", "a") == F.col("first")
        rest = known.where(F.col("rarest") == 1).where(alone | stands).withColumn("n", F.least("count", F.lit(2)).cast("long")).select("doc_id", "key", "a", "lo", "hi", "n", "ctx")
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of s, e: the removed bytes), kept (binary: the others), for every document.

    Each byte goes that is covered by a string of `length` bytes which also starts elsewhere, in this document or
    another; matches never cross documents, and all are judged on the input. Texts are their UTF-8 bytes, so that
    kept may begin or end within a character. Null texts are empty ones; null ids and repeated rows are documents
    like any other (a repeated text of length bytes or more is removed whole); texts under length bytes stay; an
    empty table gives no rows; other columns are not read.
    """
    docs = text_rows(df, id_col, text_col).withColumn("key", text_key())
    spans = repeated_spans(docs, length)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part, rows = pdf.iloc[i : i + 1000], []
                for d, text, found in zip(part["doc_id"].astype("Int64"), part["text"], part["spans"], strict=True):
                    raw = text.encode()
                    gone = _merged(found) if found is not None else []
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((d, len(raw), [{"s": s, "e": e} for s, e in gone], kept))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": "Int64"})

    return join_hot(docs, spans, "key", copies(docs, "key")).select("doc_id", "text", "spans").mapInPandas(task, "doc_id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary")


def copies(df: DataFrame, key: str) -> DataFrame:
    """How often each text occurs that occurs more than once: key, n."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(n, "copies")


def without_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", over_words: int = 0) -> DataFrame:
    """The same rows with repeated passages cut out of their texts; characters cut apart go. All other columns stay.

    A passage is a longest run of bytes that are covered by repeated strings of `length` bytes; it is cut if it has more
    than over_words words, begun ones at its ends included.
    """
    key, found_at = free_names(df, "_key", "_spans")
    keyed = df.withColumn(key, text_key(text_col))
    docs = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(docs, length).select(F.col("key").alias(key), F.col("spans").alias(found_at))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None:
                raw = text.encode()
                gone = [(a, b) for a, b in _merged(found) if len(raw[a:b].split()) > over_words]
                edges = [0, *(x for s in gone for x in s), len(raw)]
                text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode(errors="ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    out = join_hot(keyed, spans, key, copies(keyed, key)).withColumn(text_col, cut(F.col(text_col), F.col(found_at))).drop(key, found_at)
    if n_chars_col in df.columns:
        out = out.withColumn(n_chars_col, F.coalesce(F.length(text_col), F.lit(0)).cast(df.schema[n_chars_col].dataType))
    return out.select(df.columns)
