"""Periodic runs of words, found in tiles by scales of the period and stitched together.

A run of smallest period p is at least 2p long. For every octave P <= p < 2P boundaries are laid into a document so close
that every run has one with a block of words after it that comes again p words on, within the run. Boundaries whose
block comes again at some distance of the octave are kept (hashes of all blocks tell; a chance likeness costs work, not
a wrong result). Around each a tile reaches just far enough for two boundary Z-functions, forward and backward, to give
the extent of every period of the octave there. Tiles are solved independently, wherever they are dealt to; the fragments
are brought together by document and period, and those that overlap by a period or more are one run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, scratch, text_rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: A run has so many words at least, and two periods.
LEAST = 12
#: Neighbouring tiles of about so many words travel together.
TOGETHER = 4096
#: About so many bytes of tiles are solved by a task: much work for few bytes.
TASK_BYTES = 4 << 20
#: So many block hashes are compared at once.
AT_ONCE = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def octave(period: int) -> tuple[int, int]:
    """(block, step) of the boundaries of the octave that begins at period.

    Of step boundary places in a row one is a boundary, so a run that has step + block - 1 words and a period more has a
    block between boundary and end whose repetition it also has: step + block - 1 + p <= max(LEAST, 2p) for all p.
    """
    room = min(max(LEAST, 2 * p) - p for p in (period, min(max(period, LEAST // 2), 2 * period - 1), 2 * period - 1)) + 1
    block = max(4, 1 << (room // 4).bit_length() - 1)
    return block, room - block


def boundaries(ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(period, document, boundaries in it) with a block that comes again at a distance of the octave that begins at period.

    ids: the words of all documents one after another as numbers; sizes: the words of each.
    """
    starts = np.cumsum(sizes) - sizes
    x = ids.astype(np.uint64) + np.uint64(1)
    for s in (29, 32):
        x = (x ^ x >> np.uint64(s)) * _MIX
    block, hashes, power = 1, x, int(_MIX)
    period, longest = 1, int(sizes.max(initial=0))
    while longest >= max(LEAST, 2 * period):
        want, step = octave(period)
        while block < want:  # the hash of twice as many words
            hashes = hashes[:-block] * np.uint64(power) + hashes[block:]
            block, power = 2 * block, power * power % (1 << 64)
        room = sizes - period - block
        counts = np.where((room >= 0) & (sizes >= max(LEAST, 2 * period)), room // step + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), counts)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        place, left = starts[doc] + at, sizes[doc] - at - period - block + 1  # how many distances there is room for
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([hashes, np.zeros(2 * period, np.uint64)]), period)
        found = np.zeros(len(doc), bool)
        rows = max(1, AT_ONCE // period)
        for k in range(0, len(doc), rows):
            p = place[k : k + rows]
            found[k : k + rows] = ((view[p + period] == hashes[p][:, None]) & (np.arange(period) < left[k : k + rows, None])).any(1)
        hit = np.flatnonzero(found)
        for own in np.split(hit, np.flatnonzero(np.diff(doc[hit])) + 1) if len(hit) else []:
            yield period, int(doc[own[0]]), at[own]
        period *= 2


def tiles(period: int, n: int, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, end, boundaries) of neighbouring tiles: from a step before each boundary to four periods' floor after it."""
    step, most = octave(period)[1], max(16, TOGETHER // octave(period)[1])
    gaps = np.flatnonzero(np.diff(at) > 4 * period) + 1
    for own in np.split(at, gaps):
        for k in range(0, len(own), most):
            some = own[k : k + most]
            yield max(0, int(some[0]) - step), min(n, int(some[-1]) + 4 * max(period, LEAST // 4)), some


def z_function(s: list, least: int) -> list[int]:
    """z[i]: how long s[i:] and s begin alike; of the first `least` places."""
    n, z, lo, hi = len(s), [0] * min(least, len(s)), 0, 0
    for i in range(1, len(z)):
        k = min(z[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


@cache
def prime_factors(p: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= p:
        if p % d == 0:
            out.append(d)
            while p % d == 0:
                p //= d
        d += 1
    return (*out, p) if p > 1 else tuple(out)


def solve(words: list[int], period: int, at: list[int]) -> dict[int, list[list[int]]]:
    """For each period of the octave the stretches [start, end) in words that have it and no smaller one, merged."""
    step, found = octave(period)[1], defaultdict(list)
    for b in at:
        left, right, most = max(0, b - step), min(len(words), b + 4 * max(period, LEAST // 4)), 2 * period
        if any(words[b] == words[b + d] and words[left + d : right] == words[left : right - d] for d in range(1, min(period, 33, right - b))):
            continue  # a smaller period holds throughout the tile, so no longer one is the smallest of any stretch
        ahead = z_function(words[b:right], most)
        before = words[left:b][::-1]
        end = min(right, b + most)
        behind = z_function([*before, -1, *words[left:end][::-1]], len(before) + 1 + end - left)
        back = behind[len(before) + 1 :][::-1][b - left :]  # at d: how far the words before b and those before b + d are alike, less one
        if any(d + ahead[d] == right - b and back[d - 1] == b - left for d in range(1, min(period, len(ahead)))):
            continue  # so does a smaller one here
        n = min(most, len(ahead))
        p_s = np.arange(period, n)
        s_s, e_s = b - np.array(back[period - 1 : n - 1], np.int64), b + p_s + np.array(ahead[period:n], np.int64)
        for k in np.flatnonzero(e_s - s_s >= np.maximum(LEAST, 2 * p_s)):
            p, s, e = int(p_s[k]), int(s_s[k]), int(e_s[k])
            if any(ahead[d] >= e - b - d and back[d - 1] >= b - s for d in (p // r for r in prime_factors(p))):
                continue
            own = found[p]
            if own and s <= own[-1][1] - p:
                own[-1] = [min(s, own[-1][0]), max(e, own[-1][1])]
            else:
                own.append([s, e])
    return found


class _Batch:
    """The documents of an Arrow batch: their words, keys and flagged boundaries."""

    def __init__(self, batch: pa.RecordBatch, alter: Callable[[int | None, list[str]], list[str]] | None):
        self.ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").to_pylist()
        words = [WORD.findall(t) for t in texts]
        self.words = [alter(d, w) for d, w in zip(self.ids, words, strict=True)] if alter else words
        self.keys = [hashlib.md5(f"{d} {t}".encode(errors="surrogatepass")).digest() for d, t in zip(self.ids, texts, strict=True)]
        known: dict[str, int] = {}
        numbers = [known.setdefault(w, len(known)) for ws in self.words for w in ws]
        self.numbers, self.sizes = np.array(numbers, np.int64), np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flagged = list(boundaries(self.numbers, self.sizes))
        self.open = {d for _, d, _ in self.flagged}


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of a column, a row at least: words of all rows at once take much more room."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    begin = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _scan(alter, plain: bool):
    """The documents without a flagged boundary, which have no run; or the others, with their tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (_Batch(some, alter) for batch in batches for some in slices(batch, "text")):
            if plain:
                rest = [i for i in range(len(b.ids)) if i not in b.open]
                yield pa.RecordBatch.from_arrays([pa.array([b.ids[i] for i in rest], pa.int64()), pa.array([" ".join(b.words[i]) for i in rest], pa.string())], ["doc_id", "collapsed"])
                continue
            rows = [(b.keys[i], b.ids[i], " ".join(b.words[i]), None, None, None, None) for i in sorted(b.open)]
            for period, d, at in b.flagged:
                own = b.numbers[b.starts[d] : b.starts[d] + b.sizes[d]]
                for lo, hi, some in tiles(period, len(own), at):
                    rows.append((b.keys[d], None, None, period, lo, own[lo:hi].astype("<i4").tobytes(), (some - lo).astype("<i4").tobytes()))
                    if len(rows) >= 2000:
                        yield _table(rows)
                        rows = []
            yield _table(rows)

    return run


_TILE = "key binary, doc_id long, collapsed string, octave int, lo long, words binary, boundaries binary"
_TYPES = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in _TILE.split(", ")])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (some for whole in batches for some in slices(whole, "words")):
        key, period, start, end = [], [], [], []
        for k, octave_, lo, words, at in zip(*(batch.column(c).to_pylist() for c in ("key", "octave", "lo", "words", "boundaries")), strict=True):
            for p, spans in solve(np.frombuffer(words, "<i4").tolist(), octave_, np.frombuffer(at, "<i4").tolist()).items():
                for s, e in spans:
                    key.append(k)
                    period.append(p)
                    start.append(lo + s)
                    end.append(lo + e)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in (period, start, end))], ["key", "period", "start", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """key, runs: fragments of one document and period that overlap by a period or more are one run."""
    near = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    opens = fragments.distinct().withColumn("opens", F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("long"))
    parts = opens.withColumn("part", F.sum("opens").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    one = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("runs"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (some for whole in batches for some in slices(whole, "collapsed")):
        out, runs = [], batch.column("runs").to_pylist()
        for text, own in zip(batch.column("collapsed").to_pylist(), runs, strict=True):
            words = text.split(" ")
            kept = np.ones(len(words), bool)
            for r in own:
                kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
            out.append(" ".join([words[i] for i in np.flatnonzero(kept)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("runs")], ["doc_id", "collapsed", "runs"])


def collapse_runs(df: DataFrame, alter: Callable[[int | None, list[str]], list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, collapsed (the words that stay, by single spaces), runs (start, length, period; by start, then period).

    Of every run only the first period stays, unless another run drops words of it. alter may rewrite the words of a
    document, by its id and words alone, before they are looked at. A document's words are held whole in one task; its
    tiles and fragments are dealt out, and only documents with a flagged boundary are written and shuffled.

    Null and empty texts have no words and no run; rows that repeat id and text have the same result; null ids are
    kept; an empty table gives no rows; other columns are not read.
    """
    rows = text_rows(df, id_col, text_col)
    plain = rows.mapInArrow(_scan(alter, True), "doc_id long, collapsed string").withColumn("runs", F.array().cast(RUNS))
    flagged = materialize(rows.mapInArrow(_scan(alter, False), _TILE), "flagged")
    with scratch(df.sparkSession, "runs"):
        dealt = flagged.where("octave IS NOT NULL").select("key", "octave", "lo", "words", "boundaries")
        size = dealt.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        dealt = dealt.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES), "key", "octave", "lo")
        fragments = materialize(dealt.mapInArrow(_solve, "key binary, period long, start long, end long"), "fragments")
        runs = materialize(stitch(fragments), "stitched", keep=True)
    texts = flagged.where("octave IS NULL").select("key", "doc_id", "collapsed")
    joined = join_hot(texts, runs, "key", texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    joined = joined.withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    return plain.unionByName(joined.mapInArrow(_drop, f"doc_id long, collapsed string, runs {RUNS}"))


def plant(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document (by crc32 of its id as text) is made periodic from some word on; rows without an id are left alone."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
