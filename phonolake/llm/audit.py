"""Audit of how filters interact: truth-table survival words and their positional popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: For each set of failed filters (as bits) the word whose bit s is set if a document passes all filters of the subset s.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)

_SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: str = "text") -> list[Column]:
    """Whether a text fails the filters A to D; E looks at the whole table."""
    t = F.col(text)
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    n = F.size(words)
    return [
        n < 200,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        F.length(F.regexp_replace(t, "[^A-Z]", "")) * 100 > F.length(t) * 2,
        t.rlike("[#$%&*|]"),
    ]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set, by carry-save addition.

    Three words of a weight become one of the same weight (their sum without carries) and one of twice that (the
    carries), a whole level of words at once, until each weight has two words at most.
    """
    counts, weight = np.zeros(32, np.int64), 1
    level = words.astype(np.uint32)
    while len(level):
        carried = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            half = a ^ b
            carried.append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * k :]])
        for w in level:
            counts += (int(w) >> np.arange(32) & 1) * weight
        level, weight = np.concatenate(carried) if carried else level[:0], weight * 2
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").dictionary_encode()
        code = part.indices.to_numpy()
        word = SURVIVAL[batch.column("failed").to_numpy()]
        label = batch.column("label").to_numpy()
        order = np.argsort(code, kind="stable")
        rows = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
        found = [(code[r[0]], [positional_popcount(word[r[label[r] & bit == bit]]) for bit in (0, 1, 2)]) for r in rows]
        columns = [pa.array([part.dictionary[int(c)].as_py() for c, _ in found], pa.string())]
        columns += [pa.array([x[k].tolist() for _, x in found], pa.list_(pa.int64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "all", "good", "toxic"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: part, failed (bits of the filters it fails), label (1: quality 1, 2: toxic 1, 3: both).

    E: a row fails if its text stands under a smaller doc_id anywhere in the table; rows without an id never do.
    Where labels of one document conflict, a 1 counts. Texts stay where they are read; what is shuffled are digests.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions())), F.lit(0))
    rows = materialize(text.select("doc_id", "part", bits.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-flags")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg((F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label")).where("label > 0")
    known = rows.where("doc_id IS NOT NULL")
    labelled = join_hot(known, marks, "doc_id", known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    labelled = labelled.unionByName(rows.where("doc_id IS NULL").withColumn("label", F.lit(None).cast("int")))
    same = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("first < last"), "repeated-texts")
    out = join_hot(labelled, same.select("digest", "first"), "digest", same.select("digest", "n"))
    failed = F.col("failed") + F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    return out.select("part", failed.alias("failed"), F.coalesce("label", F.lit(0)).alias("label"))


def survivors(rows: DataFrame) -> DataFrame:
    """part; all, good and toxic: for each subset of the filters (its bits are the place in the array) how many documents survive it."""
    counted = rows.mapInArrow(_count, "part string, all array<bigint>, good array<bigint>, toxic array<bigint>")
    return counted.groupBy("part").agg(*[F.array(*[F.sum(F.col(c)[s]) for s in range(SUBSETS)]).alias(c) for c in ("all", "good", "toxic")])


def _steps() -> list[tuple[str, int, int, int]]:
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[k] for k in order), step + 1, before, f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, within every part: all of it follows from the survivors of the subsets.

    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty ones; a null source is the part ''; rows that repeat, or share an id, count one by one (and
    fail E only beside a smaller id); rows without an id have no label; an empty table gives no rows; other columns
    are not read.
    """
    at = lambda c, s: F.element_at(c, s + 1)
    n = len(FILTERS)
    shares = []  # a filter's removals over all orders: by the set of those before it, as many orders as these and the rest have
    for f in range(n):
        sets = [s for s in range(SUBSETS) if not s >> f & 1]
        shares.append(sum((F.col("all")[s] - F.col("all")[s | 1 << f]) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in sets))
    steps = _steps()
    table = survivors(failures(docs, labels)).withColumn("shares", F.array(*shares))
    table = table.select("*", F.posexplode(F.lit([b << 3 | f for _, _, b, f in steps])).alias("place", "code"))
    f, before = F.col("code").bitwiseAND(7), F.shiftright("code", 3)
    bit = at(F.lit([1 << k for k in range(n)]), f)
    table = table.withColumns({"f": f, "before": before, "bit": bit}).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda c: at(F.col(c), F.col("before")) - at(F.col(c), F.col("after"))
    every = SUBSETS - 1
    failing = at(F.col("all"), F.lit(0)) - at(F.col("all"), F.col("bit"))
    return table.select(
        "part",
        at(F.lit([o for o, _, _, _ in steps[:: len(FILTERS)]]), F.floor(F.col("place") / n).cast("int")).alias("filter_order"),
        (F.col("place") % n + 1).alias("step"),
        at(F.lit(list(FILTERS)), F.col("f")).alias("filter"),
        at(F.col("all"), F.col("after")).alias("kept"),
        lost("all").alias("removed"),
        (failing - lost("all")).alias("redundant"),
        (at(F.col("all"), F.lit(every) - F.col("bit")) - at(F.col("all"), F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at(F.col("shares"), F.col("f")).alias("shapley"),
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(texts.doc_id > first_id, false) AS e
  FROM texts LEFT JOIN marks ON marks.doc_id = texts.doc_id),
grouped AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
placed AS (
  SELECT g.part, s.filter_order, s.step, filter_order[step] AS filter, g.n, g.good, g.toxic, g.fails,
    contains(g.fails, s.filter_order[s.step]) AS hit,
    len(list_filter(string_split(g.fails, ''), lambda f: f <> '' AND contains(s.filter_order[1:s.step - 1], f))) > 0 AS gone
  FROM grouped g, steps s),
counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = filter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""
