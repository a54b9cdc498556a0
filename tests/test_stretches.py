"""Windows within stretches of time equal plain folds over a key's rows, at any width, with nulls, ties and one hot key."""

import random

import pytest
from phonolake.operators import joins, windows
from pyspark.sql import functions as F

ORDER = ["t", "id"]


def first(t):
    return (t is not None, t)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["a", "a", "a", "b", "c", None]
    out = [(i, rng.choice(keys), rng.choice([None, *range(0, 400)]) if i % 7 else rng.randrange(0, 400), rng.choice(["x", "x", "y", None]), rng.random() < 0.6, round(rng.random(), 3)) for i in range(400)]
    return [*out, (400, "alone", 5, None, None, 0.5), (401, "far", -90, "x", True, 0.5), (402, "far", 9_000, "x", True, 0.25)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t long, v string, f boolean, x double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (first(r[2]), r[0])):
        out.setdefault(r[1], []).append(r)
    return out


WIDTHS = pytest.mark.parametrize("width", [1, 7, 50, 10**9])


@WIDTHS
def test_neighbours_and_running_sums(df, rows, width):
    want, sums = {}, {}
    for g in by_key(rows).values():
        n = 0
        for i, r in enumerate(g):
            n += r[3] == "x"
            sums[r[0]] = n
            want[r[0]] = (g[i - 1][3] if i else None, g[i + 1][3] if i + 1 < len(g) else None)
    assert {r["id"]: (r["prev_v"], r["next_v"]) for r in windows.neighbours(df, "k", ORDER, "v", width).collect()} == want
    got = windows.running(df, "k", ORDER, F.when(F.col("v") == "x", 1).otherwise(0), "n", width).collect()
    assert {r["id"]: r["n"] for r in got} == sums


def split(g, joined):
    out = []
    for r in g:
        if out and joined(out[-1][-1], r):
            out[-1].append(r)
        else:
            out.append([r])
    return out


@WIDTHS
def test_runs_islands_and_longest(df, rows, width):
    want = {(k, i): (r[0][3], len(r)) for k, g in by_key(rows).items() for i, r in enumerate(split(g, lambda a, b: a[3] == b[3]), 1)}
    assert {(r["k"], r["run"]): (r["v"], r["n"]) for r in windows.runs(df, "k", ORDER, "v", "x", width).collect()} == want
    near = lambda a, b: a[2] is not None and b[2] is not None and b[2] - a[2] < 4
    want = {(k, i): (r[0][2], r[-1][2], len(r)) for k, g in by_key(rows).items() for i, r in enumerate(split(g, near), 1)}
    assert {(r["k"], r["island"]): (r["start"], r["end"], r["n"]) for r in windows.islands(df, "k", "t", "id", F.lit(4), width).collect()} == want
    flag = {k: [r for r in split(g, lambda a, b: bool(a[4]) == bool(b[4])) if r[0][4]] for k, g in by_key(rows).items()}
    assert {r["k"]: r["longest"] for r in windows.longest_run(df, "k", ORDER, F.col("f"), width).collect()} == {k: max(map(len, r), default=0) for k, r in flag.items()}


@WIDTHS
def test_midpoints(spark, df, rows, width):
    timed = [r for r in rows if r[2] is not None]
    spans = df.where("t IS NOT NULL").select("id", "k", (F.col("t") * 3 + F.col("id") % 3).alias("s"), (F.col("t") * 3 + 5).alias("e")).dropDuplicates(["k", "s", "e"])
    kept = sorted(map(tuple, spans.collect()), key=lambda r: (r[2], r[3]))
    assert 0 < len(kept) <= len(timed)
    want = {}
    for k in {r[1] for r in kept}:
        g = [r for r in kept if r[1] == k]
        for i, (n, _, s, e) in enumerate(g):
            want[(k, s, e)] = ((g[i - 1][3] + s) // 2 if i else s, (e + g[i + 1][2]) // 2 if i + 1 < len(g) else e)
    fixed = spark.createDataFrame(kept, spans.schema)
    assert {(r["k"], r["s"], r["e"]): (r["lo"], r["hi"]) for r in windows.midpoint_bounds(fixed, "k", "s", "e", width).collect()} == want


@WIDTHS
def test_nearest_rows(df, rows, width):
    timed = [r for r in rows if r[2] is not None]
    want = {}
    for p in (r for r in timed if r[3] == "y"):
        others = [o for o in timed if o[1] == p[1] and o[3] == "x"]
        want[p[0]] = min((abs(o[2] - p[2]) for o in others), default=None)
    two = df.where("t IS NOT NULL AND v IS NOT NULL")
    got = joins.nearest_before_after(two, "k", "t", "id", F.col("v") == "y", "id", width).collect()
    assert {r["id"]: r["distance"] for r in got} == want
    at = {r[0]: r[2] for r in timed}
    assert all(abs(at[r["nearest"]] - r["t"]) == r["distance"] for r in got if r["nearest"] is not None)


@WIDTHS
def test_nearest_centres(df, rows, width):
    points, spans = df.where("t IS NOT NULL AND f").select("id", "k", "t"), df.where("t IS NOT NULL AND NOT f").select(F.col("id").alias("m"), "k", F.col("t").alias("s"), (F.col("t") + 3).alias("e"))
    want = {}
    held = [(r[0], r[1], r[2], r[2] + 3) for r in rows if r[2] is not None and r[4] is False]
    for p in (r for r in rows if r[2] is not None and r[4]):
        all_ = [(not s <= p[2] < e, abs((s + e) // 2 - p[2]), m) for m, k, s, e in held if k == p[1] and k is not None]
        want[p[0]] = min(all_, default=(None, None, None))[1]
    got = {r["id"]: r["distance"] for r in joins.nearest_containing(points, spans, "k", "id", "m", 8, width).collect()}
    named = {r[0] for r in rows if r[1] is not None}
    assert {i: d for i, d in got.items() if i in named} == {i: d for i, d in want.items() if i in named}


def test_empty_table(df):
    none = df.where("id < 0")
    assert windows.neighbours(none, "k", ORDER, "v").count() == windows.islands(none, "k", "t", "id", F.lit(1)).count() == 0
