"""Fills settled by rounds of running sums, held against folds that go row by row."""

import hashlib
import heapq
import random
from collections import defaultdict

import pytest

from phonolake.operators import sampling


def rows_of(seed, costs, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"{rng.randint(0, n):04d}", rng.choice(costs), i) for i in range(n)]
    return [*rows, *rows[:4], ("none", "0000", None, -1), ("large", "0000", 5000, -2), ("large", "0001", 1, -3)]


def by_group(rows):
    out = defaultdict(list)
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1:]):
        out[r[0]].append(r)
    return out


def plain_budget(rows, target):
    out = []
    for group in by_group(rows).values():
        total, some = 0, False
        for r in group:
            if not some or (total < target and total + r[2] <= target):
                out.append((r[0], r[3]))
                total, some = total + r[2], True
    return sorted(out, key=str)


def plain_balanced(rows, target, seed):
    held = {g: r[::-1] for g, r in by_group(rows).items()}
    turn = lambda g: "" if g is None or seed is None else hashlib.sha1(f"{seed}|group|{g}".encode()).hexdigest()
    heap, total, out = [(0, g is not None, turn(g), g) for g in held], 0, []
    heapq.heapify(heap)
    while heap:
        own, named, order, g = heapq.heappop(heap)
        while held[g] and total + held[g][-1][2] > target:
            held[g].pop()
        if held[g]:
            r = held[g].pop()
            total += r[2]
            out.append((g, r[3]))
            heapq.heappush(heap, (own + r[2], named, order, g))
    return sorted(out, key=str)


# seed, costs, target, rows that are folded at the end
FEW = (2, [0, 1, 7, 50, 90, 300], 301)
LARGE = (3, [200, 150, 151, 149, 3, 299], 300)


@pytest.mark.parametrize(("seed", "costs", "target", "together"), [(*FEW, 0), (*LARGE, 15)])
def test_budget_rounds_are_the_plain_fold(spark, monkeypatch, seed, costs, target, together):
    monkeypatch.setattr(sampling, "SLICE", 7)
    rows = rows_of(seed, costs)
    df = spark.createDataFrame(rows, "g string, k string, c int, i long").repartition(3)
    got = sampling.budget_fill(df, "g", "k", "c", target, ["i"], together=together).collect()
    assert sorted(map(tuple, got), key=str) == plain_budget(rows, target)


@pytest.mark.parametrize(("seed", "costs", "target", "together"), [(*FEW, 40), (*LARGE, 0)])
def test_balanced_rounds_are_the_plain_fold(spark, monkeypatch, seed, costs, target, together):
    monkeypatch.setattr(sampling, "SLICE", 7)
    rows = rows_of(seed, costs)
    df = spark.createDataFrame(rows, "g string, k string, c int, i long").repartition(3)
    turns = seed if seed % 2 else None
    got = sampling.balanced_fill(df, "g", "k", "c", target, ["i"], seed=turns, together=together).collect()
    assert sorted(map(tuple, got), key=str) == plain_balanced(rows, target, turns)


def test_fills_of_nothing(spark):
    df = spark.createDataFrame([], "g string, k string, c decimal(10,2), i long")
    assert sampling.budget_fill(df, "g", "k", "c", 10, ["i"], together=0).count() == 0
    assert sampling.balanced_fill(df, "g", "k", "c", 10, ["i"], together=0).count() == 0


def test_costs_may_be_decimals(spark):
    df = spark.createDataFrame([("a", i, float(c), i) for i, c in enumerate([2.5, 9.0, 2.5, 4.5, 0.5])], "g string, k int, c double, i long").selectExpr("g", "k", "CAST(c AS decimal(10,2)) AS c", "i")
    for fill in (sampling.budget_fill, sampling.balanced_fill):
        assert sorted(r["i"] for r in fill(df, "g", "k", "c", 10, ["i", "c"], together=0).collect()) == [0, 2, 3, 4]
