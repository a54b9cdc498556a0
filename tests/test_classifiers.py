"""Fold models and detectors against plain numpy."""

from itertools import combinations

import numpy as np
import pytest
from phonolake.operators import classifiers as C
from pyspark.sql import functions as F


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a, b = rng.standard_normal(n) + y, rng.standard_normal(n) * 3 - 0.5 * y
    rows = [(int(i % 4) if i % 11 else None, int(v), None if i % 9 == 0 else float(p), float(q)) for i, (v, p, q) in enumerate(zip(y, a, b, strict=True))]
    return spark.createDataFrame(rows, "g int, y int, a double, b double"), rows


def plain_logistic(x, y):
    median = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), median, x)
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (y - p)) - ridge @ w)
    return w


def test_logistic_folds(spark):
    df, rows = table(spark)
    models = C.logistic_folds(df, "y", ["a", "b"], F.col("g"))
    assert sorted(models) == [0, 1, 2, 3]
    for k, (w, _) in models.items():
        own = [r for r in rows if r[0] != k]
        want = plain_logistic(np.array([[np.nan if v is None else v for v in r[2:]] for r in own]), np.array([r[1] for r in own]))
        assert np.allclose(w, want, atol=1e-8)
    out = C.predicted(df, models, ["a", "b"], F.col("g"))
    assert out.where("p IS NULL").count() == sum(r[0] is None for r in rows)
    report = {r["g"]: r for r in C.fold_report(out, "y", "p", "g").collect()}
    got = out.toPandas()
    for k in range(4):
        own = got[got["g"] == k]
        pos, neg = own[own["y"] == 1]["p"].to_numpy(), own[own["y"] == 0]["p"].to_numpy()
        auc = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
        assert report[k]["auc"] == pytest.approx(auc, abs=1e-8) and report[k]["balanced"] == pytest.approx(((pos >= 0.5).mean() + (neg < 0.5).mean()) / 2)


def test_folds_of_one_class(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 5.0), (None, None, 1.0)], "g int, y int, a double")
    models = C.logistic_folds(df, "y", ["a"], F.col("g"))
    assert list(models) == [0]  # without fold 1 there is one class
    assert C.fold_report(C.predicted(df, models, ["a"], F.col("g")), "y", "p", "g").collect() == []
    assert C.logistic_folds(df.where("y > 5"), "y", ["a"], F.col("g")) == {}
    constant = spark.createDataFrame([(i % 2, i // 2 % 2, 1.0) for i in range(8)], "g int, y int, a double")
    assert all(np.allclose(w, 0) for w, _ in C.logistic_folds(constant, "y", ["a"], F.col("g")).values())
    with pytest.raises(ValueError):
        C.logistic_folds(spark.range(300).select(F.col("id").alias("g"), (F.col("id") % 2).alias("y"), F.lit(1.0).alias("a")), "y", ["a"], F.col("g"))


def test_forests_see_what_lines_cannot(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (600, 2))
    rows = [(i % 3, int(a * b > 0), float(a) if i % 20 else None, float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, y int, a double, b double")
    out = C.forest_folds(df, "y", ["a", "b"], "g", trees=20)
    report = C.fold_report(out, "y", "p", "g").collect()
    assert out.columns == ["g", "y", "a", "b", "p"] and out.count() == 600 and len(report) == 3 and all(r["auc"] > 0.85 for r in report)
    line = C.fold_report(C.predicted(df, C.logistic_folds(df, "y", ["a", "b"], F.col("g")), ["a", "b"], F.col("g")), "y", "p", "g").collect()
    assert all(r["auc"] < 0.65 for r in line)
    assert C.forest_folds(df.limit(0), "y", ["a", "b"], "g").count() == 0


def plain_threshold(scores, fits, ceiling):
    """The score that is one place beyond what is allowed, and the next double after it."""
    eligible = sorted(np.array(scores)[np.array(fits, bool)], reverse=True)
    if not len(eligible):
        return None
    allowed = int(np.floor(ceiling * len(scores)))
    return eligible[-1] if allowed >= len(eligible) else np.nextafter(eligible[allowed], np.inf)


@pytest.mark.parametrize("ceiling", [0.0, 0.1, 0.35, 1.0])
def test_thresholds_under_a_ceiling(spark, ceiling):
    rng = np.random.default_rng(4)
    rows = [(k, bool(rng.integers(0, 4)), float(rng.integers(0, 12))) for k in ("x", "y") for _ in range(25)] + [("none", False, 1.0)]
    got = {r["k"]: r["threshold"] for r in C.fp_thresholds(spark.createDataFrame(rows, "k string, fits boolean, score double"), ["k"], ceiling).collect()}
    for k in ("x", "y"):
        own = [r for r in rows if r[0] == k]
        assert got[k] == plain_threshold([r[2] for r in own], [r[1] for r in own], ceiling)
        passed = sum(r[1] and r[2] >= got[k] for r in own)
        assert passed <= max(ceiling * len(own), 0) or got[k] == min(r[2] for r in own if r[1])
    assert "none" not in got


def plain_detector(rows, dims, ceiling):
    rows = [r for r in rows if all(r[4 + i] is not None for i in dims)]
    of = lambda side, split: (np.array([[r[4 + i] for i in dims] for r in rows if r[1] == side and r[2] == split], float), np.array([r[3] <= 0.5 for r in rows if r[1] == side and r[2] == split]))
    t, a = of(0, "train")[0], of(1, "train")[0]
    both = np.vstack([t, a])
    c, s = np.median(both, 0), np.subtract(*np.percentile(both, [75, 25], 0))
    t, a = (t - c) / s, (a - c) / s
    delta = a.mean(0) - t.mean(0)
    if len(dims) == 1:
        w = np.where(delta >= 0, 1.0, -1.0)
    else:
        w = np.linalg.solve(np.atleast_2d(np.cov(np.vstack([t - t.mean(0), a - a.mean(0)]), rowvar=False)) + 0.01 * np.eye(len(dims)), delta)
    w = w / np.linalg.norm(w)
    score = lambda x: np.round((x - c) / s @ w, 9)
    dev, ok = of(0, "dev")
    threshold = plain_threshold(score(dev), ok, ceiling)
    rate = lambda side, split: float((of(side, split)[1] & (score(of(side, split)[0]) >= threshold)).mean())
    margin = float(np.median(a @ w) - np.median(t @ w))
    return w, threshold, rate(0, "dev"), rate(0, "test"), rate(1, "dev"), rate(1, "test"), margin


def test_detectors_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = []
    for pair, shift in (("p|q", 2.0), ("q|r", 0.2)):
        for i in range(600):
            side = int(i % 2)
            x = rng.standard_normal(4) @ np.array([[1, 0.4, 0, 0], [0, 1, 0, 0.2], [0, 0, 1, 0], [0, 0, 0, 1]]) + side * shift * np.array([0.5, -0.7, 0.1, 0.0])
            rows.append((pair, side, ("train", "train", "dev", "test")[i // 2 % 4], float(rng.uniform()), *[None if rng.uniform() < 0.03 else float(v) for v in x]))
    rows += [("few", 0, "train", 0.1, 1.0, 2.0, 3.0, 4.0), ("few", 1, "train", 0.1, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "pair string, side int, split string, quality double, a double, b double, c double, d double")
    got = {(r["pair"], r["subset"]): r for r in C.fitted_detectors(df, "pair", ["a", "b", "c", "d"], 0.1, 0.2, quality_ceiling=0.5).collect()}
    assert len(got) == 2 * 14 and sum(r["best"] for r in got.values()) == len({r["pair"] for r in got.values() if r["accepted"]}) == 1
    for pair in ("p|q", "q|r"):
        kept = []
        for n in (1, 2, 3):
            for dims in combinations(range(4), n):
                r = got[pair, "+".join("abcd"[i] for i in dims)]
                w, threshold, *rates, margin = plain_detector([x for x in rows if x[0] == pair], dims, 0.1)
                assert np.allclose(r["weights"], w, atol=1e-7) and r["threshold"] == pytest.approx(threshold, abs=1e-7)
                assert [r[c] for c in ("dev_fp", "test_fp", "dev_recall", "test_recall")] == pytest.approx(rates) and r["train_margin"] == pytest.approx(margin, abs=1e-7)
                ok = margin > 0 and rates[0] <= 0.1 and rates[1] <= 0.1 and rates[2] >= 0.2 and rates[3] >= 0.2
                assert r["accepted"] == ok
                if ok:
                    kept.append((rates[3], rates[2], margin, -n, r["subset"]))
        assert [r["subset"] for r in got.values() if r["pair"] == pair and r["best"]] == ([max(kept)[-1]] if kept else [])
