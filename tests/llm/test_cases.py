"""Repeated and absent ids, clashing names, samples of huge tables, hot keys; and plain versions of what the operators compute."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from phonolake.llm import common, fingerprints, forest, langid, mixing, sharding, suffixes, toxicity
from pyspark.sql import functions as F


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_sample_of_a_huge_table_is_not_empty(spark):
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"))
    n = common.hash_sample(ids, 10**9, 10**11, 3).count()  # a share of one in a hundred
    assert 1_700 < n < 2_300
    assert common.hash_sample(ids, 12_000, 10**11, 3).count() <= 2
    assert common.hash_sample(ids, 10, 5, 3).count() == 200_000
    share = common.hash_sample(ids, 12_000, 10**13, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "1.2E-9" in share


def test_rows_without_an_id_are_mixed_one_by_one(spark):
    df = docs(spark, [(None, "same", "a")] * 1500 + [(7, "x", "a")] * 500)
    rows = mixing.mix(df, total=4000).collect()
    assert abs(len(rows) - 4000) < 300 and 4 < len({r["mix_n"] for r in rows}) < 15
    assert len({r["mix_key"] for r in rows}) == len(rows)


def test_repeated_rows_are_spread_over_buckets(spark):
    got = sharding.shuffle_to_shards(docs(spark, [(1, "same", "a")] * 3000)).toPandas()
    assert got.groupby("bucket").size().max() < 200 and sorted(got["position"].groupby(got["bucket"]).max() + 1) == sorted(got.groupby("bucket").size())
    assert got.groupby("shard").size().tolist() == [375] * 8


def test_shards_against_a_plain_shuffle(spark):
    rows = [(i, f"text {i}", "a") for i in range(300)]
    got = sharding.shuffle_to_shards(docs(spark, rows), 7, least_buckets=5, seed=4).toPandas()
    by = {b: sorted(zip(x["doc_id"], x["text"], strict=True)) for b, x in got.groupby("bucket")}
    place = 0
    want = {}
    for b in sorted(by):
        order = np.random.default_rng([4, b]).permutation(len(by[b]))
        for i in order:
            want[by[b][i][0]] = (place % 7, place // 7)
            place += 1
    assert {d: (s, k) for d, s, k in zip(got["doc_id"], got["shard"], got["slot"], strict=True)} == want


def test_one_of_each_decides_by_row(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "other text of some words"), (None, "a b c d e f"), (None, "alone and without an id"), (7, "z"), (7, "z"), (8, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(3)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = forest.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, "a b c d e f"), (5, "other text of some words"), (None, "alone and without an id"), (7, "z"), (8, ""), (8, None)], key=repr)


CLASHING = ["_key", "_spans", "_gone", "_gone_id", "_toxicity", "_source", "_mix_source", "_parts", "_cdf", "_number", "_doc", "_salt", "_same", "_n", "_again", "set_key", "root", "bucket"]


def test_columns_of_any_name_survive(spark):
    df = docs(spark, [(i, f"some text of number {i % 5} and more", f"s{i % 2}") for i in range(20)])
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    same = lambda out: all(r[c] == c for r in out.collect() for c in CLASHING)
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (toxicity.drop_toxic(df, model, 1.1), forest.one_of_each(df), suffixes.without_repeats(df, 100), mixing.mix(df)):
        assert out.count() and set(df.columns) <= set(out.columns) and same(out)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_joined_apart(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    left = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 900).alias("k"), "id")
    right = spark.range(-1, 800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_hot(left, right, "k", sizes, how)
    assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).select("k", "id", "v").collect()), key=repr)


def plain_fingerprint(data):
    """The same counted one triplet at a time."""
    data = data.ljust(5, b"\0")
    counts = Counter()
    for i in range(len(data) - 4):
        w = data[i : i + 5]
        for b in range(2, 5):
            for a in range(1, b):
                counts[int(fingerprints._tables[0][w[0]] ^ fingerprints._tables[a][w[a]] ^ fingerprints._tables[b][w[b]])] += 1
    ranked = sorted(counts[k] for k in range(256))
    q1, q2, q3 = ranked[63], ranked[127], ranked[191]
    return [sum(counts[k] > q for q in (q1, q2, q3)) for k in range(256)]


def test_fingerprints_count_every_triplet():
    rng = random.Random(3)
    for n in (0, 3, 5, 6, 40, 700):
        data = bytes(rng.randrange(97, 117) for _ in range(n))
        packed = fingerprints.fingerprint(data)
        assert [packed[k // 4] >> 2 * (k % 4) & 3 for k in range(256)] == plain_fingerprint(data)
        assert packed[64] == round(12 * np.log2(n + 1))
    x, y = (fingerprints.fingerprint(bytes(rng.randrange(256) for _ in range(300))) for _ in range(2))
    steps = [abs((x[k // 4] >> 2 * (k % 4) & 3) - (y[k // 4] >> 2 * (k % 4) & 3)) for k in range(256)]
    assert fingerprints.difference(x, y) == sum({3: 6}.get(s, s) for s in steps) + abs(x[64] - y[64]) / 2


def test_training_counts_whole_texts(spark):
    """The probabilities equal those of a plain expectation maximisation over the same documents."""
    rng = random.Random(2)
    words = {"en": ["the", "stone", "of"], "de": ["der", "Straße", "donaudampfschifffahrtsgesellschaft"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(6)), x) for i in range(40) for x in [rng.choice(["en", "de"])]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=2)
    v = langid.pieces(model.path)
    counts = {x: Counter() for x in ("de", "en")}
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[x].update("▁" + w for w in t.split())
    assert model.languages == ["de", "en"]
    for k, x in enumerate(model.languages):
        p = np.full(v.n + 1, 1.0 / (v.n + 1))
        p[-1] = langid.UNKNOWN
        for _ in range(2):
            c = np.full(v.n + 1, 0.02)
            for w, n in counts[x].items():
                a, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
                find = lambda i, j, w=w: v.known.get(w[i:j], -1 if j == i + 1 else None)
                for j in range(1, len(w) + 1):
                    a[j] = sum(a[i] * p[q] for i in range(j) if (q := find(i, j)) is not None)
                for i in range(len(w) - 1, -1, -1):
                    b[i] = sum(b[j] * p[q] for j in range(i + 1, len(w) + 1) if (q := find(i, j)) is not None)
                for i in range(len(w)):
                    for j in range(i + 1, len(w) + 1):
                        if (q := find(i, j)) is not None:
                            c[q] += n * a[i] * p[q] * b[j] / a[-1]
            p = c / c.sum()
            p[-1] = langid.UNKNOWN
        assert np.allclose(model.probability[:, k], p, rtol=1e-6)


def test_the_sample_that_toxicity_is_fitted_on_is_bounded_in_bytes(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, calibrate: got.update(texts=texts))
    rows = [(i, None if i == 3 else "é" * (5_000 if i == 8 else 20), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    toxicity.train(docs(spark, rows), labels)
    assert len(got["texts"]) == len(learnt)
    long_one = zlib.crc32(b"8") % 5 != 0
    toxicity.train(docs(spark, rows), labels, sample_bytes=9_000)
    assert long_one and len(got["texts"]) == len(learnt) - 1
    toxicity.train(docs(spark, rows), labels, sample_bytes=400)
    assert sum(len((t or "").encode()) for t in got["texts"]) <= 400 and len(got["texts"]) >= 10
