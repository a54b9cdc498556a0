"""Filter audit, periodic runs and neighbour votes: against brute force, on awkward rows, and on labels held out."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from phonolake.llm import audit, langid, neighbours, packing, periods, queries
from phonolake.llm.tokens import default_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, failed int, part string, runs string, key string, mark int, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "r", "k", 2, 0.5) for r in rows], SCHEMA)


def words_of(text):
    return periods.WORD.findall(text or "")


def test_popcounts_by_carries():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert audit.positional_popcount(words).tolist() == [int((words >> np.uint32(s) & 1).sum()) for s in range(32)]


def plain_audit(rows, labels):
    """Every filter order applied one after another to the documents themselves."""
    good, toxic = ({d for d, *m in labels if d is not None and m[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))

    def fails(f, d, t):
        w = words_of(t)
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and first[t] < d,
        }[f]

    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(d, {f for f in "ABCDE" if fails(f, d, t or "")}) for d, t, s in rows if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                removed_before = [1 for d, x in own if f in x and x & set(order[: step - 1])]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(removed_before), sum(x == {f} for _, x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\x1f\x85 a", "# a", "LOUD " * 300, "x " * 250, " ".join(f"w{i}" for i in range(260)), " ".join(f"W{i}|" for i in range(220)), "é " * 199 + "É", "a\0b"]
    rows = [(i % 60, rng.choice(texts), rng.choice([None, "", "s", "té"])) for i in range(150)] + [(None, "same", "s"), (None, "same", "s"), (3, "same", "s"), (3, "same", "s"), (9, "same", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in list(range(50)) * 2] + [(None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(table(spark, rows), marks).drop("filter").collect()
    want = plain_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want and len(got) == len(want)
    assert audit.audit(table(spark, rows[:0]), marks).count() == 0
    one = audit.audit(table(spark, rows), marks.where("doc_id < 0")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(one) == (0, 0)


def test_a_hot_text_and_many_parts(spark):
    rows = [(i, "the same text", f"p{i % 700}" if i % 3 else "hot") for i in range(4000)]
    got = audit.audit(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    e = got.where("filter_order = 'EABCD' AND step = 1").agg(F.sum("kept"), F.sum("removed"), F.count(F.lit(1))).first()
    assert tuple(e) == (1, 3999, len({r[2] for r in rows}))


def plain_runs(w):
    """All runs, by trying every period at every place."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            e = j + p
            if e - i >= max(12, 2 * p) and not any(p % d == 0 and all(w[k] == w[k + d] for k in range(i, e - d)) for d in range(1, p)):
                out.append((i, e - i, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def local_runs(w, deal=random.Random(0)):
    ids, spans = np.array(w, np.int64), []
    for period, _, at in periods.boundaries(ids, np.array([len(w)])):
        for lo, hi, some in periods.tiles(period, len(w), at):
            for p, own in periods.solve(ids[lo:hi].tolist(), period, (some - lo).tolist()).items():
                spans += [(p, lo + s, lo + e) for s, e in own]
    deal.shuffle(spans)
    out = []
    for p, s, e in sorted(spans):
        if out and out[-1][0] == p and s <= out[-1][2] - p:
            out[-1][2] = max(e, out[-1][2])
        else:
            out.append([p, s, e])
    return sorted(((s, e - s, p) for p, s, e in out), key=lambda r: (r[0], r[2]))


def wordy(rng, n=60):
    k = rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(rng.randint(0, n))]
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(1, 40)
        root = [rng.randrange(k) for _ in range(p)]
        w += [root[i % p] for i in range(rng.randint(p, 5 * p))] + [rng.randrange(k) for _ in range(rng.randint(0, 10))]
    return w


def test_runs_of_any_words():
    rng = random.Random(8)
    for _ in range(1200):
        w = wordy(rng)
        assert local_runs(w) == plain_runs(w)
    for w in (["a"] * 5000, list(range(700)) * 4, [0, 1] * 40 + [1, 0] * 40):
        w = np.unique(np.array(w), return_inverse=True)[1].tolist()
        assert local_runs(w) == plain_runs(w)


def test_chance_hashes_only_cost_work(monkeypatch):
    """Were every block alike to every other, the result would be the same."""
    monkeypatch.setattr(periods, "_MIX", np.uint64(0))
    rng = random.Random(9)
    for _ in range(100):
        w = wordy(rng)
        assert local_runs(w) == plain_runs(w)


def test_octaves_reach_every_run():
    for k in range(20):
        block, step = periods.octave(1 << k)
        assert block >= 4 and step >= 1 and all(step + block - 1 + p <= max(12, 2 * p) for p in range(1 << k, 2 << k))


def plain_collapse(w):
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "a " * 11, "a " * 12, "a\x85b\x1c " * 30, "x y\tz\n" * 9 + "x", "é ü " * 400]
    texts += [" ".join(f"w{x}" for x in wordy(rng, 200)) for _ in range(120)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "q " * 30, "s")] * 3 + [(None, "r s " * 9, None), (None, None, None), (None, "r s " * 9, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for d, t, _ in rows:
        runs, text = plain_collapse(periods.plant(d, words_of(t)))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((d, len(runs), *(best or [None] * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 60
    assert periods.collapse_runs(table(spark, rows[:0])).count() == 0


def test_a_very_long_text(spark):
    long = "same " * 300_000
    other = " ".join(f"w{i % 40_000}" for i in range(150_000))
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periods.collapse_runs(table(spark, [(1, long, "s"), (2, other, "s")])).collect()}
    assert got[1] == ("same", [(0, 300_000, 1)]) and got[2] == (" ".join(f"w{i}" for i in range(40_000)), [(0, 150_000, 40_000)])


def test_planting_by_id():
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g, words = zlib.crc32(str(d).encode()) // 10, [f"w{i}" for i in range(100)]
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert periods.plant(d, words) == [words[i if i < a else a + (i - a) % p] for i in range(100)]
    assert periods.plant(None, words) == words and periods.plant(d + 1, words) in (words, periods.plant(d + 1, words)) and periods.plant(d, []) == []


def test_words_are_hashed_apart():
    text = "eins zwei\teins  drei zwei\x0b\x85eins eins"
    h = neighbours.word_hashes(np.frombuffer(text.encode(), np.uint8)).tolist()
    words = words_of(text)
    assert len(h) == len(words) and [[a == b for a in h] for b in h] == [[a == b for a in words] for b in words]
    assert len(neighbours.word_hashes(np.zeros(0, np.uint8))) == 0


def test_votes_against_all_distances():
    rng = np.random.default_rng(6)
    labelled = rng.standard_normal((5000, 8)).astype(np.float32)
    labelled /= np.linalg.norm(labelled, axis=1, keepdims=True)
    model = neighbours.Model(np.ones(1), np.ones((1, 1)), labelled, rng.integers(0, 2, 5000).astype(np.float32), 0.7)
    x = labelled[:40] + 0.1
    x[7] = 0
    got = neighbours.vote(model, x)
    for i in range(40):
        c = [(float(v @ x[i]), float(m)) for v, m in zip(labelled, model.labels, strict=True)]
        c = sorted(c, reverse=True)[: neighbours.K]
        w = [max(0.0, a) ** neighbours.SHARPNESS for a, _ in c]
        want = sum(a * m for a, (_, m) in zip(w, c, strict=True)) / sum(w) if sum(w) > 1e-9 else 0.7
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_directions_are_those_of_the_decomposition():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((300, 10)) * 2.0 ** -np.arange(10)) @ rng.standard_normal((10, 50))
    q = neighbours.leading_directions(x.astype(np.float32), 4)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(q @ q.T, v[:4].T @ v[:4], atol=1e-2)


def test_quality_of_labels_held_out(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["stone", "river", "of", "the", "and", "alpha", "wood", "light"]

    def text(bad):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        return " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w).capitalize() + "."

    rows = [(i, text(i % 5 == 0), "s") for i in range(600)]
    table(spark, [*rows, (None, "no id", None), (3, rows[3][1], None), (1000, None, None), (1001, "", None), (1002, "x" * 500_000, None), (1003, "文" * 200_000, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 5 != 0)) for i in range(600)] + [(3, 0), (None, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_neighbour_votes(spark, str(tmp_path)).collect()
    assert len(got) == 606 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held) and sum(r["predicted"] == (r["doc_id"] % 5 != 0) for r in held) >= 0.98 * len(held)
    empty = {r["score"] for r in got if r["doc_id"] in (1000, 1001)}
    assert len(empty) == 1 and 0.7 < empty.pop() < 0.9
    model = neighbours.train(table(spark, rows[:0]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in neighbours.score(table(spark, rows[:2]), model).collect()] == [0.5, 0.5]
    assert neighbours.score(table(spark, rows[:0]), model).count() == 0


def test_many_small_partitions_fill_their_windows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 400))), "s") for i in range(1500)]
    got = packing.pack(table(spark, rows).repartition(200)).select("sequence_id", "length").toPandas()
    full = got["length"].sum() / (got["sequence_id"].nunique() * 2048)
    assert full >= 0.98
    few = packing.pack(table(spark, rows[:200]).repartition(40), task_bytes=1 << 16)  # several tasks still
    assert few.rdd.getNumPartitions() > 1 and few.agg(F.sum("length")).first()[0] == packing.pack(table(spark, rows[:200])).agg(F.sum("length")).first()[0]


def plain_sums(v, w, p):
    """a and b of every place by plain recursion with Python's floats in logs, and the counts of all pieces."""
    n, ids = len(w), {}
    for to in range(1, n + 1):
        for at in range(max(0, to - v.longest), to):
            k = v.known.get(w[at:to], v.n if at == to - 1 else None)
            if k is not None:
                ids[at, to] = k
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0.0
    for at, to in sorted(ids, key=lambda x: x[1]):
        a[to] = np.logaddexp(a[to], a[at] + np.log(p[ids[at, to]]))
    for at, to in sorted(ids, key=lambda x: -x[0]):
        b[at] = np.logaddexp(b[at], b[to] + np.log(p[ids[at, to]]))
    counts = np.zeros(v.n + 1)
    for (at, to), k in ids.items():
        counts[k] += np.exp(a[at] + np.log(p[k]) + b[to] - a[n])
    return a[n], counts


def test_long_words_are_summed_by_segments(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENTS", 5)  # several rounds of segments
    v, rng = langid.pieces(default_path("piece_bpe_32k.model")), random.Random(6)
    p = np.random.default_rng(2).random((v.n + 1, 2)) ** 3
    p /= p.sum(0)
    p[-1] = langid.UNKNOWN
    for n in (1, 24, 25, 300, 700):
        w = "▁" + "".join(rng.choice(["the", "ing", "straße", "Ж", "文", "q", "z", "estación"]) for _ in range(n))
        total, counts = plain_sums(v, w, p[:, 0])
        got = np.zeros(v.n + 1)
        for k, x in langid.expected_long(v, w, 3.0, p[:, 0]):
            got[k] += x
        assert np.allclose(langid.forward_long(v, w, p)[0], total) and np.allclose(got, 3 * counts, atol=1e-6)


def test_texts_without_spaces(spark):
    """Words of hundreds of thousands of letters, in the texts learnt from and in those that are asked for."""
    rng = random.Random(1)
    long = {x: "".join(rng.choice(s) for _ in range(200_000)) for x, s in (("en", ["the", "stone", "and"]), ("de", ["der", "straße", "und"]))}
    rows = [(i, text, lang) for i, (lang, text) in enumerate(list(long.items()) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(df, langid.train(df)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: lang for i, _, lang in rows}
