"""Formants, voicing, onsets, frication, resampling and decoding against known signals and plain versions."""

import itertools

import numpy as np
import pytest
from phonolake.functions import tracks as T
from pyspark.sql import functions as F

RATE = 11_000


def vowel(hz, width, seconds=0.4, pitch=100, rate=RATE, seed=0):
    """A pulse train through resonances."""
    x = np.zeros(int(seconds * rate))
    x[:: rate // pitch] = 1.0
    x += np.random.default_rng(seed).standard_normal(x.size) * 1e-4
    for f, b in zip(hz, width, strict=True):
        r, w = np.exp(-np.pi * b / rate), 2 * np.pi * f / rate
        y = np.zeros(x.size)
        for i in range(x.size):
            y[i] = x[i] + 2 * r * np.cos(w) * (y[i - 1] if i else 0) - r * r * (y[i - 2] if i > 1 else 0)
        x = y
    return x / np.abs(x).max() * 0.5


def column(spark, rows, types="k int, x array<double>"):
    return spark.createDataFrame([(k, None if x is None else [float(v) for v in x]) for k, x in rows], types)


def test_burg_finds_a_known_process():
    rng = np.random.default_rng(1)
    x, a = np.zeros(20_000), [-1.3, 0.8, -0.2]
    for i in range(3, x.size):
        x[i] = -sum(a[k] * x[i - 1 - k] for k in range(3)) + rng.standard_normal()
    assert np.allclose(T.burg(x[None], 3)[0], a, atol=0.03)
    assert T.burg(np.zeros((2, 50)), 4).tolist() == [[0.0] * 4] * 2


def test_formants_of_a_vowel(spark):
    hz = [700, 1220, 2600]
    rows = [(1, vowel(hz, [60, 70, 110])), (2, [0.1] * 20), (3, None), (4, [])]
    got = {r["k"]: r["f"] for r in column(spark, rows).select("k", T.formant_track(F.col("x"), RATE).alias("f")).collect()}
    assert got[2] == [] and got[3] is None and got[4] == []
    for j, f in enumerate(hz):
        assert np.median([x["hz"][j] for x in got[1] if x["hz"][j]]) == pytest.approx(f, rel=0.06)
    assert len(got[1]) == (4400 - 550) // 82 + 1


def test_formants_move_together():
    """A glide: the second track rises; at a higher rate the samples are brought down first."""
    x = np.concatenate([vowel([500, f], [60, 80], 0.1, rate=22_000) for f in range(1000, 2000, 100)])
    track = T._formants(x, 22_000, 2, 6, 50.0, 7.5, 5500.0)
    second = [f["hz"][1] for f in track if f["hz"][1]]
    assert second[5] < 1300 and second[-5] > 1600


def test_the_cheapest_way_through_candidates():
    rng = np.random.default_rng(5)
    for _ in range(20):
        frames = [sorted((float(f), float(b)) for f, b in zip(rng.uniform(100, 4000, k), rng.uniform(20, 300, k), strict=True)) for k in rng.integers(2, 5, 4)]

        def cost(way):
            jumps = sum(abs(np.log2(b[0] / a[0])) for x, y in itertools.pairwise(way) for a, b in zip(x, y, strict=True))
            return jumps + 0.5 * sum(b / f for c in way for f, b in c)

        best = min(itertools.product(*[list(itertools.combinations(f, 2)) for f in frames]), key=cost)
        assert [tuple(x) for x in T.follow(frames, 2)] == list(best)
    assert T.follow([[], [(300.0, 50.0)]], 2) == [[None, None], [(300.0, 50.0), None]]


def test_a_stop_before_a_vowel(spark):
    rng = np.random.default_rng(3)
    silence, burst, voiced = np.zeros(550), rng.standard_normal(110) * 0.4, vowel([600, 1200], [80, 90], 0.2)
    aspiration = rng.standard_normal(440) * 0.02
    x = np.concatenate([silence, burst, aspiration, voiced])
    track = T.voicing_track(F.col("x"), RATE)
    got = column(spark, [(1, x), (2, np.zeros(2000)), (3, [0.0, 1.0]), (4, None)]).select("k", T.burst_ms(F.col("x"), RATE).alias("b"), T.voicing_onset_ms(track).alias("v")).orderBy("k").collect()
    assert got[0]["b"] == pytest.approx(50, abs=2.5) and 70 <= got[0]["v"] <= 110
    assert [(r["b"], r["v"]) for r in got[1:]] == [(None, None)] * 3


def test_voicing_lasts_down_to_the_lower_limit():
    strength = [0.2, 0.4, 0.6, 0.4, 0.36, 0.3, 0.4, 0.5]
    frames = T._voicing(np.zeros(100), 1000, 75, 500, 40, 10, 0.5, 0.35)
    assert not any(f["voiced"] for f in frames)
    state, out = False, []
    for s in strength:
        state = s >= 0.5 or state and s >= 0.35
        out.append(state)
    assert out == [False, False, True, True, True, False, False, True]
    x = np.sin(2 * np.pi * 100 * np.arange(2000) / 1000) * np.where(np.arange(2000) < 1000, 1, 0)
    v = [f["voiced"] for f in T._voicing(x, 1000, 75, 500, 40, 10, 0.5, 0.35)]
    assert all(v[:95]) and not any(v[101:])


def test_frication(spark):
    rng = np.random.default_rng(4)
    low = np.sin(2 * np.pi * 200 * np.arange(1100) / RATE) * 0.3
    hiss = np.diff(rng.standard_normal(1651)) * 0.3
    got = column(spark, [(1, np.concatenate([low, hiss, low])), (2, np.zeros(3000)), (3, [1.0]), (4, None)]).select("k", T.frication_interval(F.col("x"), RATE).alias("f"), T.low_ratio(F.col("x"), RATE).alias("r")).orderBy("k").collect()
    assert got[0]["f"]["start_ms"] >= 98 and got[0]["f"]["end_ms"] <= 252 and 0 < got[0]["r"] < 1
    assert all(r["f"]["start_ms"] is None and r["r"] is None for r in got[1:])
    ramp = np.repeat(10.0 ** (np.arange(40) / 40), 55)  # 20 dB in 40 frames of 5 ms
    assert column(spark, [(1, ramp)]).select(T.rise_db_per_ms(F.col("x"), RATE)).first()[0] == pytest.approx(0.1, abs=1e-6)


def test_edges_shrink_to_what_is_loud(spark):
    x = np.concatenate([np.full(3200, 0.001), np.full(3200, 0.3), np.full(3200, 0.001)])  # 200 ms each at 16 kHz
    spans = [(0, None, (190, 410)), (250, 350, None), (0, 150, None), (100, 300, (190, 300)), (500, 510, None), (590, 900, None)]
    for a, b, want in spans:
        got = column(spark, [(1, x)]).select(T.voiced_edges(F.col("x"), 16_000, F.lit(a), F.lit(b).cast("long")).alias("e")).first()["e"]
        if want is None:
            assert got is None
        else:
            assert abs(got["start_ms"] - want[0]) <= 10 and abs(got["end_ms"] - want[1]) <= 10


@pytest.mark.parametrize(("rate", "to"), [(16_000, 11_000), (8_000, 16_000), (44_100, 16_000), (1600, 1600)])
def test_resampling_keeps_what_fits(rate, to):
    t = np.arange(4000) / rate
    f = 0.2 * min(rate, to)
    y = T.resample_array(np.sin(2 * np.pi * f * t), rate, to)
    assert len(y) == -(-4000 * to // rate)
    at = np.arange(len(y)) / to
    inner = slice(200, -200)
    assert np.abs(y - np.sin(2 * np.pi * f * at))[inner].max() < 0.01
    if to < rate:  # what doesn't fit goes
        assert np.abs(T.resample_array(np.sin(2 * np.pi * 0.49 * rate * t), rate, to))[inner].max() < 0.01


def test_channels_of_any_length(spark):
    got = spark.createDataFrame([([[1.0, 2.0], [3.0]],), ([[4.0]],), ([],)], "c array<array<double>>").select(T.mix_down(F.col("c"))).collect()
    assert [r[0] for r in got] == [[2.0, 1.0], [4.0], []]


def test_decoding(spark):
    scores = [[0, 3, 1], [0, 3, 1], [5, 1, 1], [0, 9, 9], [0, 0, 2]]
    rows = spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(scores)], "i int, s array<double>")
    peaks = rows.select("i", T.frame_peak(F.col("s")).alias("p")).groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("f"))
    runs = peaks.select(T.decode_peaks(F.transform("f", lambda x: x["p"]["token"]), F.transform("f", lambda x: x["p"]["p"]), F.lit(100), [0]).alias("r")).first()["r"]
    p = [np.exp(s) / np.exp(s).sum() for s in np.array(scores, float)]
    assert [(r["token"], r["start_ms"], r["end_ms"]) for r in runs] == [(1, 0, 40), (1, 60, 80), (2, 80, 100)]
    assert [r["confidence"] for r in runs] == pytest.approx([(p[0][1] + p[1][1]) / 2, p[3][1], p[4][2]])
    empty = spark.createDataFrame([([], [])], "t array<int>, p array<double>").select(T.decode_peaks(F.col("t"), F.col("p"), F.lit(9), [0]).alias("r")).first()["r"]
    assert empty == []
