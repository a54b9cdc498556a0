"""Measures frame by frame: formants, voicing, onsets, frication; resampling; decoding of scores by frame.

What is a recursion or needs roots runs through Arrow in batches, all frames of an utterance at once in arrays.
"""

from __future__ import annotations

from itertools import combinations
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let
from .signals import loud_frames


def frames_of(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Whole frames, one a row; none if the samples are fewer."""
    if x.size < length:
        return np.zeros((0, length))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def burg(frames: np.ndarray, order: int) -> np.ndarray:
    """Coefficients a of x[t] + a1 x[t-1] + ... = noise for every frame, by Burg's recursion over forward and backward errors."""
    ahead, behind = frames[:, 1:], frames[:, :-1]
    a = np.zeros((len(frames), 0))
    for _ in range(order):
        power = (ahead**2).sum(1) + (behind**2).sum(1)
        k = np.where(power > 0, -2 * (ahead * behind).sum(1) / np.where(power > 0, power, 1), 0.0)[:, None]
        a = np.hstack([a + k * a[:, ::-1], k])
        ahead, behind = (ahead + k * behind)[:, 1:], (behind + k * ahead)[:, :-1]
    return a


def resonances(a: np.ndarray, rate: float, least_hz: float = 50.0) -> list[list[tuple[float, float]]]:
    """(frequency, bandwidth) of each frame's poles above the real line, by frequency; those within least_hz of 0 or of half the rate are none."""
    order = a.shape[1]
    companion = np.zeros((len(a), order, order))
    companion[:, 0, :] = -a
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1
    out = []
    for roots in np.linalg.eigvals(companion):
        r = roots[roots.imag > 1e-12]
        f, b = np.angle(r) * rate / (2 * np.pi), -np.log(np.abs(r)) * rate / np.pi
        keep = (f > least_hz) & (f < rate / 2 - least_hz)
        out.append(sorted(zip(f[keep].tolist(), b[keep].tolist(), strict=True)))
    return out


def follow(candidates: list[list[tuple[float, float]]], n: int, width_cost: float = 0.5) -> list[list[tuple[float, float] | None]]:
    """Of each frame's candidates n in rising order, so that they jump least (in octaves) from frame to frame and are narrow.

    The cheapest way through all frames, found frame by frame; a frame with fewer candidates leaves the last tracks open.
    """
    ways: list[tuple[float, tuple | None]] = [(0.0, None)]  # cost, (choice, way before)
    for found in candidates:
        found = found[: n + 3]
        choices = list(combinations(found, min(n, len(found))))
        after = []
        for choice in choices:
            own = width_cost * sum(b / f for f, b in choice)
            cost = lambda way: way[0] + (sum(abs(np.log2(c[0] / p[0])) for c, p in zip(choice, way[1][0], strict=False)) if way[1] else 0.0)  # noqa: B023, E731
            best = min(ways, key=cost)
            after.append((cost(best) + own, (choice, best)))
        ways = after
    out, way = [], min(ways, key=lambda w: w[0])
    while way[1]:
        out.append([*way[1][0], *[None] * (n - len(way[1][0]))])
        way = way[1][1]
    return out[::-1]


TRACK = "array<struct<t_ms:double,hz:array<double>,width:array<double>>>"


def _formants(x: np.ndarray, rate: int, n: int, order: int, frame_ms: float, step_ms: float, most_hz: float) -> list[dict]:
    if rate > 2 * most_hz:
        x, rate = resample_array(x, rate, round(2 * most_hz)), round(2 * most_hz)
    x = np.append(x[:1], x[1:] - np.exp(-2 * np.pi * 50 / rate) * x[:-1])
    length, hop = max(order + 2, round(rate * frame_ms / 1000)), max(1, round(rate * step_ms / 1000))
    frames = frames_of(x, length, hop)
    if not len(frames):
        return []
    tracks = follow(resonances(burg(frames * np.hanning(length), order), rate), n)
    return [{"t_ms": (i * hop + length / 2) * 1000.0 / rate, "hz": [c and c[0] for c in f], "width": [c and c[1] for c in f]} for i, f in enumerate(tracks)]


def formant_track(samples: Column, rate: int, n: int = 3, order: int = 10, frame_ms: float = 50.0, step_ms: float = 7.5, most_hz: float = 5500.0) -> Column:
    """The first n formants over time: poles of an all-pole model of every (pre-emphasised, windowed) frame, followed through the frames.

    Null samples give null, fewer than a frame an empty track; a formant that a frame lacks is null.
    """

    @F.pandas_udf(TRACK)
    def track(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _formants(np.asarray(x, float), rate, n, order, frame_ms, step_ms, most_hz) for x in xs])

    return track(samples)


def transition_slope(first: Column, last: Column, duration_ms: Column) -> Column:
    """Hz a ms from one value to another; null without both or a duration."""
    return F.when(duration_ms > 0, (last - first) / duration_ms)


def burg_coefficients(samples: Column, order: int) -> Column:
    """The all-pole model of whole arrays."""

    @F.pandas_udf("array<double>")
    def model(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) <= order else burg(np.asarray(x, float)[None], order)[0].tolist() for x in xs])

    return model(samples)


VOICING = "array<struct<t_ms:double,strength:double,voiced:boolean>>"


def _voicing(x: np.ndarray, rate: int, low_hz: float, high_hz: float, frame_ms: float, hop_ms: float, on: float, off: float) -> list[dict]:
    length, hop = round(rate * frame_ms / 1000), max(1, round(rate * hop_ms / 1000))
    frames = frames_of(x, length, hop)
    strength = np.zeros(len(frames))
    for lag in range(max(1, int(rate / high_hz)), min(length - 1, int(rate / low_hz)) + 1):
        a, b = frames[:, :-lag], frames[:, lag:]
        power = np.sqrt((a**2).sum(1) * (b**2).sum(1))
        strength = np.maximum(strength, np.where(power > 1e-8, (a * b).sum(1) / np.where(power > 1e-8, power, 1), 0.0))
    out, voiced = [], False
    for i, s in enumerate(np.round(strength, 9).tolist()):
        voiced = s >= on or voiced and s >= off
        out.append({"t_ms": i * hop * 1000.0 / rate, "strength": s, "voiced": voiced})
    return out


def voicing_track(samples: Column, rate: int, low_hz: float = 75.0, high_hz: float = 600.0, frame_ms: float = 40.0, hop_ms: float = 10.0, on: float = 0.5, off: float = 0.35) -> Column:
    """Each frame's greatest normalised autocorrelation over the periods of low_hz to high_hz; voicing begins at `on` and lasts down to `off`."""

    @F.pandas_udf(VOICING)
    def track(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _voicing(np.asarray(x, float), rate, low_hz, high_hz, frame_ms, hop_ms, on, off) for x in xs])

    return track(samples)


def frame_rms(samples: Column, length: int) -> Column:
    """RMS of frames side by side; what is left over at the end is none."""
    n = F.floor(F.size(samples) / length).cast("int")
    one = lambda i: F.sqrt(F.aggregate(F.slice(samples, i * length + 1, F.lit(length)), F.lit(0.0), lambda s, x: s + x * x) / length)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def burst_ms(samples: Column, rate: int, frame_ms: float = 2.0) -> Column:
    """Where the first frame is that has half the RMS of the loudest; null under four frames or in silence."""
    length = max(1, round(rate * frame_ms / 1000))

    def first(v: Column) -> Column:
        top = F.array_max(v)
        at = F.get(F.filter(F.transform(v, lambda x, i: F.when(x >= 0.5 * top, i)), lambda i: i.isNotNull()), F.lit(0))
        return F.when((F.size(v) >= 4) & (top >= 1e-4), at * length * 1000.0 / rate)

    return let(frame_rms(samples, length), first)


def voicing_onset_ms(track: Column) -> Column:
    """Where a voicing track is voiced first."""
    return F.get(F.filter(track, lambda f: f["voiced"]), F.lit(0))["t_ms"]


def rise_db_per_ms(samples: Column, rate: int, frame_ms: float = 5.0) -> Column:
    """The slope of loudness over the first half of the frames (three at least); null under six."""
    length = max(1, round(rate * frame_ms / 1000))
    step = length * 1000.0 / rate

    def slope(v: Column) -> Column:
        half = F.greatest(F.lit(3), F.floor(F.size(v) / 2).cast("int"))
        middle = (half - 1) / 2.0
        db = F.transform(F.slice(v, F.lit(1), half), lambda x, i: (i - middle) * 20 * F.log10(x + 1e-9))
        return F.when(F.size(v) >= 6, F.aggregate(db, F.lit(0.0), lambda s, x: s + x) / (half * (half * half - 1) / 12.0 * step))

    return let(frame_rms(samples, length), slope)


FRICATION = "start_ms double, end_ms double"


def _frication(x: np.ndarray, rate: int, cutoff_hz: float, frame_ms: float) -> tuple:
    length = max(1, round(rate * frame_ms / 1000))
    frames = frames_of(x, length, length)
    if len(frames) < 3:
        return None, None
    size = np.abs(np.fft.rfft(frames * np.hanning(length), axis=1))
    high = np.round(size[:, np.fft.rfftfreq(length, 1 / rate) >= cutoff_hz].sum(1), 9)
    if not high.any():
        return None, None
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (high >= 0.5 * high.max()).astype(int), [0]])))
    start, end = edge[::2], edge[1::2]
    k = int(np.argmax(end - start))
    return float(start[k] * length * 1000 / rate), float(end[k] * length * 1000 / rate)


def frication_interval(samples: Column, rate: int, cutoff_hz: float = 2000.0, frame_ms: float = 5.0) -> Column:
    """start_ms, end_ms of the longest stretch (the first of equal ones) whose energy above cutoff_hz is half the greatest or more."""

    @F.pandas_udf(FRICATION)
    def interval(xs: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else _frication(np.asarray(x, float), rate, cutoff_hz, frame_ms) for x in xs]
        return pd.DataFrame(rows, columns=["start_ms", "end_ms"], dtype=float)

    return interval(samples)


def low_ratio(samples: Column, rate: int, cutoff_hz: float = 500.0) -> Column:
    """The share of the magnitudes below cutoff_hz (Hann window): high in a nasal murmur. Null under 32 samples or in silence."""

    @F.pandas_udf("double")
    def share(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            size = np.zeros(0) if x is None or len(x) < 32 else np.abs(np.fft.rfft(np.asarray(x, float) * np.hanning(len(x))))
            out.append(float(size[np.fft.rfftfreq(len(x), 1 / rate) < cutoff_hz].sum() / size.sum()) if size.sum() > 0 else None)
        return pd.Series(out, dtype=float)

    return share(samples)


def voiced_edges(samples: Column, rate: int, start_ms: Column, end_ms: Column) -> Column:
    """start_ms, end_ms of what is loud within a span, without anything around it; null where nothing is, or under 20 ms.

    Loud is as in speech_region, with the noise of the span itself.
    """
    length, hop = max(1, round(rate * 0.02)), max(1, round(rate * 0.01))
    ms = lambda k: F.bround(k * 1000.0 / rate).cast("long")
    at = lambda t: F.bround(t * rate / 1000.0).cast("int")
    whole = ms(F.size(samples))
    a = F.greatest(start_ms, F.lit(0)).cast("long")
    b = F.greatest(a, F.least(whole, F.coalesce(end_ms, whole))).cast("long")
    first, last = at(a), F.least(F.size(samples), at(b))

    def edges(region: Column, hits: Column) -> Column:
        s, e = a + ms(F.get(hits, F.lit(0))), a + ms(F.least(F.size(region), F.element_at(hits, -1) + length))
        return F.when((F.size(hits) > 0) & (e > s), F.struct(s.alias("start_ms"), e.alias("end_ms")))

    region = F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))
    found = let(region, lambda x: let(loud_frames(x, length, hop), lambda hits: edges(x, hits)))
    return F.when((b - a >= 20) & (last - first >= length), found)


def mix_down(channels: Column) -> Column:
    """The mean of channels, sample by sample; those that are shorter count as silent there."""
    n = F.size(channels)
    total = F.aggregate(channels, F.array().cast("array<double>"), lambda s, c: F.zip_with(s, c, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y.cast("double"), F.lit(0.0))))
    return F.transform(total, lambda x: x / n)


#: Zero crossings of the sinc on each side of the filter.
CROSSINGS = 16


def resample_array(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A windowed-sinc filter, evaluated for the phases that occur only (as many as the rates' ratio has)."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    n = -(-x.size * up // down)
    if up == down or not x.size:
        return np.array(x, float)
    cut = min(1.0, up / down)
    reach = int(np.ceil(CROSSINGS / cut))
    phase = (np.arange(up) * down % up) / up  # of outputs 0, 1, ... in turn
    t = phase[:, None] - np.arange(-reach + 1, reach + 1)[None]
    taps = cut * np.sinc(cut * t) * np.where(np.abs(t) < reach, 0.5 + 0.5 * np.cos(np.pi * t / reach), 0.0)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    out = np.empty(n)
    for p in range(up):
        at = np.arange(p, n, up) * down // up
        out[p::up] = windows[at + 1] @ taps[p]
    return out


def resample(samples: Column, rate: int, to: int) -> Column:
    """Samples at another rate."""

    @F.pandas_udf("array<double>")
    def at(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else resample_array(np.asarray(x, float), rate, to).tolist() for x in xs])

    return at(samples)


def frame_peak(scores: Column) -> Column:
    """token (the place of the greatest score, the first of equal ones), p (its softmax) of one frame."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("token"), (1 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))).alias("p"))


DECODED = "array<struct<token:int,start_ms:bigint,end_ms:bigint,confidence:double>>"


def decode_peaks(tokens: Column, p: Column, total_ms: Column, drop: list[int]) -> Column:
    """Frames in order, folded into runs of one token; dropped tokens part runs but are none. A run's confidence is its frames' mean."""

    @F.pandas_udf(DECODED)
    def fold(ts: pd.Series, ps: pd.Series, totals: pd.Series) -> pd.Series:
        out = []
        for t, q, total in zip(ts, ps, totals, strict=True):
            t, q = np.asarray(t, np.int64), np.asarray(q, float)
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, int)
            runs = [(int(t[a]), round(a * total / len(t)), round(b * total / len(t)), float(q[a:b].mean())) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            out.append([dict(zip(("token", "start_ms", "end_ms", "confidence"), r, strict=True)) for r in runs if r[0] not in drop])
        return pd.Series(out)

    return fold(tokens, p, total_ms)
