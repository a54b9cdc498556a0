"""Measures of samples: spectra, loudness, periods, windows. What is arithmetic stays in the JVM; spectra go through Arrow in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let

SPECTRUM = "centroid double, bandwidth double, skew double, kurtosis double, low_ratio double, cepstrum array<double>, f0 double"


def _spectrum(x: np.ndarray, rate: int) -> tuple:
    """Moments of the magnitude spectrum (Hann window) over its frequencies, its share under 500 Hz, 13 mean log bins, and the period by autocorrelation."""
    none = (None,) * 7
    if x.size < 32:
        return none
    size = np.abs(np.fft.rfft(x * np.hanning(x.size)))
    at, total = np.fft.rfftfreq(x.size, 1.0 / rate), float(size.sum())
    if total <= 0:
        return none
    p = size / total
    mean = float(at @ p)
    var = float((at - mean) ** 2 @ p)
    z = (at - mean) / np.sqrt(var) if var > 0 else None
    bins = [float(np.log1p(b).mean()) for b in np.array_split(size, 13)]
    return mean, var**0.5, None if z is None else float(z**3 @ p), None if z is None else float(z**4 @ p) - 3.0, float(size[at < 500].sum()) / total, bins, _period(x, rate)


def _period(x: np.ndarray, rate: int) -> float | None:
    """The frequency from 60 to 500 Hz at the greatest autocorrelation; null for a flat or too short stretch."""
    if x.size < rate // 100:
        return None
    c = x - x.mean()
    n = 1 << (2 * c.size - 1).bit_length()
    f = np.fft.rfft(c, n)
    corr = np.fft.irfft(f * np.conj(f), n)[: c.size]
    low, high = max(1, rate // 500), min(c.size, rate // 60)
    if corr[0] <= 0 or high <= low:
        return None
    return rate / int(np.argmax(np.round(corr[low:high], 12)) + low)


def spectrum(samples: Column, rate: int) -> Column:
    """A struct of spectral measures of an array of samples; nulls where it is too short or silent."""

    @F.pandas_udf(SPECTRUM)
    def measure(xs: pd.Series) -> pd.DataFrame:
        rows = [_spectrum(np.asarray(x, float), rate) if x is not None else (None,) * 7 for x in xs]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SPECTRUM.split(", ")])

    return measure(samples)


def mean_square(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples)


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(mean_square(samples)))


def intensity(samples: Column) -> Column:
    """Loudness in dB."""
    return 20 * F.log10(rms(samples) + 1e-12)


def frame_starts(n: Column, length: int, hop: int) -> Column:
    """Starts of frames, one that ends with the samples included."""
    last = n - length
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop))
    return F.when(last > 0, F.array_distinct(F.concat(regular, F.array(last)))).otherwise(F.array(F.lit(0)))


def loud_frames(samples: Column, length: int, hop: int) -> Column:
    """Starts of the frames that have three times the noise (the 20th percentile of the frames' RMS) and at least 0.01."""

    def limit(loud: Column) -> Column:
        place = F.lit(0.2) * (F.size(loud) - 1)
        noise = let(F.array_sort(loud), lambda r: F.get(r, F.floor(place).cast("int")) + (place - F.floor(place)) * (F.get(r, F.ceil(place).cast("int")) - F.get(r, F.floor(place).cast("int"))))
        return F.greatest(noise * 3.0, F.lit(0.01))

    frames = F.transform(frame_starts(F.size(samples), length, hop), lambda s: F.struct(s.alias("s"), rms(F.slice(samples, s + 1, F.lit(length))).alias("v")))
    loud = lambda fs: let(limit(F.transform(fs, lambda x: x["v"])), lambda least: F.transform(F.filter(fs, lambda x: x["v"] >= least), lambda x: x["s"]))
    return let(frames, loud)


def speech_region(samples: Column, rate: int) -> Column:
    """start_ms, end_ms, status: the stretch between the first and the last frame that is loud, with 40 ms around it.

    Frames are 20 ms every 10 ms; loud is three times the noise (the 20th percentile of the frames' RMS) and at least
    0.01. Without a loud frame the whole stretch, as no_speech_fallback.
    """
    length, hop = max(1, round(rate * 0.02)), max(1, round(rate * 0.01))
    n = F.size(samples)
    ms = lambda k: F.bround(k * 1000.0 / rate).cast("long")

    def region(hits: Column) -> Column:
        whole = F.greatest(ms(n), F.lit(1).cast("long"))
        start = F.greatest(ms(F.get(hits, F.lit(0))) - 40, F.lit(0).cast("long"))
        end = F.least(ms(F.least(n, F.element_at(hits, -1) + length)) + 40, whole)
        none = F.size(hits) == 0
        return F.struct(F.when(none, F.lit(0).cast("long")).otherwise(start).alias("start_ms"), F.when(none, whole).otherwise(end).alias("end_ms"), F.when(none, "no_speech_fallback").otherwise("ok").alias("status"))

    return let(loud_frames(samples, length, hop), region)


def quality_gate(duration_ms: Column, loudness: Column) -> Column:
    """too_short under 250 ms, silent under an RMS of 10 (16-bit steps), else ok."""
    return F.when(duration_ms < 250, "too_short").when(loudness < 10, "silent").otherwise("ok")


def measurement_window(start: Column, end: Column, voiced_start: Column, voiced_end: Column, policy: float = 80.0) -> Column:
    """start_ms, end_ms: about the middle of the voiced part of a span, or of the span; 60 % of it, `policy` ms at most, 1 ms at least."""
    a, b = F.greatest(start, voiced_start), F.least(end, voiced_end)
    voiced = voiced_start.isNotNull() & voiced_end.isNotNull() & (voiced_end > voiced_start) & (b > a)
    lo, hi = F.when(voiced, a).otherwise(start), F.when(voiced, b).otherwise(end)
    half = F.greatest(F.least(F.lit(policy), (hi - lo) * 0.6) / 2, F.lit(0.5))
    centre = (lo + hi) / 2
    return F.struct(F.greatest(lo, centre - half).alias("start_ms"), F.least(hi, centre + half).alias("end_ms"))


def nucleus_window(start: Column, end: Column, known_start: Column, known_end: Column, width: int = 80) -> Column:
    """start_ms, end_ms, status: a known window within the span, or `width` ms about the span's middle."""
    a, b = F.greatest(start, known_start), F.least(end, known_end)
    known = F.coalesce((known_end > known_start) & (b > a), F.lit(False))
    size = F.greatest(F.least(F.lit(width), end - start), F.lit(1))
    left = F.greatest(start, F.bround((start + end) / 2.0).cast("long") - F.floor(size / 2))
    right = F.least(left + size, end)
    return F.struct(F.when(known, a).otherwise(right - size).alias("start_ms"), F.when(known, b).otherwise(right).alias("end_ms"), F.when(known, "legacy_intersection").otherwise("synthesized_center").alias("status"))


#: Widths in ms of a class's analysis window, and of what a stop's reaches back (fixed values).
WINDOWS = {"stop": 150, "affricate": 150, "sonorant": 80, "fricative": 60, "vowel": 90}
STOP_BACK = 30


def class_window(kind: Column, start: Column, end: Column, whole: Column) -> Column:
    """start_ms, end_ms of the window that a class of phones is analysed in: stops reach back for the closure and on for the
    burst, sonorants on into the transition, fricatives and vowels widen about the middle."""
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv]), kind), F.lit(0))
    s, e = F.greatest(start, F.lit(0)), F.least(end, whole)
    middle = F.least(whole, F.greatest(e, F.floor((s + e) / 2) + F.floor(width / 2)))
    brief = kind.isin("stop", "affricate")
    a = F.when(brief, F.greatest(s - STOP_BACK, F.lit(0))).when(kind == "sonorant", s).otherwise(F.greatest(middle - width, F.lit(0)))
    b = F.when(brief | (kind == "sonorant"), F.least(whole, F.greatest(e, s + width))).otherwise(middle)
    return F.struct(a.alias("start_ms"), b.alias("end_ms"))


def closure_burst(samples: Column, rate: int, frame_ms: float = 2.0, rise_db: float = 9.0) -> Column:
    """closure_ms, burst_ms, depth_db, confidence: the quietest of the first four fifths of the frames, and the first frame from
    there on that is rise_db louder. Nulls under five frames."""
    length = max(1, round(rate * frame_ms / 1000))
    n = F.floor(F.size(samples) / length).cast("int")
    ms = lambda i: i * length * 1000.0 / rate

    def found(db: Column, floor: Column) -> Column:
        first, depth = F.array_position(db, floor).cast("int") - 1, F.array_max(db) - floor
        later = F.filter(F.transform(db, lambda x, i: F.when(x >= floor + rise_db, i)), lambda i: i >= first)
        burst = F.when(depth >= rise_db, F.get(later, F.lit(0)))
        return F.struct(ms(first).alias("closure_ms"), ms(burst).alias("burst_ms"), depth.alias("depth_db"), F.when(burst.isNotNull(), F.least(depth / 30.0, F.lit(1.0))).alias("confidence"))

    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(20 * F.log10(rms(F.slice(samples, i * length + 1, F.lit(length))) + 1e-9), 9))
    early = lambda db: F.array_min(F.slice(db, F.lit(1), F.greatest(F.floor(n * 0.8).cast("int"), F.lit(1))))
    return F.when(n >= 5, let(frames, lambda db: let(early(db), lambda floor: found(db, floor))))


def slope(values: Column, step_ms: float) -> Column:
    """The least-squares slope of equally spaced values, in their unit a ms."""
    n = F.size(values)
    mean_x = (n - 1) / 2.0
    sxy = F.aggregate(F.transform(values, lambda v, i: (i - mean_x) * v.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sxx = n * (F.pow(n, F.lit(2.0)) - 1) / 12.0
    return F.try_divide(sxy, sxx * step_ms)


def cosine_transform(values: Column, k: int) -> Column:
    """The first k coefficients of the cosine transform (type II)."""
    n = F.size(values)
    one = lambda j: F.aggregate(F.transform(values, lambda v, i: v.cast("double") * F.cos(F.lit(np.pi) * (i + 0.5) * j / n)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)
