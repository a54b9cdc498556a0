"""Likeness of phones by their features, as a dictionary table that is computed once and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vowels: height (0 high to 2 low), back, rounded (fixed values).
VOWELS = {"i": (0, 0, 0), "y": (0, 0, 1), "ɯ": (0, 1, 0), "u": (0, 1, 1), "e": (1, 0, 0), "œ": (1, 0, 1), "o": (1, 1, 1), "æ": (2, 0, 0), "a": (2, 1, 0)}
# Consonants: phone, manner, place, voiced (fixed values).
CONSONANTS = [
    ("p", "stop", "bilabial", False), ("pʰ", "stop", "bilabial", False), ("b", "stop", "bilabial", True),
    ("t", "stop", "alveolar", False), ("tʰ", "stop", "alveolar", False), ("d", "stop", "alveolar", True),
    ("k", "stop", "velar", False), ("kʰ", "stop", "velar", False), ("ɡ", "stop", "velar", True),
    ("c", "stop", "palatal", False), ("cʰ", "stop", "palatal", False), ("ɟ", "stop", "palatal", True),
    ("t͡ʃ", "affricate", "postalveolar", False), ("d͡ʒ", "affricate", "postalveolar", True), ("f", "fricative", "labiodental", False),
    ("v", "fricative", "labiodental", True), ("β", "fricative", "bilabial", True), ("s", "fricative", "alveolar", False),
    ("z", "fricative", "alveolar", True), ("ʃ", "fricative", "postalveolar", False), ("ʒ", "fricative", "postalveolar", True),
    ("h", "fricative", "glottal", False), ("β̞", "approximant", "bilabial", True), ("j", "approximant", "palatal", True),
    ("m", "nasal", "bilabial", True), ("n", "nasal", "alveolar", True), ("ɲ", "nasal", "palatal", True),
    ("ŋ", "nasal", "velar", True), ("l", "lateral", "alveolar", True), ("ɫ", "lateral", "alveolar", True),
    ("ɾ̞̊", "tap", "alveolar", False), ("ɾ", "tap", "alveolar", True),
]
# Penalties of neighbouring places (fixed values).
NEAR_PLACES = {("bilabial", "labiodental"): 0.12, ("alveolar", "postalveolar"): 0.14, ("postalveolar", "palatal"): 0.18, ("palatal", "velar"): 0.20, ("alveolar", "palatal"): 0.24}
OBSTRUENT, SONORANT = ("stop", "affricate", "fricative"), ("nasal", "lateral", "tap", "approximant")
SCHEMA = "phone string, class string, manner string, place string, voiced boolean, aspirated boolean, velarized boolean, height int, back int, rounded int, long int"


def inventory(spark: SparkSession) -> DataFrame:
    """All phones with their features."""
    vowels = [(v + mark, "vowel", None, None, None, None, None, *f, int(bool(mark))) for v, f in VOWELS.items() for mark in ("", "ː") if not (v == "æ" and mark)]
    consonants = [(p, "consonant", m, place, voiced, p.endswith("ʰ"), p == "ɫ", None, None, None, None) for p, m, place, voiced in CONSONANTS]
    return spark.createDataFrame(vowels + consonants, SCHEMA)


def likeness(a: str, b: str) -> Column:
    """1 for the same phone, 0.05 for a vowel and a consonant, else 1 less the penalties of the features that differ; vowels at least 0.30, consonants at least 0.12. a, b: struct columns of the inventory."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    unlike = lambda f, p: F.when(x(f) != y(f), p).otherwise(0.0)
    both = lambda f, *values: x(f).isin(*values) & y(f).isin(*values)
    vowel = F.least(0.12 * F.abs(x("height") - y("height")), F.lit(0.24)) + unlike("back", 0.20) + unlike("rounded", 0.16) + unlike("long", 0.24)
    manner = F.when(x("manner") == y("manner"), 0.0).when(both("manner", "stop", "affricate"), 0.20).when(both("manner", "fricative", "affricate"), 0.22)
    manner = manner.when(both("manner", *OBSTRUENT), 0.38).when(both("manner", *SONORANT), 0.28).otherwise(0.46)
    place = F.when(x("place") == y("place"), 0.0)
    for (p, q), penalty in NEAR_PLACES.items():
        place = place.when(both("place", p, q), penalty)
    place = place.when(both("place", "alveolar", "postalveolar", "palatal") | both("place", "palatal", "velar"), 0.28).when((x("place") == "glottal") | (y("place") == "glottal"), 0.42).otherwise(0.36)
    voicing = F.when(x("voiced") == y("voiced"), 0.0).when(both("manner", *SONORANT), 0.12).otherwise(0.17)
    consonant = manner + place + voicing + unlike("aspirated", 0.10) + unlike("velarized", 0.07)
    score = F.when(x("class") != y("class"), 0.05).when(x("class") == "vowel", F.greatest(1 - vowel, F.lit(0.30))).otherwise(F.greatest(1 - consonant, F.lit(0.12)))
    return F.when(x("phone") == y("phone"), 1.0).otherwise(F.round(score, 6))


def likeness_table(spark: SparkSession) -> DataFrame:
    """target, observed, likeness for all ordered pairs: a fixed dictionary of some 2,400 rows."""
    v = inventory(spark)
    pairs = v.select(F.struct("*").alias("x")).crossJoin(F.broadcast(v.select(F.struct("*").alias("y"))))
    return pairs.select(F.col("x.phone").alias("target"), F.col("y.phone").alias("observed"), likeness("x", "y").alias("likeness"))


def neighbours(phones: Column) -> Column:
    """Array of (target, observed): each phone with the one that follows it. The array is computed once."""
    pairs = lambda p: F.transform(p, lambda t, i: F.struct(t.alias("target"), F.get(p, i + 1).alias("observed")))
    last = lambda p: F.slice(pairs(p), F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
    return F.element_at(F.transform(F.array(phones), last), 1)


def with_duration(score: Column, target: Column, observed: Column, note: Column, reliable: Column) -> Column:
    """A likeness after evidence of duration: where the phones differ in length only and the evidence is reliable, at least 0.90 if it fits the target, at most 0.58 if not."""
    long = lambda c: F.endswith(c, F.lit("ː"))
    applies = (F.replace(target, F.lit("ː")) == F.replace(observed, F.lit("ː"))) & (long(target) != long(observed)) & F.coalesce(reliable, F.lit(False)) & note.isin("short", "expected", "long")
    fits = F.when(long(target), note.isin("expected", "long")).otherwise(note.isin("expected", "short"))
    return F.when(applies & fits, F.greatest(score, F.lit(0.90))).when(applies, F.least(score, F.lit(0.58))).otherwise(score)


def with_contrasts(score: Column, target: Column, observed: Column, candidates: Column) -> Column:
    """A likeness after pairwise contrasts, one after the other: 0.07 more (0.95 at most) for one that passes for the target,
    0.05 less for one that clearly rejects it (a margin of -0.05 or less) or passes for the observed phone. Equal phones
    stay. candidates: array of (to, passed, margin)."""

    def step(s: Column, c: Column) -> Column:
        passed, rejected = F.coalesce(c["passed"], F.lit(False)), F.coalesce(c["margin"] <= -0.05, F.lit(False))
        to_target, to_observed = F.coalesce(c["to"] == target, F.lit(False)), F.coalesce(c["to"] == observed, F.lit(False))
        less = F.greatest(s - 0.05, F.lit(0.0))
        return F.when(to_target & passed, F.least(s + 0.07, F.lit(0.95))).when(to_target & rejected, less).when(to_observed & passed & ~to_target, less).otherwise(s)

    return F.when(target == observed, score).otherwise(F.aggregate(candidates, score.cast("double"), step))
