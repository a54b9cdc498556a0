"""The phone inventory and what is known of each phone: classes, evidence, length pairs. Fixed values, and columns over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The inventory in its order (fixed values).
SHORT = ["a", "e", "i", "ɯ", "o", "œ", "u", "y"]
LONG = ["aː", "eː", "iː", "ɯː", "oː", "œː", "uː", "yː"]
OPEN_E = "æ"
CONSONANTS = ["p", "b", "t", "d", "k", "ɡ", "t͡ʃ", "d͡ʒ", "f", "v", "s", "z", "ʃ", "ʒ", "h", "m", "n", "l", "ɾ", "j"]
BASE_ALLOPHONES = ["c", "ɟ", "ɲ", "ŋ", "ɫ", "β", "β̞"]
EXTRA_ALLOPHONES = ["pʰ", "tʰ", "kʰ", "cʰ", "ɾ̞̊"]
VOWELS = [*SHORT, *LONG, OPEN_E]
PHONES = [*VOWELS, *CONSONANTS, *BASE_ALLOPHONES, *EXTRA_ALLOPHONES]
STRESS, SPACE = "ˈ", "<spc>"
SONORANTS = ["l", "ɫ", "m", "n", "ɲ", "ŋ", "ɾ", "ɾ̞̊", "j"]
STOPS = ["p", "b", "t", "d", "k", "ɡ", "c", "ɟ", "pʰ", "tʰ", "kʰ", "cʰ"]
AFFRICATES = ["t͡ʃ", "d͡ʒ"]
#: The strongest source of evidence for a phone, where it is not the model (fixed values).
EVIDENCE = {"manual-only": ["pʰ", "tʰ", "kʰ", "cʰ", "ɾ̞̊", "β", "β̞"], "rule-only": [OPEN_E], "feature-derived": [*LONG, STRESS]}
#: Letters that count as vowels where durations are judged (fixed values).
VOWEL_LETTERS = "aeiouâîûAEIOUÂÎÛ"


def evidence_types(spark: SparkSession) -> DataFrame:
    """phone, evidence_type: a dictionary of fixed size."""
    kind = {p: k for k, ps in EVIDENCE.items() for p in ps}
    return spark.createDataFrame([(p, kind.get(p, "model-observable")) for p in [*PHONES, STRESS]], "phone string, evidence_type string")


def phone_class(phone: Column) -> Column:
    return F.when(phone.isin(VOWELS), "vowel").when(phone.isin(STOPS), "stop").when(phone.isin(AFFRICATES), "affricate").when(phone.isin(SONORANTS), "sonorant").otherwise("fricative")


def short_of(phone: Column) -> Column:
    """The short partner of a long vowel, else null."""
    return F.when(phone.isin(LONG), F.replace(phone, F.lit("ː")))


def long_of(phone: Column) -> Column:
    return F.when(phone.isin(SHORT), F.concat(phone, F.lit("ː")))


def contrast_class(status: Column, expected: Column, observed: Column) -> Column:
    """missing, vowel or consonant."""
    lost = (F.coalesce(status, F.lit("")) == "missing") | observed.isNull() | (observed == "")
    return F.when(lost, "missing").when(expected.isin(VOWELS), "vowel").otherwise("consonant")


def confidence_reasons(phone: Column, duration: Column, formants: Column, voiced: Column, active: Column) -> Column:
    """Why a measurement can't be trusted; none if it can. What is asked depends on the phone's class.

    Stops and affricates may be short; only vowels, sonorants and phones without a class need formants; vowel letters need voice.
    """
    kind = phone_class(phone)
    brief = kind.isin("stop", "affricate")
    reasons = [
        F.when((duration < 20) & ~brief, "span_too_short"),
        F.when((phone.isNull() | kind.isin("vowel", "sonorant")) & ~formants, "formant_extraction_failed"),
        F.when(phone.isin(list(VOWEL_LETTERS)) & (voiced < 0.3), "insufficient_voicing"),
        F.when((active < 15) & ~brief, "active_signal_too_short"),
    ]
    return F.array_compact(F.array(*reasons))


def duration_notes(phone: Column, before: Column, after: Column, voiced: Column) -> tuple[Column, Column]:
    """(reliability, notes): 0 without voiced edges, else 0.5 for a vowel beside a vowel, else 1."""
    letter = lambda c: F.coalesce(F.substring(c, 1, 1).isin(list(VOWEL_LETTERS)), F.lit(False))
    beside = letter(phone) & (letter(before) | letter(after))
    notes = F.array_compact(F.array(F.when(~voiced, "voiced_edges_undetected"), F.when(beside, "vowel_vowel_neighbour")))
    return F.when(~voiced, 0.0).when(beside, 0.5).otherwise(1.0), notes


def parsed_label(label: Column) -> Column:
    """phone, status, notes, malformed of a manual label `phone|status|notes`; a blank label has the status empty."""
    raw = F.trim(label)
    parts = F.transform(F.split(raw, "\\|"), lambda p: F.trim(p))
    first, given = parts[0], F.lower(F.get(parts, F.lit(1)))
    alone = first.isin("reject", "uncertain", "accepted")
    named = F.when(alone, first).when(F.coalesce(given, F.lit("")) != "", given).otherwise("accepted")
    known = named.isin("accepted", "uncertain", "reject", "empty")
    notes = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "|")
    odd = F.when(notes == "", raw).otherwise(F.concat(notes, F.lit("|"), raw))
    blank = raw == ""
    malformed = (F.size(parts) > 1) & ~F.when(given == "", "accepted").otherwise(given).isin("accepted", "uncertain", "reject")
    return F.struct(
        F.when(blank | alone | (first == ""), None).otherwise(first).alias("phone"),
        F.when(blank, "empty").when(known, named).otherwise("uncertain").alias("status"),
        F.when(blank, "").when(known, notes).otherwise(odd).alias("notes"),
        F.coalesce(~blank & malformed, F.lit(False)).alias("malformed"),
    )


def quantity_note(phone: Column, after: Column, span: Column, own: Column, short: Column, tau: float = 2.0) -> tuple[Column, Column, Column]:
    """(z, note, score) of a phone's length. own, short: structs (median, scale) of the phone and of its short partner.

    short or long beyond tau scales; a long vowel is short as well when it is short for its own median (0.75 of it) and
    for the short vowel (its median less half a scale), whichever is less. Then the floors of the running check: a short
    vowel is long only from 320 ms (175 ms before a sonorant) and four scales on, a long one short only up to three
    scales above the short vowel's median.
    """
    usable = lambda s: s.isNotNull() & (s["scale"] > 0)
    z = F.when(usable(own), (span - own["median"]) / own["scale"])
    note = F.when(z < -tau, "short").when(z > tau, "long").when(z.isNotNull(), "expected")
    ratio = F.when(own["median"] > 0, own["median"] * 0.75)
    against = F.when(usable(short), short["median"] - 0.5 * short["scale"])
    clear = F.when(phone.isin(LONG), F.least(F.when(ratio > 0, ratio), F.when(against > 0, against)))
    note = F.when(z.isNotNull() & (span <= clear), "short").otherwise(note)
    floor = F.when(after.isin(SONORANTS), 175.0).otherwise(320.0)
    to_long = F.when(usable(own), F.greatest(floor, own["median"] + 4.0 * own["scale"])).otherwise(floor)
    to_short = F.when(usable(short), short["median"] + 3.0 * short["scale"]).otherwise(320.0)
    note = F.when((note == "long") & phone.isin(SHORT) & (span < to_long), "expected").when((note == "short") & phone.isin(LONG) & (span > to_short), "expected").otherwise(note)
    return z, note, F.exp(-0.5 * F.pow(z / tau, F.lit(2.0)))


# Surface variants and the phones that they are of, besides length and aspiration (fixed values).
VARIANTS = {"æ": "e", "c": "k", "ɟ": "ɡ", "ɲ": "n", "ŋ": "n", "ɫ": "l", "β": "v", "β̞": "v", "ɾ̞̊": "ɾ"}


def phonemic_base(phone: Column) -> Column:
    """The phone that a variant is of: short, without aspiration, and by the table."""
    plain = F.regexp_replace(phone, "[ːʰ]$", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VARIANTS.items() for x in kv]), plain), plain)


def allophonic(a: Column, b: Column) -> Column:
    """Whether two phones differ on the surface only; nothing is so to an absent one."""
    return F.coalesce((a != "") & (b != "") & (a != b) & (phonemic_base(a) == phonemic_base(b)), F.lit(False))


def bands(status: Column, expected: Column, observed: Column, score: Column, low: float = 0.30) -> dict[str, Column]:
    """Named policies of what is flagged: each keeps some incorrect rows, and the missing ones or not."""
    variant = allophonic(expected, observed)
    vowels = F.coalesce(expected.isin(VOWELS) & observed.isin(VOWELS), F.lit(False)) & ~variant
    far = ~variant & F.coalesce(score < low, F.lit(False))
    wrong, lost = status == "incorrect", status == "missing"
    keeps = {"baseline": (F.lit(True), True), "allophonic": (~variant, True), "vowel_trust": (vowels, True), "vowel_trust_miss": (vowels, False), "vowel_or_far_cons": (vowels | far, True), "vowel_or_far_cons_miss": (vowels | far, False)}
    return {name: F.coalesce((wrong & keep) | (lost & F.lit(miss)), F.lit(False)) for name, (keep, miss) in keeps.items()}
