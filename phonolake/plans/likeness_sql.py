"""The likeness of phones said in SQL."""

from __future__ import annotations

from ..functions import phonetics
from .adapters import sql_list


def likeness_sql(a: str, b: str) -> str:
    """The likeness of two rows of the inventory, in SQL."""
    near = " ".join(f"WHEN ({a}.place, {b}.place) IN (('{p}', '{q}'), ('{q}', '{p}')) THEN {x}" for (p, q), x in phonetics.NEAR_PLACES.items())
    both = lambda f, values: f"{a}.{f} IN {sql_list(values)} AND {b}.{f} IN {sql_list(values)}"
    vowel = f"least(0.12 * abs({a}.height - {b}.height), 0.24) + CASE WHEN {a}.back <> {b}.back THEN 0.20 ELSE 0 END + CASE WHEN {a}.rounded <> {b}.rounded THEN 0.16 ELSE 0 END + CASE WHEN {a}.long <> {b}.long THEN 0.24 ELSE 0 END"
    manner = f"CASE WHEN {a}.manner = {b}.manner THEN 0 WHEN {both('manner', ['stop', 'affricate'])} THEN 0.20 WHEN {both('manner', ['fricative', 'affricate'])} THEN 0.22 WHEN {both('manner', phonetics.OBSTRUENT)} THEN 0.38 WHEN {both('manner', phonetics.SONORANT)} THEN 0.28 ELSE 0.46 END"
    place = f"CASE WHEN {a}.place = {b}.place THEN 0 {near} WHEN {both('place', ['alveolar', 'postalveolar', 'palatal'])} OR {both('place', ['palatal', 'velar'])} THEN 0.28 WHEN {a}.place = 'glottal' OR {b}.place = 'glottal' THEN 0.42 ELSE 0.36 END"
    voice = f"CASE WHEN {a}.voiced = {b}.voiced THEN 0 WHEN {both('manner', phonetics.SONORANT)} THEN 0.12 ELSE 0.17 END + CASE WHEN {a}.aspirated <> {b}.aspirated THEN 0.10 ELSE 0 END + CASE WHEN {a}.velarized <> {b}.velarized THEN 0.07 ELSE 0 END"
    return f"CASE WHEN {a}.phone = {b}.phone THEN 1.0 WHEN {a}.class <> {b}.class THEN 0.05 WHEN {a}.class = 'vowel' THEN greatest(1 - ({vowel}), 0.30) ELSE greatest(1 - ({manner} + {place} + {voice}), 0.12) END"


def inventory_sql() -> str:
    n = "NULL"
    vowels = [f"('{v}{m}', 'vowel', {n}, {n}, {n}, {n}, {n}, {f[0]}, {f[1]}, {f[2]}, {int(bool(m))})" for v, f in phonetics.VOWELS.items() for m in ("", "ː") if not (v == "æ" and m)]
    consonants = [f"('{p}', 'consonant', '{m}', '{place}', {voiced}, {p.endswith('ʰ')}, {p == 'ɫ'}, {n}, {n}, {n}, {n})" for p, m, place, voiced in phonetics.CONSONANTS]
    return f"(VALUES {', '.join(vowels + consonants)}) v(phone, class, manner, place, voiced, aspirated, velarized, height, back, rounded, long)"
