"""Rules that look back over any number of consonants, against the same rules with variable look-behinds; words in all scripts; fixed calibration."""

import random
import re
import unicodedata

import regex
from phonolake.functions import g2p, names
from phonolake.operators import aggregates, joins
from pyspark.sql import functions as F

V, C, FRONT = g2p._V, g2p._C, g2p._FRONT


def coded(n=600, seed=4):
    rng = random.Random(seed)
    out = ["e" + "b" * 40 + "k", "e" + "b" * 40 + "ğ", "i" + "t" * 30 + "ɫ" + "t" * 30 + "ɫa", "eklkl", "ek.lek", "enk", "a" + "s" * 9 + "ğ", "ğğe", "eğe", ""]
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice("aeiɯoœuyAE"), rng.choice("kɡlɫɾnbtğğ"), "b" * rng.randint(1, 12), "."]) for _ in range(rng.randint(0, 12))))
    return list(dict.fromkeys(out))


def soften(x):
    x = regex.sub(f"^([{C}]*)ğ+", r"\1", x)
    x = regex.sub(f"(?<=[{FRONT}][{C}]*)ğ(?=[{FRONT}])", "j", x)
    x = regex.sub(f"ğ(?=[{V}])", "", x)
    x = regex.sub(f"(?<=e[{C}]*)ğ", "j", x)
    for short, long in zip("aiɯoœuy", "AIƜOŒUY", strict=True):
        x = regex.sub(f"{short}([{C}]*)ğ", long + r"\1", x)
    return x.replace("ğ", "")


def palatal(x):
    for plain, by in (("k", "c"), ("ɡ", "ɟ")):
        x = regex.sub(f"{plain}(?=[{C}]*[{FRONT}])", by, x)
        x = regex.sub(rf"(?<=[{FRONT}][{C}]*)(?<!n){plain}(?=\.?[lɫɾ]|$)", by, x)
    return x


def liquid(x):
    x = regex.sub(f"ɫ(?=[{C}.]*[{FRONT}])", "l", x.replace("l", "ɫ"))
    return regex.sub(f"(?<=[{FRONT}][{C}.]*)ɫ", "l", x)


def test_rules_look_back_over_all_consonants(spark):
    df = spark.createDataFrame([(x,) for x in coded()], "x string")
    got = df.select("x", g2p._soften(F.col("x")).alias("s"), g2p._palatal(F.col("x")).alias("p"), g2p._liquid(F.col("x")).alias("l")).collect()
    for r in got:
        assert (r["s"], r["p"], r["l"]) == (soften(r["x"]), palatal(r["x"]), liquid(r["x"])), r["x"]


def test_one_stress_in_a_long_transcription(spark):
    lexicon = spark.createDataFrame([("uzun", "ˈ " + "a b " * 200 + "ˈ a b a ˈ b")], "word string, phones string")
    df = spark.createDataFrame([("uzun",)], "w string")
    assert g2p.pronounce(df, "w", lexicon).first()["ipa"].count("ˈ") == 1


def test_words_of_all_letters(spark):
    words = ["Über-maß", "çay's", "NAÏVE!", "…Öğle’den", "Привет,", "日本語。", "x_1", "--", "É", "İIı"]
    got = {r["w"]: (r["p"], r["e"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", names.plain_word(F.col("w")).alias("p"), names.edged_word(F.col("w")).alias("e")).collect()}
    lower = lambda s: s.replace("I", "ı").replace("İ", "i").lower()
    for w in words:
        assert all(unicodedata.is_normalized("NFC", x) for x in got[w])
        assert got[w] == (lower(re.sub(r"[^\w\s'’]", "", w)), lower(re.sub(r"^\W+|\W+$", "", w)).replace("'", "")), w


def test_inserts_twice(spark):
    there = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    more = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    once = joins.insert_or_ignore(there, more, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "c")] == sorted(map(tuple, joins.insert_or_ignore(once, more, ["k"]).collect()))


def test_fixed_contrasts_are_all_there(spark):
    rows = [("a", "b", 0.5, "a")] * 25 + [("a", "c", -0.5, "c")] * 25 + [("x", "y", 1.0, None)] * 3 + [("not", "fixed", 1.0, None)] * 30
    df = spark.createDataFrame(rows, "t string, o string, m double, seen string")
    fixed = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y"), ("no", "row")], "t string, o string")
    got = {(r["t"], r["o"]): (r["n"], r["fp_rate"], r["cross_confusion"], r["override"], r["separable"], r["reliable"]) for r in aggregates.calibrate_fixed(df, fixed, "t", "o", "m", "seen", 20, 0.0, 0.1).collect()}
    assert got == {("a", "b"): (25, 0.0, 0.0, True, True, True), ("a", "c"): (25, 1.0, 1.0, False, False, True), ("x", "y"): (3, 0.0, None, False, False, True), ("no", "row"): (0, 0.0, None, False, False, True)}
