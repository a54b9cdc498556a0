"""Operators and functions against plain versions, and on rows that go wrong."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from phonolake.functions import g2p, sequences, signals
from phonolake.functions import phones as P
from phonolake.operators import aggregates, mixtures, records, reports, sampling, scoring
from phonolake.plans import registry, text_queries
from phonolake.sources import files, published
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def test_edits_of_more_tokens_than_a_byte_can_tell(spark):
    rng = random.Random(1)
    a = [f"t{i}" for i in range(1500)]
    b = [x if rng.random() < 0.6 else f"u{i}" for i, x in enumerate(a)]
    df = spark.createDataFrame([(a, b), (a[:400], a[200:600]), ([], ["x"]), ([], [])], "r array<string>, h array<string>")
    got = [r[0] for r in df.select(sequences.token_edits(F.col("r"), F.col("h"))).collect()]
    assert got == [plain_edits(a, b), plain_edits(a[:400], a[200:600]), 1, 0]


def test_viterbi_against_all_paths(spark):
    rng = random.Random(3)
    rows = [([[rng.choice([-1.0, -2.0, -3.0]) for _ in range(n)] for _ in range(t)], n) for t in range(1, 7) for n in range(1, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<array<double>>, n int").select(sequences.viterbi("x", "n")).collect()]
    for (x, n), path in zip(rows, got, strict=True):
        if len(x) < n:
            assert path == []
            continue
        ways = [[0]]
        for _ in x[1:]:
            ways = [[*w, k] for w in ways for k in (w[-1], w[-1] + 1) if k < n]
        best = max(sum(f[k] for f, k in zip(x, w, strict=True)) for w in ways if w[-1] == n - 1)
        assert path[0] == 0 and path[-1] == n - 1 and math.isclose(sum(f[k] for f, k in zip(x, path, strict=True)), best)


def test_quantiles_and_prefix_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=3000).round(2)] + [("b", 1.0), ("b", 2.0), (None, 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    at = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in aggregates.exact_quantiles(df, ["k"], "v", at).collect()}
    assert set(got) == {"a", "b", None}
    for k in got:
        own = [v for g, v in rows if g == k and v is not None]
        assert got[k][0] == len(own) and np.allclose(got[k][1], np.quantile(own, at))
    grid = {r["j"]: r["q"] for r in mixtures.quantile_grid(df.where("k = 'a'"), "k", "v", 100).collect()}
    assert np.allclose([grid[j] for j in range(100)], np.quantile([v for g, v in rows if g == "a"], np.linspace(0, 1, 100)))
    few = {(r["k"], r["j"]): r["q"] for r in mixtures.quantile_grid(df, "k", "v", 100).where("k = 'b' OR k IS NULL").collect()}
    assert few == {("b", 0): 1.0, ("b", 1): 2.0, (None, 0): 7.0}


def plain_robust(x, ridge=1e-3, q=0.95):
    d = x.shape[1]
    limit = d * (1 - 2 / (9 * d) + 3.0902323061678132 * (2 / (9 * d)) ** 0.5) ** 3

    def fit(y):
        c = np.median(y, axis=0)
        s = (y - c).T @ (y - c) / max(1, len(y) - 1)
        return c, np.linalg.pinv(s + ridge * np.trace(s) / d * np.eye(d))

    far = lambda y, c, p: np.einsum("ij,jk,ik->i", y - c, p, y - c)
    c, p = fit(x)
    keep = far(x, c, p) <= limit
    c, p = fit(x[keep] if keep.sum() >= d + 1 else x)
    return c, p, math.sqrt(np.quantile(far(x, c, p), q))


def test_robust_models_are_those_of_plain_numpy(spark):
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=(200, 3)) @ np.diag([1, 2, 3]), "b": rng.normal(size=(40, 3)) + 5}
    x["a"][:3] += 100  # to be trimmed
    rows = [(g, v.tolist()) for g in x for v in x[g]] + [("few", [0.0, 0.0, 0.0]), ("a", None)]
    got = {r["g"]: r for r in scoring.robust_models(spark.createDataFrame(rows, "g string, v array<double>").repartition(5), "g", "v").collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        c, p, t = plain_robust(x[g])
        assert np.allclose(r["centre"], c) and np.allclose(np.reshape(r["precision"], (3, 3)), p) and math.isclose(r["threshold"], t, rel_tol=1e-9) and r["n"] == len(x[g])


def test_mixtures_are_those_of_plain_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 2)) - 4, rng.normal(size=(150, 2)) * 0.5 + 4])
    one = rng.normal(size=(100, 2))
    rows = [("two", v.tolist()) for v in x] + [("one", v.tolist()) for v in one]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(4)
    models = mixtures.fit_mixtures(df, "g", "v")
    assert {g: len(m) for g, m in models.items()} == {"two": 2, "one": 1}
    c, p, _ = plain_robust(x)
    model, last = mixtures.start_apart(mixtures._component(1.0, c, np.linalg.pinv(p)), 2), None
    for _ in range(mixtures.ROUNDS):  # plain expectation maximisation over all rows at once
        parts = np.stack([m.log_density(x) for m in model])
        like = np.logaddexp.reduce(parts, 0)
        if last is not None and abs(like.sum() - last) <= 1e-6 * abs(last):
            break
        last, share = like.sum(), np.exp(parts - like)
        model = []
        for w in share:
            mean = w @ x / w.sum()
            model.append(mixtures._component(w.sum() / len(x), mean, (x - mean).T @ ((x - mean) * w[:, None]) / w.sum() + mixtures.REGULAR * np.eye(2)))
    for a, b in zip(models["two"], model, strict=True):
        assert np.allclose(a.mean, b.mean, atol=1e-6) and np.allclose(a.precision, b.precision, rtol=1e-4) and math.isclose(a.weight, b.weight, rel_tol=1e-6)
    got = mixtures.assess(mixtures.score(df, models, "g", "v", {"two": 2.0, "one": 2.0})).collect()
    for r in got[:20]:
        v = np.array([r["v"]])
        assert math.isclose(r["log_density"], float(mixtures.log_density(models[r["g"]], v)[0]))
        near = min(float(c.squared_distance(v)[0]) for c in models[r["g"]])
        assert math.isclose(r["typicality"], math.exp(-0.5 * near / 4)) and r["best_match"] == ("one" if r["g"] == "two" else "two")
        assert r["verdict"] == ("fit_ok" if r["typicality"] >= math.exp(-0.5) else "likely_substitution" if r["margin"] <= -0.15 else "atypical")
    unknown = mixtures.assess(mixtures.score(spark.createDataFrame([("other", [1.0, 2.0]), ("one", None)], "g string, v array<double>"), models, "g", "v", {"two": 2.0, "one": 2.0})).collect()
    assert {r["verdict"] for r in unknown} == {"low_confidence"}
    assert mixtures.signature(models) == mixtures.signature(dict(reversed(models.items()))) and len(mixtures.signature(models)) == 40
    assert mixtures.fit_mixtures(df.where("false"), "g", "v") == {}


def test_projections_are_those_of_plain_numpy(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(80, 3)), rng.normal(size=(60, 3)) + [1, 0, 2]
    rows = [("p", 0, v.tolist()) for v in a] + [("p", 1, v.tolist()) for v in b] + [("lone", 0, [1.0, 2.0, 3.0])]
    got = {r["pair"]: r for r in mixtures.projections(spark.createDataFrame(rows, "pair string, side int, v array<double>").repartition(3), "pair", F.col("side"), "v").collect()}
    both = np.concatenate([a, b])
    centre, scale = np.median(both, axis=0), np.subtract(*np.percentile(both, [75, 25], axis=0))
    za, zb = (a - centre) / scale, (b - centre) / scale
    cov = np.cov(np.concatenate([za - za.mean(0), zb - zb.mean(0)]), rowvar=False) + 1e-2 * np.eye(3)
    w = np.linalg.solve(cov, zb.mean(0) - za.mean(0))
    assert set(got) == {"p"} and np.allclose(got["p"]["weights"], w / np.linalg.norm(w)) and np.allclose(got["p"]["centre"], centre) and np.allclose(got["p"]["scale"], scale)


def test_budgets_stream_through_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), f"{i:05d}", rng.choice([1, 5, 50, 400, None]), i) for i in range(3000)] + [("big", "0", 900, -1), ("big", "1", 1, -2)]
    df = spark.createDataFrame(rows, "g string, k string, c long, i long").repartition(6)
    got = {r["i"] for r in sampling.budget_fill(df, "g", "k", "c", 300, ["i"]).collect()}
    want, total = set(), {}
    for g, _, c, i in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or "", r[1])):
        if g not in total or (total[g] < 300 and total[g] + c <= 300):
            want.add(i)
            total[g] = total.get(g, 0) + c
    assert got == want


def test_confusions_are_plain_counts(spark):
    ops = text_queries._pairs(spark, SF).select("grp", F.explode(sequences.align("r", "h")).alias("e"))
    rows = [(r["grp"], r["e"]["op"], r["e"]["target"], r["e"]["predicted"]) for r in ops.collect()]
    per = defaultdict(Counter)
    for _, op, target, _ in rows:
        if op != "insertion":
            per[target][op] += 1
    got = {r["token"]: r for r in reports.confusions(ops, 5).collect()}
    assert set(got) == set(per)
    for t, c in per.items():
        r = got[t]
        assert (r["ref_count"], r["correct"], r["substituted"], r["deleted"]) == (sum(c.values()), c["match"], c["substitution"], c["deletion"])
        top = Counter(p for _, op, x, p in rows if op == "substitution" and x == t)
        want = " ".join(f"{p}:{n}" for p, n in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5])
        assert (r["top_confusions"] or "") == want
    best = reports.top_substitutions(ops, "grp", 3).collect()
    for g in {r["grp"] for r in best}:
        n = Counter((t, p) for x, op, t, p in rows if x == g and op == "substitution")
        assert sorted(r["n"] for r in best if r["grp"] == g) == sorted(sorted(n.values())[-3:])


GOLDEN = """ben bæn|sen sæn|el æl|ders dæɾ̞̊s|denk dæŋk|gel ɟæl|ter tʰæɾ̞̊|her hæɾ̞̊|ekmek ek.ˈmec|tek tʰec|çekti t͡ʃek.ˈtʰi|sept sept|mehmet meh.ˈmet|dağ daː|bağ baː|sağ saː|ağ aː|çiğ t͡ʃiː|oğul o.ˈuɫ|boğaz bo.ˈaz|mağara ma.a.ˈɾa|doğa do.ˈa|soğan so.ˈan|değil de.ˈjil
eğitim e.ji.ˈtʰim|değnek dej.ˈnec|teğmen tʰej.ˈmæn|para pʰa.ˈɾa|tepe tʰe.ˈpʰe|kapı kʰa.ˈpʰɯ|kitap cʰi.ˈtʰap|görmek ɟœɾ.ˈmec|bir biɾ̞̊|kart kʰaɾ̞̊t|türk tʰyɾ̞̊c|belli bel.ˈli|elli el.ˈli|kendi cʰen.ˈdi|mühendis my.hen.ˈdis|genç ɟeɲt͡ʃ|elektronik e.lek.tʰɾo.ˈnic|slovenya sɫo.β̞æn.ˈja|demokrasi de.mo.kʰɾa.ˈsi|trafik tʰɾa.ˈfic"""
# Words of the lexicon: phones, type, a transcription with its stress, and what comes out.
LEXICON = """fare|f aː ɾ e|long_vowel||faː.ˈɾe
hafız|h aː f ɯ z|long_vowel|ˈhaːfɯz|ˈhaː.fɯz
zaten|z aː t e n|stress||ˈzaː.tʰæn
felaket|f e l aː k e t|long_vowel||fe.laː.ˈcʰet
gaziantep|ɡ aː z i a n t e p|place_name|ɡaː.zi.ˈan.tep|ɡaː.zi.ˈan.tʰep
salihli|s aː l i h l i|place_name|saː.ˈlih.li|saː.ˈlih.li
ankara|a n k a ɾ a|place_name|ˈan.ka.ɾa|ˈaŋ.kʰa.ɾa
adana|a d a n a|place_name|aˈdana|a.ˈda.na
akdeniz|a k d e n i z|stress||ˈak.de.niz
pencere|p e n d͡ʒ e ɾ e|no_e_open|pen.ˈd͡ʒe.ɾe|pʰeɲ.ˈd͡ʒe.ɾe
belki|b e l k i|no_e_open|ˈbelki|ˈbel.cʰi
cerrah|d͡ʒ e ɾ ɾ a h|no_e_open||d͡ʒeɾ.ˈɾah"""


def test_golden_words_with_and_without_a_lexicon(spark):
    golden = dict(x.split(" ") for line in GOLDEN.splitlines() for x in line.split("|"))
    entries = [line.split("|") for line in LEXICON.splitlines()]
    lexicon = spark.createDataFrame([tuple(e[:4]) for e in entries], "word string, phones string, type string, ipa_detail string")
    golden |= {e[0]: e[4] for e in entries}
    df = spark.createDataFrame([(w,) for w in [*golden, "Ankara", "TBMM", "WXY", "  ", None]], "word string")
    got = {r["word"]: r for r in g2p.pronounce(df, "word", lexicon).collect()}
    assert {w: got[w]["ipa"].strip("/") for w in golden} == golden
    assert (got["Ankara"]["source"], got["Ankara"]["type"], got["TBMM"]["source"], got["WXY"]["source"], got["  "]["source"], got["ben"]["source"]) == ("exception", "place_name", "reference", "acronym", "empty", "rules")
    said = df.where("word = 'TBMM'").select(g2p.phones(F.lit(got["TBMM"]["coded"])).alias("p")).first()["p"]
    assert " ".join(said) == "t e ˈ b e ˈ m e ˈ m e"
    plain = g2p.pronounce(df.where("word = 'para'"), "word", pedagogical=False).first()["ipa"]
    assert plain == "/pa.ˈɾa/"
    steps = df.where("word = 'ekmek'").select(g2p.trace(F.col("word")).alias("t")).first()["t"]
    assert steps[0]["name"] == "grapheme_map" and steps[-1]["output"] == got["ekmek"]["coded"] and all(a["output"] == b["input"] for a, b in zip(steps, steps[1:], strict=False))
    assert {s["name"] for s in steps if s["fired"]} == {"grapheme_map", "soft_g", "palatalization", "stress"}


def test_suffixes_move_the_stress(spark):
    rows = [("yapma", "yap", ["mA"], "VERB"), ("güzelim", "güzel", ["yHm"], "ADJ"), ("gelirim", "gel", ["Hr", "yHm"], "VERB"), ("dökmesi", "dök", ["mA", "sH"], "VERB"), ("yazılma", "yaz", ["Hl", "mA"], "VERB"), ("evde", "ev", [], "NOUN")]
    m = spark.createDataFrame([(*r, False) for r in rows], "word string, root string, suffixes array<string>, pos string, is_proper boolean")
    got = {r["word"]: r["ipa"] for r in g2p.pronounce(m, "word", None, m).collect()}
    at = {w: next(i for i, s in enumerate(x.strip("/").split(".")) if "ˈ" in s) for w, x in got.items()}
    assert at == {"yapma": 0, "güzelim": 2, "gelirim": 1, "dökmesi": 2, "yazılma": 2, "evde": 1}


def test_texts_policies_and_parsers(spark):
    texts = spark.createDataFrame([(1, "Ali gel, çabuk!"), (2, " "), (3, "123"), (4, None), (5, "ñ")], "k int, text string")
    got = {r["k"]: r for r in g2p.transcribe_texts(texts, "k", "text").collect()}
    assert " ".join(got[1]["tokens"]) == "a ˈ l i <spc> ɟ æ l <spc> t͡ʃ a ˈ b u k" and got[1]["drop_reason"] is None and got[1]["ipa"] == "/a.ˈli ɟæl t͡ʃa.ˈbuk/"
    assert [got[k]["drop_reason"] for k in (2, 3, 4)] == ["empty_text", "no_word_tokens", "empty_text"] and got[5]["tokens"] == []
    policy = spark.createDataFrame([(["a", "<spc>", "<spc>", "q", "<pad>", "<spc>"],), ([],)], "t array<string>").select(g2p.token_policy(F.col("t")).alias("p")).collect()
    assert policy[0]["p"]["drop_reason"] == "consecutive_space_tokens" and len(policy[0]["p"]["warnings"]) == 4 and policy[1]["p"]["drop_reason"] is None
    ipa = spark.createDataFrame([("/teˈbe/",), ("dZ a: ʧ5 % ø̞ kʰ t̪",), ("",), (None,)], "t string").select(g2p.parse_ipa(F.col("t")).alias("p")).collect()
    assert ipa[0]["p"]["phones"] == list("teˈbe") and ipa[1]["p"]["phones"] == ["d͡ʒ", "aː", "t͡ʃ", "ɫ", "œ", "kʰ", "t"] and ipa[1]["p"]["unknown"] == ["%"] and ipa[2]["p"]["phones"] == []
    rows = [("e m i ɾ ˈ i <spc> t ˈ a p", "e m i ˈ ɾ i <spc> ˈ t a p"), ("a", "a"), ("b ˈ a", "ˈ b a"), ("k a p ˈ ɯ", "k a ˈ p ɯ")]
    out = spark.createDataFrame(rows, "a string, b string").select(g2p.canonical_stress(F.split("a", " ")).alias("t"), "b").collect()
    assert all(" ".join(r["t"]) == r["b"] for r in out)
    assert spark.range(1).select(g2p.strip_meta(F.split(F.lit("a ˈ b <spc> a"), " "))).first()[0] == ["a", "b", "a"]


def test_rows_that_are_looked_up_and_replaced(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0)], "k int, x string, v double")
    with pytest.raises(ValueError, match="absent or not unique"):
        records.replace_rows(base, spark.createDataFrame([(9, 0.0)], "k int, v double"), ["k"], "v")
    with pytest.raises(ValueError, match="absent or not unique"):
        records.replace_rows(base, spark.createDataFrame([(2, 0.0)], "k int, v double"), ["k"], "v")
    want = spark.createDataFrame([(1, "z"), (2, "c"), (2, "z"), (3, "a"), (None, "a")], "k int, w string")
    got = {(r["k"], r["w"]): (r["outcome"], r["found"]) for r in records.lookup(want, base, ["k"], ("w", "x"), "v").collect()}
    assert got == {(1, "z"): ("one", 1.0), (2, "c"): ("exact", 3.0), (2, "z"): ("ambiguous", None), (3, "a"): ("none", None), (None, "a"): ("none", None)}
    assert records.bucket_set(" 0..3,95,2 ") == [0, 1, 2, 3, 95] and records.bucket_set("") == []
    for bad in ("5..2", "100", "0..100"):
        with pytest.raises(ValueError, match="range of buckets"):
            records.bucket_set(bad)


def test_signals_on_edges(spark):
    rng = np.random.default_rng(1)
    tone = np.sin(2 * np.pi * 100 * np.arange(640) / 1600)
    rows = [(0, []), (1, [0.0] * 640), (2, tone.tolist()), (3, rng.normal(size=20).tolist()), (4, np.concatenate([np.zeros(320), tone[:320]]).tolist())]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", signals.spectrum(F.col("x"), 1600).alias("s")).collect()}
    assert got[0]["centroid"] is None and got[1]["centroid"] is None and got[3]["centroid"] is None
    assert abs(got[2]["centroid"] - 100) < 3 and abs(got[2]["f0"] - 100) < 1e-6
    region = {r["i"]: tuple(r["r"]) for r in df.where("i > 0").select("i", signals.speech_region(F.col("x"), 1600).alias("r")).collect()}
    assert region[1] == (0, 400, "no_speech_fallback") and region[2] == (0, 400, "no_speech_fallback")[:2] + (region[2][2],) and region[4][0] in range(140, 200) and region[4][1] == 400
    burst = df.where("i = 4").select(signals.closure_burst(F.col("x"), 1600).alias("b")).first()["b"]
    assert burst["closure_ms"] == 0 and abs(burst["burst_ms"] - 200) < 4 and burst["confidence"] == 1.0
    assert df.where("i = 0").select(signals.closure_burst(F.col("x"), 1600).alias("b")).first()["b"] is None


def test_files_of_catalogues_recordings_and_reports(spark, tmp_path):
    schemas = {"segments": spark.createDataFrame([], "id long, path string").schema}
    files.init_tables(spark, str(tmp_path / "db"), schemas, "3.0")
    full = schemas | {"schema_meta": spark.createDataFrame([], "key string, value string").schema}
    assert files.open_tables(spark, str(tmp_path / "db"), full, "3.0")["segments"].count() == 0
    with pytest.raises(ValueError, match="instead of 4.0"):
        files.open_tables(spark, str(tmp_path / "db"), full, "4.0")
    with pytest.raises(ValueError, match="missing"):
        files.open_tables(spark, str(tmp_path / "db"), {"segments": spark.createDataFrame([], "id long, other int").schema})
    with pytest.raises(ValueError, match="nothing"):
        files.open_tables(spark, str(tmp_path / "db"), {"nothing": schemas["segments"]})
    with pytest.raises(Exception, match="(?i)exists"):
        files.init_tables(spark, str(tmp_path / "db"), schemas, "3.0")
    (tmp_path / "rec" / "s1").mkdir(parents=True)
    for name in ("P1-a01.wav", "P1-a02.WAV", "notes.txt", "odd.wav"):
        (tmp_path / "rec" / "s1" / name).write_bytes(b"x")
    got = {(r["session"], r["prompt_id"], r["attempt"]) for r in files.list_recordings(spark, str(tmp_path / "rec")).collect()}
    assert got == {("s1", "P1", 1), ("s1", "P1", 2)}
    (tmp_path / "lines.txt").write_text("kalem\n \n defter \n")
    assert sorted(r["line"] for r in files.read_lines(spark, str(tmp_path / "lines.txt")).collect()) == ["defter", "kalem"]
    rows = spark.range(25).select((F.col("id") * 2).alias("path"), "id", F.lit(1).alias("more"))
    assert files.write_instances(rows, str(tmp_path / "out"), schemas["segments"], 10) == 25 and len(list((tmp_path / "out").glob("*.parquet"))) >= 3
    report = spark.createDataFrame([("a|b", 0.5, None), ("c", 1.25, 3)], "phone string, rate double, n int")
    assert '"phone": "a|b"' in files.report_json(report) and "| a\\|b | 0.5 | — |" in files.report_markdown(report, "Rates")
    with pytest.raises(ValueError, match="no report"):
        files.report_json(spark.range(5), most=4)


def test_tiers_without_gaps_are_read_back(spark, tmp_path):
    rows = [(1, 100, 250, 'a"b|uncertain', 900), (1, 250, 400, "c", 900), (1, 350, 380, "inside", 900), (2, -5, 50, "d", 50)]
    tiers = files.filled_intervals(spark.createDataFrame(rows, "seg int, s long, e long, l string, d long"), "seg", "s", "e", "l", "d")
    got = [tuple(r) for r in tiers.orderBy("seg", "i").collect()]
    assert got == [(1, 1, 0, 100, ""), (1, 2, 100, 250, 'a"b|uncertain'), (1, 3, 250, 400, "c"), (1, 4, 350, 380, "inside"), (1, 5, 380, 900, ""), (2, 1, 0, 50, "d")]
    files.write_textgrids(tiers, "seg", str(tmp_path / "grids"))
    back = files.read_intervals(spark, str(tmp_path / "grids" / "seg=1")).orderBy("i").collect()
    assert [(r["start_ms"], r["end_ms"], r["label"]) for r in back] == [(100, 250, 'a"b|uncertain'), (250, 400, "c"), (350, 380, "inside")]


def test_a_cache_is_filled_once(spark, tmp_path):
    seen = []

    def compute(missing):
        seen.append(sorted(r["id"] for r in missing.collect()))
        return missing.select("id", (F.col("id") * 10).alias("v"))

    run = lambda n: sorted(tuple(r) for r in published.compute_missing(spark.range(n), ["id"], str(tmp_path / "cache"), compute, "id long, v long").collect())
    assert run(2) == [(0, 0), (1, 10)] and run(4) == [(k, 10 * k) for k in range(4)] and run(2) == [(0, 0), (1, 10)]
    assert seen == [[0, 1], [2, 3], []]


def test_labels_and_lengths_on_edges(spark):
    labels = {"a|reject|x|y": ("a", "reject", "x|y", False), "": (None, "empty", "", False), "uncertain": (None, "uncertain", "", False), "a|odd|n": ("a", "uncertain", "n|a|odd|n", True), "a|": ("a", "accepted", "", False), "|reject": (None, "reject", "", False), "a": ("a", "accepted", "", False)}
    got = {r["l"]: tuple(r["p"]) for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", P.parsed_label(F.col("l")).alias("p")).collect()}
    assert got == labels
    s = "struct<median: double, scale: double>"
    rows = [("aː", None, 55.0, (85.0, 25.0), (71.0, 22.0)), ("aː", None, 70.0, (85.0, 25.0), (71.0, 22.0)), ("a", None, 300.0, (71.0, 22.0), None), ("a", "n", 300.0, (71.0, 22.0), None), ("a", None, 50.0, (50.0, 0.0), None), ("a", None, 50.0, None, None)]
    df = spark.createDataFrame(rows, f"p string, a string, x double, o {s}, t {s}")
    z, note, score = P.quantity_note(*[F.col(c) for c in ("p", "a", "x", "o", "t")])
    assert [r["n"] for r in df.select(note.alias("n")).collect()] == ["short", "expected", "expected", "long", None, None]
    assert [r["s"] is None for r in df.select(score.alias("s")).collect()] == [False] * 4 + [True] * 2


def test_every_query_says_what_it_compares_with():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(q.__doc__ for n, q in registry.QUERIES.items() if n not in registry.ORACLE_SQL)
