"""Functions and operators on small rows whose results are known, and Spark against DuckDB on the given tables."""

import heapq
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from phonolake.functions import exprs, g2p, phonetics, sequences
from phonolake.operators import aggregates, joins, sampling, scoring, windows
from phonolake.plans import registry
from phonolake.sources import files
from phonolake.streaming import sessions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def value(v):
    if hasattr(v, "as_tuple"):
        return float(v)
    return tuple(map(value, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_spark_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(registry.ORACLE_SQL[name])
    at = [[x[0] for x in got.description].index(c) for c in cols]
    want = sorted((tuple(value(row[k]) for k in at) for row in got.fetchall()), key=repr)
    assert sorted((tuple(map(value, r)) for r in df.select(*cols).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


GOLDEN = {
    "ben": "/bæn/", "ders": "/dæɾ̞̊s/", "denk": "/dæŋk/", "ekmek": "/ek.ˈmec/", "çekti": "/t͡ʃek.ˈtʰi/", "dağ": "/daː/", "oğul": "/o.ˈuɫ/", "mağara": "/ma.a.ˈɾa/", "değil": "/de.ˈjil/",
    "değnek": "/dej.ˈnec/", "teğmen": "/tʰej.ˈmæn/", "para": "/pʰa.ˈɾa/", "kitap": "/cʰi.ˈtʰap/", "görmek": "/ɟœɾ.ˈmec/", "türk": "/tʰyɾ̞̊c/", "kendi": "/cʰen.ˈdi/", "genç": "/ɟeɲt͡ʃ/",
    "elektronik": "/e.lek.tʰɾo.ˈnic/", "slovenya": "/sɫo.β̞æn.ˈja/", "trafik": "/tʰɾa.ˈfic/",
}


def test_golden_words(spark):
    df = spark.createDataFrame(list(GOLDEN), "string").select(F.col("value").alias("word"))
    assert {r["word"]: r["ipa"] for r in g2p.pronounce(df, "word").collect()} == GOLDEN
    phones = df.select("word", g2p.phones(g2p.transcribe(F.col("word"))).alias("p")).where("word = 'türk'").first()["p"]
    assert phones == ["tʰ", "y", "ɾ̞̊", "c"]
    lexicon = spark.createDataFrame([("para", "p aː ɾ a")], "word string, phones string")
    assert g2p.pronounce(df.where("word = 'para'"), "word", lexicon).first()["ipa"].startswith("/pʰaː")


def fold_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_edits_agree(spark):
    rng = random.Random(2)
    rows = [([rng.choice(["a", "bé", "tʰ"]) for _ in range(rng.randint(0, 9))], [rng.choice(["a", "bé", "c"]) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    for r in df.select("r", "h", sequences.token_edits(F.col("r"), F.col("h")).alias("n"), sequences.align("r", "h").alias("e")).collect():
        assert r["n"] == fold_edits(r["r"], r["h"]) == sum(e["op"] != "match" for e in r["e"])
        assert [e["target"] for e in r["e"] if e["op"] != "insertion"] == r["r"]
        assert [e["predicted"] for e in r["e"] if e["op"] != "deletion"] == r["h"]


def test_whole_turns_are_aligned(spark, tmp_path):
    long = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(5, 0, "user", " ".join(long)), (5, 1, "assistant", " ".join(long[:60] + ["other"] + long[61:]))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    ops = {(r["op"], r["target"]): r["n"] for r in registry.QUERIES["confusion_pairs"](spark, str(tmp_path)).collect()}
    assert len(ops) == 90 and ops["substitution", long[60]] == 1
    assert {r["status"]: r["n"] for r in registry.QUERIES["assessment_statuses"](spark, str(tmp_path)).collect()} == {"correct": 89, "incorrect": 1}


def test_assessment_keeps_the_most_matches(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for _ in range(40)] + [(list("ab"), list("ba"))]
    df = spark.createDataFrame(rows, "t array<string>, o array<string>")
    for r in df.select("t", "o", sequences.assess("t", "o").alias("s")).collect():
        assert sum(x["status"] != "correct" for x in r["s"]) == fold_edits(r["t"], r["o"])
        assert [x["target"] for x in r["s"] if x["status"] != "extra"] == r["t"]
    assert sum(x["status"] == "correct" for x in df.where("t = array('a', 'b') AND o = array('b', 'a')").select(sequences.assess("t", "o").alias("s")).first()["s"]) == 1


def test_typicality_is_the_distance_from_the_robust_centre(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.diag([1, 2, 3])
    rows = spark.createDataFrame([("a", v.tolist()) for v in x] + [("few", [0.0, 0.0, 0.0])], "g string, v array<double>")
    models = scoring.robust_models(rows, "g", "v")
    m = {r["g"]: r for r in models.collect()}
    assert set(m) == {"a"}
    got = scoring.typicality(rows, models, "g", "v").collect()
    p = np.array(m["a"]["precision"]).reshape(3, 3)
    for r in got:
        d = np.array(r["v"]) - m["a"]["centre"]
        assert math.isclose(r["distance"], math.sqrt(d @ p @ d), rel_tol=1e-9) and 0 <= r["fit"] <= 1


def test_viterbi_stays_on_ties(spark):
    df = spark.createDataFrame([([[0.0, 0.0]] * 4, 2), ([[1.0, 0.0], [0.0, 5.0]], 2), ([[1.0, 0.0]], 2)], "x array<array<double>>, n int")
    assert [r[0] for r in df.select(sequences.viterbi("x", "n")).collect()] == [[0, 1, 1, 1], [0, 1], []]


def test_balanced_fill_is_the_plain_fold(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 4)}", f"{rng.random():.9f}", rng.randint(1, 30), i) for i in range(200)]
    got = {r["i"] for r in sampling.balanced_fill(spark.createDataFrame(rows, "g string, k string, c long, i long"), "g", "k", "c", 300, ["i"]).collect()}
    by = defaultdict(list)
    for r in sorted(rows):
        by[r[0]].append(r)
    heap, total, want = [(0, g) for g in sorted(by)], 0, set()
    heapq.heapify(heap)
    while heap and total < 300:
        own, g = heapq.heappop(heap)
        while by[g]:
            r = by[g].pop(0)
            if not want or total + r[2] <= 300:
                want.add(r[3])
                total += r[2]
                heapq.heappush(heap, (own + r[2], g))
                break
    assert got == want


@pytest.mark.parametrize(("block", "odd"), [(256, False), (1, True), (3, True)])
def test_balanced_fill_skips_rows_that_do_not_fit(spark, monkeypatch, block, odd):
    monkeypatch.setattr(sampling, "BLOCK", block, raising=False)
    rng = random.Random(6)
    rows = [(f"g{g}", f"{i:04d}", rng.choice([90, 400, 700]), i) for g in range(3) for i in range(4)]  # long rows come first
    rows += [(f"g{rng.randint(0, 2)}", f"{i:04d}", rng.randint(1, 60), i) for i in range(4, 60)]
    if odd:
        rows += [("g1", "0050", 7, 60)] * 4 + [("g2", "0002", None, 61), (None, "0001", 20, 62)]
    df = spark.createDataFrame(rows, "g string, k string, c long, i long")
    got = sampling.balanced_fill(df, "g", "k", "c", 300, ["i"]).collect()
    by = defaultdict(list)
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or "", *r[1:])):
        by[r[0]].append(r)
    heap, total, want = [(0, g or "", g) for g in by], 0, []
    heapq.heapify(heap)
    while heap:
        own, _, g = heapq.heappop(heap)
        while by[g]:
            r = by[g].pop(0)
            if total + r[2] <= 300:
                want.append((g, r[3]))
                total += r[2]
                heapq.heappush(heap, (own + r[2], g or "", g))
                break
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 5


def test_rates_and_reports_on_few_rows(spark):
    empty = spark.createDataFrame([], "phone string, ok boolean")
    assert [tuple(r) for r in aggregates.flagged_report(empty, "phone", F.col("ok")).collect()] == []
    one = spark.range(1)
    low, high = exprs.wilson(F.lit(0), F.lit(0))
    assert one.select(low.alias("l"), high.alias("h"), exprs.rate_or_zero(F.lit(1), F.lit(0)).alias("z"), exprs.rate_or_null(F.lit(1), F.lit(0)).alias("n")).first() == (None, None, 0.0, None)
    names = ["Iğdır", "İzmir", "ABC", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(exprs.turkish_lower(F.col("n"))).collect()]
    assert got == ["ığdır", "izmir", "abc", None]
    splits = spark.createDataFrame([("",), (None,)], "s string").select(exprs.split_of(F.col("s"), "90_10")).collect()
    assert [r[0] for r in splits] == ["train", "train"]


def test_joins_on_edges(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    patch = spark.createDataFrame([(2, "b"), (3, None)], "k int, v string")
    assert sorted(map(tuple, joins.overlay(base, patch, "k").collect())) == [(1, "a", "kept"), (2, "b", "replaced"), (3, None, "added")]
    left = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (2, 3, 0, 5)], "k int, id int, s long, e long")
    right = spark.createDataFrame([(1, 8, 12, 7), (1, 0, 10, 9), (1, 20, 30, 8)], "k int, s long, e long, v int")
    got = {r["id"]: (r["overlap"], r["v"]) for r in joins.overlap_best(left, right, "k", ("s", "e"), ("s", "e"), "id", "v", 4).collect()}
    assert got == {1: (10, 9), 2: (2, 7), 3: (None, None)}


def test_windows_on_edges(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, True), (1, 4, False), (2, 1, False)], "k int, t int, f boolean")
    assert {r["k"]: r["longest"] for r in windows.longest_run(rows, "k", ["t"], F.col("f")).collect()} == {1: 2, 2: 0}
    flat = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0)], "k int, t int, x double")
    assert windows.peak(flat, "k", "t", ["x"]).first()["verdict"] == "low_confidence"


def test_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("prompt_id\ttext\nA\tx\n \ty\n")
    assert [r["prompt_id"] for r in files.read_prompts(spark, str(tmp_path / "p.tsv")).collect()] == ["A"]
    with pytest.raises(ValueError, match="missing"):
        files.read_table(spark, str(tmp_path / "p.tsv"), ["other"])
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    schema = spark.createDataFrame([], "a long").schema
    assert files.read_log(spark, str(tmp_path / "log.jsonl"), schema, strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_log(spark, str(tmp_path / "log.jsonl"), schema).collect()
    (tmp_path / "a.TextGrid").write_text('intervals [1]:\n xmin = 0 \n xmax = 0.25 \n text = "a" \n intervals [2]:\n xmin = 0.25 \n xmax = 0.5 \n text = "" \n')
    assert [(r["start_ms"], r["end_ms"], r["label"]) for r in files.read_intervals(spark, str(tmp_path / "a.TextGrid")).collect()] == [(0, 250, "a")]
    assert files.check_schema(spark.createDataFrame([], "a int"), schema) == ["a: int instead of bigint"]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = sessions.sessions(stream, "user_id", "ts", "4 hours", "3650 days").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    batch = sessions.sessions(events, "user_id", "ts", "4 hours", "0 seconds")
    assert sorted(spark.table("sessions").collect()) == sorted(batch.collect())


def test_likeness_of_phones(spark):
    d = {(r["target"], r["observed"]): r["likeness"] for r in phonetics.likeness_table(spark).collect()}
    n = len({a for a, _ in d})
    assert n == 49 and len(d) == n * n and all(d[x, x] == 1 for x, _ in d)
    want = {("i", "u"): 0.64, ("a", "aː"): 0.76, ("i", "aː"): 0.32, ("p", "b"): 0.83, ("t", "tʰ"): 0.9, ("l", "ɫ"): 0.93, ("s", "ʃ"): 0.86, ("t", "t͡ʃ"): 0.66, ("a", "t"): 0.05, ("h", "m"): 0.12, ("ɾ", "ɾ̞̊"): 0.88, ("n", "ŋ"): 0.64}
    assert all(math.isclose(d[k], v, abs_tol=1e-9) for k, v in want.items()), {k: d[k] for k in want}
    assert all(math.isclose(x, d[b, a]) for (a, b), x in d.items())
    rows = spark.createDataFrame([("aː", "a", "long", True), ("aː", "a", "short", True), ("a", "aː", "long", None), ("a", "e", "long", True)], "t string, o string, note string, ok boolean")
    assert [r[0] for r in rows.select(phonetics.with_duration(F.lit(0.7), F.col("t"), F.col("o"), F.col("note"), F.col("ok"))).collect()] == [0.9, 0.58, 0.7, 0.7]
