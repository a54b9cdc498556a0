"""Shard specs, notes, bands, five columns, empty references, audits, samples, diagnostics."""

import pytest
from phonolake.functions import exprs, g2p, names
from phonolake.functions import phones as P
from phonolake.operators import aggregates, reports
from phonolake.sources import files
from pyspark.sql import functions as F


def test_shards():
    assert names.shard_of("6/10") == ([5], 10) and names.shard_of(" 7,6,6/10 ") == ([5, 6], 10)
    for bad in ("", "1", "0/3", "4/3", "1/0", "a/2", "1,/2", "1-2/3"):
        with pytest.raises(ValueError):
            names.shard_of(bad)


def test_ids_in_notes(spark):
    notes = ["ref_feature_id=12", "x ref_feature_id=003;", "ref_feature_id=", "feature_id=1", "ref_feature_id=99999999999999999999", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in notes], "n string").select(names.noted_id(F.col("n"))).collect()]
    assert got == [12, 3, None, None, None, None]


def test_bands(spark):
    rows = [("incorrect", "e", "æ", 0.9), ("incorrect", "e", "a", 0.9), ("incorrect", "k", "c", 0.1), ("incorrect", "k", "s", 0.1), ("incorrect", "k", "s", 0.9), ("incorrect", "a", "aː", None), ("missing", "a", None, None), ("correct", "a", "a", 0.1), ("incorrect", "pʰ", "p", 0.2)]
    df = spark.createDataFrame(rows, "s string, e string, o string, c double")
    bands = P.bands(F.col("s"), F.col("e"), F.col("o"), F.col("c"))
    got = df.select(*[F.sum(c.cast("int")).alias(n) for n, c in bands.items()]).first().asDict()
    assert got == {"baseline": 8, "allophonic": 4, "vowel_trust": 2, "vowel_trust_miss": 1, "vowel_or_far_cons": 3, "vowel_or_far_cons_miss": 2}


def test_five_columns(spark):
    rows = [("a b", None, None, None, None, "ab"), (" ", "/a.ˈb/", None, None, None, "aˈb"), (None, "", "a1", "k", None, "aɯ"), (None, None, " ", "g tS zzz", None, "ɡt͡ʃ"), ("", None, None, None, "[a]", "a"), (None, None, None, None, None, "")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, want string").select("want", F.array_join(g2p.target_phones(*[F.col(c) for c in "abcde"]), "").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_rates_of_an_empty_reference(spark):
    got = spark.createDataFrame([(0, 0), (2, 0), (1, 4)], "e int, n int").select(exprs.error_rate(F.col("e"), F.col("n"))).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 0.25]


def test_audits_say_what_to_do(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/good")
    spark.range(0).write.parquet(f"{tmp_path}/empty")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "part-0.parquet").write_text("not parquet")
    paths = {n: f"{tmp_path}/{n}" for n in ("good", "empty", "odd", "absent")} | {"lacking": f"{tmp_path}/good"}
    got = {r["table"]: (r["reasons"], r["decision"]) for r in files.catalogue_audit(spark, paths, {"good": ["id"], "lacking": ["id", "x"]}).collect()}
    assert got == {"good": ([], "reuse"), "empty": (["empty_empty"], "rebuild"), "absent": (["absent_missing"], "rebuild"), "odd": (["odd_malformed"], "rebuild"), "lacking": (["lacking_missing_columns"], "rebuild")}


def test_first_values_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 2 == 1, F.col("id")).alias("x"), F.lit(None).cast("double").alias("y"))
    got = {r["feature"]: r for r in aggregates.sample_percentiles(df, "k", ["x", "y"], "id", 5, [0.0, 0.5, 1.0]).collect()}
    assert (got["x"]["n"], got["x"]["null_rate"], got["x"]["n_sample"], got["x"]["q"]) == (5000, 0.5, 5, [1.0, 5.0, 9.0]) and (got["y"]["null_rate"], got["y"]["n_sample"], got["y"]["q"]) == (1.0, 0, None)
    plan = aggregates.sample_percentiles(df.repartition(3), "k", ["x"], "id", 5, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan is not None


def test_diagnostics_count_insertions(spark):
    ops = [("match", "aː", "aː"), ("substitution", "aː", "a"), ("substitution", "aː", "e"), ("deletion", "aː", None), ("insertion", None, "ˈ"), ("match", "ˈ", "ˈ"), ("match", "b", "b")]
    df = spark.createDataFrame([(o,) for o in ops], "e struct<op: string, target: string, predicted: string>")
    got = {r["token"]: tuple(r)[1:] for r in reports.token_diagnostics(df, {"aː": "a", "ˈ": ""}).collect()}
    assert got == {"aː": (4, 1, 2, 1, 0, 1, 0.75, 0.25), "ˈ": (1, 1, 0, 0, 1, 0, 0.0, 0.0)}
