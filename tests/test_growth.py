"""What must not grow with the tables: what is broadcast, how often a word is transcribed, what a worker holds."""

from pyspark.sql import functions as F

from phonolake.functions import g2p


def plan(df, kind: str) -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_no_words_of_texts_are_broadcast(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "elma armut"), (2, " "), (3, None), (4, "?!"), (5, "elma")], "k int, text string").write.parquet(path)
    out = g2p.transcribe_texts(spark.read.parquet(path), "k", "text")
    assert "Broadcast" not in plan(out, "executedPlan")
    got = {r["k"]: r for r in out.collect()}
    assert [got[k]["drop_reason"] for k in range(1, 6)] == [None, "empty_text", "empty_text", "no_word_tokens", None]
    assert [got[k]["normalized"] for k in range(1, 6)] == ["elma armut", "", None, "", "elma"]
    assert got[5]["tokens"] == got[1]["tokens"][: got[5]["token_count"]] and got[2]["tokens"] == [] and got[4]["ipa"] is None


def test_phone_likeness_transcribes_distinct_words_only(spark, tmp_path):
    from phonolake.plans import registry

    spark.createDataFrame([(1, "araba a araba"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["phone_likeness"](spark, str(tmp_path))
    below = plan(out, "optimizedPlan").split("Aggregate [word")[-1].split("\n", 1)[1]
    assert "regexp_replace" not in below  # under the count of words only what finds them
    assert sum(r["n"] for r in out.collect()) == 2 * 4


def test_alignments_keep_no_rows_of_a_batch_as_objects(spark):
    """A batch of pairs of turns stays in Arrow: what Python holds besides is a few rows of it."""
    import tracemalloc

    import pyarrow as pa

    from phonolake.functions import sequences

    r = [[f"w{(i * k) % 97}" for i in range(60)] for k in range(1, 4)] * 200
    h = [x[5:] + x[:3] for x in r]
    a, b = pa.array(r), pa.array(h)
    for f in (sequences.align, sequences.assess):
        tracemalloc.start()
        out = f.func(a, b)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [len(x) for x in out] and held < 4e6


def test_empty_reference_rates_reads_the_pairs_once(spark, tmp_path):
    from phonolake.plans import registry

    turns = [(c, t, ("user", "assistant")[t % 2], "a b c" if t % 2 == 0 else "a b") for c in range(1, 9) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = registry.QUERIES["empty_reference_rates"](spark, str(tmp_path))
    assert plan(out, "optimizedPlan").count("Relation [") == 1
    got = {r["grp"]: r for r in out.collect()}
    ids = [c * 1000 for c in range(1, 9)]
    assert sum(r["n"] for r in got.values()) == 8 + sum(i % 3 == 0 for i in ids) + sum(i % 7 == 0 for i in ids)
    assert got[3]["n_empty"] == 1 and abs(got[3]["mean_rate"] - (1 / 3 + 1 + 1 / 3) / 3) < 1e-6


def test_robust_models_write_no_matrix_with_a_vector(spark, monkeypatch):
    import numpy as np

    from phonolake.operators import scoring

    x = np.random.default_rng(8).normal(size=(300, 3)).round(1)
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    written, cut = [], scoring.cut
    monkeypatch.setattr(scoring, "cut", lambda df, name: written.append(set(df.columns)) or cut(df, name))
    sent = sorted(scoring.robust_models(rows, "g", "v").collect())
    assert written and not any("precision" in c for c in written)
    monkeypatch.setattr(scoring, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(scoring, "BOUNDS", -1)  # bounds that hold no median: all values are ranked
    ranked = sorted(scoring.robust_models(rows, "g", "v").collect())
    monkeypatch.setattr(scoring, "SENT_BYTES", 0)
    joined = sorted(scoring.robust_models(rows, "g", "v").collect())
    for other in (ranked, joined):
        for a, b in zip(sent, other, strict=True):
            assert a["g"] == b["g"] and a["n"] == b["n"] and all(np.allclose(a[c], b[c]) for c in ("centre", "precision", "threshold"))


def test_mixtures_of_all_sizes_share_their_passes(spark, monkeypatch):
    import numpy as np

    from phonolake.operators import mixtures

    x = np.random.default_rng(9).normal(size=(240, 2))
    passes, sums = [], mixtures._sums
    monkeypatch.setattr(mixtures, "_sums", lambda *a: passes.append(1) or sums(*a))
    monkeypatch.setattr(mixtures, "ROUNDS", 3)
    assert set(mixtures.fit_mixtures(spark.createDataFrame([("a", v.tolist()) for v in x], "g string, v array<double>"), "g", "v")) == {"a"}
    assert len(passes) <= 3


def test_triggers_are_shuffled_without_digests(spark, monkeypatch):
    """Classes of triggers name their first row by a number: 16 bytes of digest and the id would be most of what is shuffled."""
    from phonolake.llm import suffixes

    seen, classes = [], suffixes._classes
    monkeypatch.setattr(suffixes, "_classes", lambda rows, *a: seen.append(rows.columns) or classes(rows, *a))
    passage = " ".join(f"w{i * 37 % 101}" for i in range(60))
    texts = [(1, f"one {passage} two"), (2, f"three {passage} four"), (None, "short"), (4, "x" * 150), (4, "x" * 150)]
    out = suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), 100).collect()
    assert "key" not in seen[0] and "doc_id" not in seen[0]
    assert sorted(bytes(r["kept"]) for r in out) == sorted([b"ontwo", b"threfour", b"short", b"", b""])
