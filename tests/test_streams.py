"""Streams against tables and plain folds: out of order, restarted, replayed; a cache whose writer was killed."""

import random
from datetime import datetime, timedelta

import pytest
from phonolake.sources import published as P
from phonolake.streaming import voice
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
LIMITS = voice.Limits(most_ms=6000, threshold=0.5)


def levels(n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], {"a": 0, "b": 0, None: 0}
    for _ in range(n):
        k = rng.choice(list(t))
        t[k] += rng.choice([20, 40, 60, 100, 500, 3000])
        rows.append((k, t[k], rng.choice([0.1, 0.9, 0.9, None])))
    return rows


def plain(rows):
    """Ticks of one ms: each looks at the row of its time, if there is one."""
    out = []
    for k in {r[0] for r in rows}:
        own = {}
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            own.setdefault(t, []).append(v)
        started = None
        for t in range(min(own), max(own) + 20_000):
            if started is not None:
                over = t - started >= LIMITS.most_ms
                quiet = heard is not None and t - heard >= LIMITS.least_speech_ms and t - last >= LIMITS.silence_ms  # noqa: F821
                if over or quiet:
                    out.append((k, started, heard, t, "limit" if over else "silence"))  # noqa: F821
                    started = None
            for v in own.get(t, []):
                if started is None:
                    started, above, heard, last = t, None, None, None
                voiced = v is not None and v > LIMITS.threshold
                if heard is None:
                    above = (t if above is None else above) if voiced else None
                    if voiced and t - above >= LIMITS.debounce_ms:
                        heard = last = t
                elif voiced:
                    last = t
    return sorted(out, key=repr)


def test_recordings_of_a_table(spark):
    rows = levels()
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = voice.recordings(df, "k", "t", "v", LIMITS).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows) and {r["reason"] for r in got} == {"limit", "silence"}
    assert voice.recordings(df.where("t < 0"), "k", "t", "v", LIMITS).count() == 0
    assert voice.threshold_over(0.001) == 0.018 and voice.threshold_over(0.01) == pytest.approx(0.024)


def test_recordings_of_a_stream(spark, tmp_path):
    """Rows in several files, out of order by up to two seconds, and one at the end that lets the watermark pass all others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in levels(120, 7) if r[0]]
    rng = random.Random(2)
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(-2000, 2000))
    parts = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)] + [[("end", 10_000_000, 0.1)]]
    for i, part in enumerate(parts):
        out = [(k, START + timedelta(milliseconds=t), v) for k, t, v in part]
        spark.createDataFrame(out, "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = voice.stream_recordings(stream, "k", "ts", "v", LIMITS, "20 seconds").writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    epoch = int(START.timestamp() * 1000)
    got = spark.read.parquet(f"{tmp_path}/out").where("k <> 'end'").select("k", *[(F.col(c) - epoch).alias(c) for c in ("started_ms", "heard_ms", "ended_ms")], "reason").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows) and len(got) > 5


def test_a_killed_writer_leaves_nothing(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    rows = spark.range(20).select(F.col("id").alias("k"))
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.select("k", (F.col("k") * 2).alias("v"))

    def broken(df):
        return compute(df).withColumn("v", F.raise_error(F.lit("killed")).cast("long"))

    schema = "k long, v long"
    assert P.manifest(spark, cache) == {}
    with pytest.raises(Exception, match="killed"):
        P.compute_missing(rows, ["k"], cache, broken, schema)
    assert P.published(spark, cache, schema).count() == 0
    assert sorted(map(tuple, P.compute_missing(rows.where("k < 5"), ["k"], cache, compute, schema).collect())) == [(k, 2 * k) for k in range(5)]
    assert sorted(map(tuple, P.compute_missing(rows, ["k"], cache, compute, schema).collect())) == [(k, 2 * k) for k in range(20)]
    assert P.compute_missing(rows, ["k"], cache, compute, schema).count() == 20 and calls == [20, 5, 15, 0]
    P.publish(spark.createDataFrame([(3, 999)], schema), cache, "zzz")  # another run's rows of a key that is there
    assert P.compute_missing(rows, ["k"], cache, compute, schema).where("k = 3").collect() in ([(3, 6)], [(3, 999)]) and P.compute_missing(rows, ["k"], cache, compute, schema).count() == 20
    (tmp_path / "cache" / "manifest" / "half").write_text("half-0123")  # not whole: it doesn't count
    assert "half" not in P.manifest(spark, cache)
    (tmp_path / "cache" / "parts" / P.manifest(spark, cache)["zzz"]).rename(tmp_path / "gone")
    with pytest.raises(Exception, match="zzz|PATH_NOT_FOUND"):  # a part that can't be read isn't an empty cache
        P.compute_missing(rows, ["k"], cache, compute, schema)


def test_names_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    P.publish(spark.range(3), path, "a")
    P.publish(spark.range(5), path, "a")
    P.publish(spark.range(1), path, "b")
    got = P.published(spark, path, "id long")
    assert sorted((r["_part"], r["id"]) for r in got.collect()) == [("a", i) for i in range(5)] + [("b", 0)]
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 2
    with pytest.raises(ValueError):
        P.publish(spark.range(1), path, "../x")


def test_a_stream_that_is_stopped_and_replayed(spark, tmp_path):
    out, seen = f"{tmp_path}/out", []
    schema = "k long, v string"

    def add(i, ks):
        spark.createDataFrame([(k, f"v{k}") for k in ks], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def start(checkpoint, fail_at=None, run="r1"):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

        def compute(df):
            rows = df.select("k", F.upper("v").alias("v"))
            seen.append(rows.count())
            if fail_at is not None and len(seen) == fail_at:
                raise RuntimeError("stopped")
            return rows

        q = P.append_stream(stream, out, f"{tmp_path}/{checkpoint}", ["k"], run, compute)
        try:
            q.awaitTermination()
        except Exception:
            assert fail_at is not None

    def rows():
        return sorted((r["k"], r["v"]) for r in P.published(spark, out, schema, lambda n: n.startswith("r1-")).collect())

    for i, ks in enumerate([[1, 2, 2, 3], [3, 4], [5]]):
        add(i, ks)
    start("c", fail_at=2)  # in the second batch
    assert len(rows()) < 5 and len({k for k, _ in rows()}) == len(rows())
    start("c")
    assert rows() == [(k, f"V{k}") for k in range(1, 6)]
    start("c")  # nothing new
    start("lost-checkpoint")  # all sources once more: their keys are known
    assert rows() == [(k, f"V{k}") for k in range(1, 6)]
    add(3, [5, 6])
    start("c")
    assert rows() == [(k, f"V{k}") for k in range(1, 7)]
    start("other", run="r2")
    assert P.published(spark, out, schema, lambda n: n.startswith("r2-")).count() == 6


def test_recordings_are_listed_and_opened(spark, tmp_path):
    path, schema = f"{tmp_path}/rec", "id string, created_at timestamp, word string, day string"
    rows = [(f"r{i}", START + timedelta(hours=7 * i), f"w{i % 3}", f"payload {i}") for i in range(30)]
    columns = "id string, created_at timestamp, word string, payload string"
    P.add_recordings(spark.createDataFrame(rows[:20], columns), path, "one")
    P.add_recordings(spark.createDataFrame(rows[20:], columns), path, "two")
    assert [r["id"] for r in P.list_recordings(spark, path, schema, 3).collect()] == ["r29", "r28", "r27"]
    assert [r["id"] for r in P.list_recordings(spark, path, schema, 2, "word = 'w1'").collect()] == ["r28", "r25"]
    assert P.open_recording(spark, path, schema, "r21") == "payload 21"
    with pytest.raises(FileNotFoundError):
        P.open_recording(spark, path, schema, "r99")
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            P.open_recording(spark, path, schema, bad)
    with pytest.raises(ValueError):
        P.add_recordings(spark.createDataFrame([("a/b", START, "w", "p")], columns), path, "three")
