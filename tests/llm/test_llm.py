"""Each operator against a brute-force version, an exact round trip or a held-out score, and on awkward rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from phonolake.llm import fingerprints, forest, gif, langid, mixing, packing, queries, records, sharding, suffixes, toxicity
from phonolake.llm.common import join_on_key
from phonolake.llm.tokens import SPACED_WORDS, WORDS, default_path, encoder
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, bucket string, key string, spans string, mix_n string"
AWKWARD = ["", None, "x", " ", "\n\t", "tie", "tie", "é" * 900, "ab " * 3000, "word " * 5000, "İ ẞ ß ́ 😀", "<|endoftext|> it's", "a  b\n c \x1c d"]


def table(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], None if i % 3 == 0 else f"s{i % 2}", len(t or ""), "", "", "", "", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice("the of and alpha beta gamma delta stone river".split()) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    return table(spark, AWKWARD + prose + prose[:3]).unionByName(table(spark, ["tie", None], ids=[None, None]))


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ["x"]).where("doc_id < 0")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_units_give_the_ids_of_whole_texts():
    texts = [t or "" for t in AWKWARD] + ["Wort, Wort. Wört!? naïve ΑΣ ΑΣ Β  tail ", "　a b", "x y z", "\0abc \0d e", "a\nb\n\nc \n d"]
    for name, pattern in (("word_bpe_49k.json", WORDS), ("byte_bpe_50k.json", SPACED_WORDS)):
        e = encoder(default_path(name), pattern)
        whole = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == whole


@pytest.mark.parametrize("window", [64, 2048])
def test_best_fit_places_every_piece_once(window):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, window + 1, 500)
    which, offset, n = packing.best_fit_decreasing(sizes, window)
    for w in range(n):
        at = sorted((offset[i], sizes[i]) for i in np.flatnonzero(which == w))
        assert at[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= window
    open_ = []  # the same by a plain search for the tightest window
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [c for c in open_ if c >= s]
        if fit:
            open_.remove(min(fit))
            open_.append(min(fit) - s)
        else:
            open_.append(window - s)
    assert n == len(open_)


def test_pack(spark, awkward, none):
    got = packing.pack(awkward, window=128, block_tokens=5_000).toPandas()
    e = encoder(default_path("word_bpe_49k.json"), WORDS)
    want = Counter((d, e.encode([t])[0] + struct.pack("<I", 1)) for d, t in texts_of(awkward))
    whole = [(k, x) for (k, x), n in want.items() for _ in range(n)]
    assert int(got["length"].sum()) == sum(len(x) // 4 for _, x in whole)
    one = got[got["doc_id"] == 8].sort_values("start")
    assert b"".join(one["token_ids"]) == next(x for k, x in whole if k == 8)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 128
    assert packing.pack(none).count() == 0


def test_packing_workers_hold_few_words_and_rows(spark):
    """The words that a worker remembers are bounded by the caller, to the same pieces; ids leave it a few rows at once."""
    rows = [(i, " ".join(f"{chr(97 + (i * k) % 26)}{i * k}" for k in range(1, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few, many = packing.pack(df, window=128, max_units=100), packing.pack(df, window=128)
    order = ["sequence_id", "offset"]
    assert few.count() >= 700 and few.sort(order).collect() == many.sort(order).collect()
    assert "MapInArrow" in few._jdf.queryExecution().executedPlan().toString()
    e = encoder(default_path("word_bpe_49k.json"), WORDS, 100)
    e.encode([t for _, t in rows])
    assert e.max_units == 100 and len(e.older) < 20_000 > len(e.known)
    assert encoder(default_path("word_bpe_49k.json"), WORDS) is not e


def test_records_round_trip(spark, awkward, none, tmp_path):
    folder, index = records.encode_to_folder(awkward)
    placed = records.with_starts(index)
    got = records.read_shuffled(spark, folder, placed, handles=1).orderBy("start").toPandas()
    e = encoder(default_path("byte_bpe_50k.json"), SPACED_WORDS)
    docs = sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [e.encode([t])[0] + struct.pack("<I", 2) for _, t in docs]
    assert [bytes(x) for x in got["token_ids"]] == want
    assert got["start"].tolist() == [0, *np.cumsum([len(x) // 4 for x in want])[:-1]]
    in_order = records.read_records(spark, folder).orderBy("file", "record").toPandas()
    assert [bytes(x) for x in in_order["token_ids"]] == want
    orders = [[r["record"] for r in records.read_shuffled(spark, folder, placed, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    few = records.read_shuffled(spark, folder, placed.where("n_tokens > 1000")).collect()  # records opened by themselves
    assert few and all(bytes(r["token_ids"]) in want and len(r["token_ids"]) == 4 * r["n_tokens"] for r in few)
    folder, index = records.encode_to_folder(none)
    assert records.read_shuffled(spark, folder, records.with_starts(index)).count() == 0


def test_damaged_records_are_told():
    data = records.frame(records.serialize(None, np.array([1, 70_000]), 4))
    doc_id, ids = records.deserialize(records.unframe(data, 0)[0])
    assert doc_id is None and ids.tolist() == [1, 70_000]
    for k in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def brute_repeats(docs, length):
    seen = Counter()
    for _, t in docs:
        b = t.encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((d, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_together", [512, 1])
def test_repeats_against_brute_force(spark, none, monkeypatch, most_together):
    monkeypatch.setattr(suffixes, "MOST_TOGETHER", most_together)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(40):
        own = " ".join(word() for _ in range(rng.randint(5, 90)))
        a, b = sorted(rng.randint(0, len(passage)) for _ in range(2))
        texts.append(own[: len(own) // 2] + passage[a:b] + own[len(own) // 2 :])
    texts += texts[:3] + [passage, passage[3:-2], "z" * 500, "z" * 350, "yx" * 300, None, "", "short"]
    df = table(spark, texts)
    got = [(r["doc_id"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["spans"]), bytes(r["kept"])) for r in suffixes.remove_repeats(df, 100).collect()]
    assert sorted(got, key=repr) == brute_repeats(texts_of(df), 100)
    assert suffixes.remove_repeats(none).count() == 0
    cut = suffixes.without_repeats(df, 100)
    assert cut.columns == df.columns and cut.count() == df.count()


def test_mixing_is_poisson_and_repeatable(spark, awkward, none):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    got = mixing.mix(df, weights={"s0": 2.0, "s1": 1.0, None: 1.0}, total=40_000).groupBy("source").agg(F.count("*").alias("n")).toPandas().set_index("source")["n"].to_dict()
    assert None not in [k for k in got if k == "s2"] and abs(got["s0"] - 20_000) < 600 and abs(got["s1"] - 10_000) < 500
    a = sorted(mixing.mix(df).select("doc_id", "mix_copy").collect())
    assert a == sorted(mixing.mix(df.repartition(3)).select("doc_id", "mix_copy").collect())
    n = Counter(r["doc_id"] for r in mixing.mix(df.where("source = 's1'"), total=12_000).collect())
    rate = 12_000 / df.where("source = 's1'").count()
    share = Counter(n.values())[2] / df.where("source = 's1'").count()
    assert abs(share - np.exp(-rate) * rate**2 / 2) < 0.02
    assert set(mixing.mix(awkward).columns) >= set(awkward.columns) and mixing.mix(none).count() == 0
    big = mixing.mix(df.where("doc_id < 20"), total=30_000.0).count()
    assert abs(big - 30_000) < 1_500  # means over what one table of probabilities can hold


def test_join_on_key_beyond_the_broadcast_bound(spark):
    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = (sorted(map(tuple, join_on_key(left, right, "k", broadcast_bytes=n).select("k", "id", "v").collect()), key=repr) for n in (10_000, 2))
    assert a == b and len(a) == 1000


def test_fingerprints(spark, awkward, none):
    docs = sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = defaultdict(list)
    for r in fingerprints.compare_with_next(awkward).collect():
        got[r["doc_id"]].append(r)
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        own, e = fingerprints.fingerprint(t.encode()), fingerprints.edited(t, nxt)
        row = next(r for r in got[d] if r["fingerprint"] == own.hex() and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest())
        assert row["n_chars"] == len(t) and row["near_next"] == fingerprints.likeness(own, fingerprints.fingerprint(nxt.encode()))
    assert fingerprints.edited("abcdefgh", "xyz") == "abcdefxy" and fingerprints.edited("abcdefgh", "x") == "abcdefx"
    assert fingerprints.likeness(b"\0" * 65, b"\0" * 65) == 1.0 and 0 <= fingerprints.likeness(b"\xff" * 65, b"\0" * 65) < 0.1
    assert fingerprints.compare_with_next(none).count() == 0
    alone = fingerprints.compare_with_next(awkward.where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_shards(spark, awkward, none):
    got = sharding.shuffle_to_shards(awkward, 8, least_buckets=5).toPandas()
    assert len(got) == awkward.count()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    again = sharding.shuffle_to_shards(awkward.repartition(3), 8, least_buckets=5).toPandas()
    key = lambda d: sorted(zip(d["shard"], d["slot"], d["text"].fillna("~"), strict=True))
    assert key(got) == key(again)
    assert sharding.shuffle_to_shards(none).count() == 0


def test_gif_round_trip(spark, awkward, none):
    rng = np.random.default_rng(2)
    for payload in (b" " * 192, bytes(rng.integers(0, 256, 192 * 700, dtype=np.uint8)), b"a" * 192 * 1500, b"abc" * 64 * 900):
        frames = list(gif.decode(gif.encode(payload)))
        assert b"".join(f.samples.tobytes() for f in frames) == payload and len(frames) == -(-len(payload) // (192 * gif.FRAME_ROWS))
    got = gif.store_frames(gif.store_texts(awkward)).toPandas()
    want = Counter(hashlib.sha256(gif.payload_of(t)[1]).hexdigest() for _, t in texts_of(awkward))
    assert Counter(got["payload_sha256"]) == want
    rows = gif.frames(gif.store_texts(awkward)).collect()
    assert all(sum(r["histogram"]) == r["width"] * r["height"] == len(r["samples"]) for r in rows if r["frame"] == 0)
    stored = gif.store_frames(gif.store_texts(awkward)).collect()
    assert all(sum(f["width"] * f["height"] for f in r["frames"]) == r["payload_bytes"] == sum(sum(f["histogram"]) for f in r["frames"]) and {f["delay_ms"] for f in r["frames"]} == {40} for r in stored)
    assert gif.store_frames(gif.store_texts(none)).count() == 0
    broken = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"no")], "doc_id long, media binary")
    assert gif.frames(broken).count() == 0


def hand_made_gif(frames, palette, width, height):
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 1, 0, 0), palette]
    for (left, top, w, h, flags, local, samples, delay, disposal, transparent) in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + local + bytes([2]))
        codes = [4]
        for s in samples:
            codes += [s, 4]  # a clear code after each: all codes have three bits
        codes.append(5)
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        body = bits.to_bytes((3 * len(codes) + 7) // 8, "little")
        out.append(bytes([len(body)]) + body + b"\0")
    return b"".join([*out, b";"])


def test_gif_palettes_disposal_transparency_interlace():
    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    shared = bytes(sum((red, green, blue, white), ()))
    local = bytes(sum((white, blue, green, red), ()))
    data = hand_made_gif(
        [
            (0, 0, 2, 2, 0, b"", [0, 0, 0, 0], 7, 1, None),
            (0, 0, 2, 1, 0, b"", [1, 3], 5, 3, 3),  # 3 is transparent; then what was before comes back
            (1, 1, 1, 1, 0x81, local, [1], 5, 2, None),  # a palette of its own; then the place is cleared
            (0, 0, 1, 2, 0x40, b"", [2, 1], 5, 0, None),  # interlaced
        ],
        shared, 2, 2,
    )
    shown = [[[(int(c) & 255, int(c) >> 8 & 255, int(c) >> 16 & 255) if c else None for c in row] for row in f.canvas] for f in gif.decode(data)]
    assert shown[0] == [[red, red], [red, red]]
    assert shown[1] == [[green, red], [red, red]]
    assert shown[2] == [[red, red], [red, blue]]
    assert shown[3] == [[blue, red], [green, None]]
    assert [f.delay_cs for f in gif.decode(data)] == [7, 5, 5, 5]


def brute_forward(word, pieces, p):
    ways = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            k = pieces.get(word[i:j], -1 if i == j - 1 else None)
            if k is not None:
                ways[j] += ways[i] * p[k]
    return np.log(ways[-1])


def brute_expected(word, pieces, p):
    """Uses of each piece over all segmentations, each weighted by its share of the probability."""
    ways = [[(1.0, ())]]
    for j in range(1, len(word) + 1):
        ends = []
        for i in range(j):
            k = pieces.get(word[i:j], -1 if i == j - 1 else None)
            if k is not None:
                ends += [(q * p[k], (*path, k)) for q, path in ways[i]]
        ways.append(ends)
    whole, out = sum(q for q, _ in ways[-1]), np.zeros(len(p))
    for q, path in ways[-1]:
        for k in path:
            out[k] += q / whole
    return out


def sums(pairs, n):
    out = np.zeros(n)
    for k, x in pairs:
        out[k] += x
    return out


def test_forward_sums_all_segmentations():
    import sentencepiece

    path = default_path("piece_bpe_32k.model")
    v = langid.pieces(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})
    p = np.random.default_rng(1).random((v.n + 1, 2)) / v.n
    for w in ("▁the", "▁Straße", "▁qЖz", "▁"):
        got = langid.forward(v, [w, w], p)
        assert np.allclose(got[0], [brute_forward(w, {x: i for i, x in enumerate(names)}, p[:, k]) for k in range(2)])
        assert np.allclose(langid.forward_long(v, w * 9, p), [brute_forward(w * 9, {x: i for i, x in enumerate(names)}, p[:, k]) for k in range(2)])
        want = brute_expected(w, v.known, p[:, 0])
        for got in (langid.expected(v, [w], np.array([3.0]), p[:, 0]), sums(langid.expected_long(v, w, 3.0, p[:, 0]), v.n + 1)):
            assert np.allclose(got, 3 * want)
    assert np.isfinite(langid.forward_long(v, "▁" + "qЖz" * 3000, p)).all()


def test_languages_are_told(spark, awkward, none):
    rng = random.Random(4)
    vocabulary = {"en": "the of and stone river where thing".split(), "de": "der und nicht Straße Schlüssel wegen".split()}
    langs = [rng.choice(["en", "de"]) for _ in range(300)]
    df = table(spark, [" ".join(rng.choice(vocabulary[x]) for _ in range(20)) for x in langs], langs)
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.98
    odd = langid.identify(awkward, model).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 3, 4)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.train(none)).collect()} == {"und"}


def test_toxic_texts_are_told(spark, awkward, none):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = "idiot worthless pathetic moron".split()
    texts, marks = [], []
    for i in range(900):
        ws = [rng.choice(plain) for _ in range(40)]
        marks.append(int(i % 6 == 0))
        if marks[-1]:
            for _ in range(4):
                ws[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(ws))
    df = table(spark, texts)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == marks[i] for i in held]) > 0.95
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.drop_toxic(none, model).count() == 0
    assert 0 <= toxicity.Scorer(toxicity.train(none, labels)).score("word") <= 1


def brute_components(docs, size, percent):
    sets = {d: frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if (w := t.encode().lower().split()) else frozenset() for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, none, size, percent):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for n in (1, 3, 12, 90):  # groups, one of them larger than a leaf
        base = [word() for _ in range(rng.randint(60, 120))]
        for k in range(n):
            ws = list(base)
            for _ in range(k % 5):
                ws[rng.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["A b C d E f", "a  B\nc d e F", "a", "A", "", None, " \t"]
    df = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df, size, percent).collect()}
    assert got == brute_components(texts_of(df), size, percent)
    one = forest.one_of_each(df, size, percent)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, x in got.items() if x[2]) and one.columns == df.columns
    assert forest.near_duplicates(none).count() == 0


def template_family(seed, n=500, slots=14, choices=4, twins=25):
    """Texts on one template, their slots filled from few choices, and for some of them a twin with a few words more changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, fill = [word() for _ in range(slots * 12)], [[word() for _ in range(choices)] for _ in range(slots)]
    texts = []
    for _ in range(n):
        ws = list(base)
        for k, f in enumerate(fill):
            ws[12 * k + 5] = rng.choice(f)
        texts.append(ws)
    for ws in texts[:twins]:
        texts.append(list(ws))
        for k in rng.sample(range(slots), 2):
            texts[-1][12 * k + 5] = word()
    return [" ".join(ws) for ws in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_isolated_pairs_in_a_template_family(spark, monkeypatch, seed):
    """Hardly any group of the family is small: what meets in large ones only is linked all the same."""
    monkeypatch.setattr(forest, "LEAF", 2)
    df = table(spark, template_family(seed))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df, 5, 80).collect()}
    want = brute_components(texts_of(df), 5, 80)
    assert 10 < sum(not x[2] for x in want.values()) < 300
    assert got == want


def test_near_duplicates_on_awkward_rows(spark, awkward):
    rows = forest.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    ties = {r["component_id"] for r in rows if r["doc_id"] in (5, 6)}
    assert ties == {5}


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
