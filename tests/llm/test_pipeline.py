"""The pipeline, stage by stage: what each stage decides takes effect on all that the one before kept."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from phonolake.llm.common import documents, materialize

    out, docs = {"documents": documents(spark, SF)}, documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), name)
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "source_mixing", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_filters_only_take_rows_away(stages):
    ids = lambda n: [r[0] for r in stages[n].select("doc_id").collect()]
    assert set(ids("toxicity")) <= set(ids("documents")) and len(ids("toxicity")) > 0.8 * len(ids("documents"))
    assert set(ids("minhash_near_dedup")) <= set(ids("toxicity"))
    assert sorted(ids("suffix_array_dedup")) == sorted(ids("minhash_near_dedup"))
    assert set(ids("source_mixing")) <= set(ids("suffix_array_dedup"))


def without_passages(before, length, over_words):
    """Brute force: the longest runs of bytes covered by a string that occurs twice, cut if they have enough words."""
    from collections import Counter

    seen = Counter(t[p : p + length] for t in before.values() for p in range(len(t) - length + 1))
    out = {}
    for d, t in before.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end] == gone[at]:
                end += 1
            if not gone[at] or len(t[at:end].split()) <= over_words:
                kept.append(t[at:end])
            at = end
        out[d] = b"".join(kept).decode(errors="ignore")
    return out


def test_repeated_passages_go(stages):
    before = {r["doc_id"]: r["text"].encode() for r in stages["minhash_near_dedup"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["suffix_array_dedup"].collect()}
    assert after == without_passages(before, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    assert any(after[d].encode() != t for d, t in before.items())


def test_passages_of_short_and_of_long_words(spark):
    short = " ".join(f"w{k}x" for k in range(51))
    few = " ".join(f"longerword{k}" for k in range(40))
    rows = [(i, f"own text {i} " * 5 + p + f" end {i}") for i, p in enumerate([short, short, few, few])]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all("w25x" not in got[i] and got[i].startswith("own text") for i in (0, 1))
    assert all(got[i] == rows[i][1] for i in (2, 3))


def test_toxicity_keeps_what_scores_low(spark, stages):
    """The rows kept are those whose whole texts score under a half by a plain reading of the model."""
    import numpy as np
    from phonolake.llm import toxicity

    docs = stages["documents"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    a, b = (toxicity._compressor(x) for x in (model.ordinary, model.toxic + model.ordinary))
    lead = model.ordinary[-400:-300]
    length = lambda c, w: len(c.compress(lead + w.encode("utf-16-le", "surrogatepass")))
    want = set()
    for r in rows:
        ws = toxicity.windows(r["text"] or "")
        x = [length(a, w) - length(b, w) - length(a, "") + length(b, "") for w in ws]
        top = sorted([*x, 0, 0, 0], reverse=True)[:3]
        over = sum(v >= model.limit for v in x)
        f = (np.array([*top, np.log1p(over), np.log1p(over) - np.log1p(len(x))]) - model.mean) / model.scale
        if 1 / (1 + np.exp(-(model.weights[0] + f @ model.weights[1:]))) < 0.5:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == want


def test_near_dedup_keeps_one_of_each(stages):
    """Brute force over all pairs of what toxicity kept."""
    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := r["text"].encode().lower().split()) else frozenset() for r in stages["toxicity"].select("doc_id", "text").na.fill("").collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in stages["minhash_near_dedup"].collect()} == {d for d in ids if find(d) == d}


def test_mixing_draws_by_the_sources_rates(stages):
    """Plain inversion of the distribution, a document at a time."""
    import hashlib
    import math
    from collections import Counter

    before = stages["suffix_array_dedup"].select("doc_id", "source").collect()
    n = Counter(r["source"] for r in before)
    whole = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for r in before:
        rate = len(before) * math.sqrt(n[r["source"]]) / whole / n[r["source"]]
        u, k, p = int(hashlib.md5(f"17:0:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[r["doc_id"]] = k
    got = Counter(r["doc_id"] for r in stages["source_mixing"].collect())
    assert got == Counter({d: k for d, k in want.items() if k})


def test_packing_holds_all_tokens(stages):
    """Every document's ids lie in its pieces, whose places in a window have no gap."""
    import struct

    from phonolake.llm.tokens import default_path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    mixed = sorted((r["doc_id"], r["text"] or "") for r in stages["source_mixing"].select("doc_id", "text").collect())
    pieces = stages["packing"].toPandas()
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids + [1]
    assert int(pieces["length"].sum()) == sum(len(ids(t)) for _, t in mixed)
    texts = dict(mixed)
    for d, own in pieces.groupby("doc_id"):
        want = ids(texts[d])
        for r in own.itertuples():
            assert list(struct.unpack(f"<{r.length}I", r.token_ids)) == want[r.start : r.start + r.length]
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 2048
