"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with equal sets of shingles are one class from the start. A tree sorts the classes by a run of MinHash values
of its own; classes with a long common prefix there are candidates. Depth adapts to the region: a prefix group of
more than LEAF classes is cut by longer and longer prefixes until its parts are small. Within a part of at most LEAF
classes all pairs whose signatures agree enough are candidates. In a larger group every class is compared with the
group's leaders (the classes that lie in large groups in the most trees: the middle of a cloud of copies), and where
the prefixes end, with its neighbours in sorted order; so a group costs as many pairs as it has members. Candidates
are confirmed on full sets of shingles.

What leaders and neighbours leave open in large groups is settled exactly: the classes that lie in any are joined on
their rarest shingles (prefix and position filter), but for pairs that are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, hold, join_hot, materialize, scratch, text_key, text_rows

TREES = 28
#: A tree's depths, in MinHash values: the first is what candidates share at least.
DEPTHS = (4, 7, 11)
DEEPEST = DEPTHS[-1]
LEAF = 32
LEADERS = 2
#: The join on rare shingles is split so that this many classes of a shingle meet all its others in one part.
PART = 2000
#: A pair is confirmed on full sets if its signatures agree at least so much less than the threshold.
SLACK = 0.15
_rng = np.random.default_rng(1010)
_values = 112
_mul = _rng.integers(1, 1 << 63, _values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, _values, dtype=np.uint64)
#: Neighbours in sorted order, to either side, that are candidates beyond the deepest prefixes.
NEIGHBOURS = 4
#: Which values make up a tree's order: any two trees share few.
_order = np.stack([_rng.permutation(_values)[: DEEPEST + 8] for _ in range(TREES)])


class Words:
    """64-bit hashes of words, each distinct one hashed once; known ones are held up to max_known."""

    def __init__(self, max_known: int = 250_000):
        self.known: dict[bytes, int] = {}
        self.max_known = max_known

    def hashes(self, ws: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.max_known:
            self.known.clear()
        known, h64 = self.known, xxhash.xxh3_64_intdigest
        for w in set(ws).difference(known):
            known[w] = h64(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


_words = Words()


def hold_words() -> None:
    hold("forest", _words.known.clear)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words (all of them as one run, if there are fewer; none without words)."""
    h = _words.hashes(text.encode().lower().split())  # bytes: only A-Z change, only ASCII white space separates
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        x = h[k : k + n] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out = out * np.uint64(0x100000001B3) + x
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of each set (none may be empty): of each least value the low 16 bits, which are as good as random."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _values), np.uint16)
    for k in range(_values):
        x = ((flat * _mul[k] + _add[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = (np.minimum.reduceat(x, starts) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def _sign(df: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (digest of the set, null for an empty one), signature for every document."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hold_words()
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                sets = [shingles(t, size) for t in part["text"]]
                some = [k for k, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                if some:
                    for k, row in zip(some, signatures([sets[k] for k in some]), strict=True):
                        sig[k] = row.tobytes()
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text_key": part["text_key"], "n_shingles": [len(s) for s in sets], "set_key": keys, "signature": sig})

    return df.withColumn("text_key", text_key()).mapInPandas(task, "doc_id long, text_key binary, n_shingles long, set_key binary, signature binary")


def _keys(own: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """A hash of each row's first `depth` values in the tree's order."""
    import xxhash

    raw = np.ascontiguousarray(own[:, _order[tree][:depth]])
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), tree << 8 | depth) for r in raw], np.uint64).view(np.int64)


def _nodes(classes: DataFrame) -> DataFrame:
    """tree, id, node (the key of the shallowest prefix) of every class in every tree."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), _values)
            for t in range(TREES):
                yield pd.DataFrame({"tree": t, "id": pdf["id"], "node": _keys(sig, t, DEPTHS[0])})

    return classes.select("id", "signature").mapInPandas(task, "tree int, id binary, node long")


def _deeper(rows: DataFrame, sig: DataFrame, depth: int) -> DataFrame:
    """The rows with the key of a longer prefix."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, part in pdf.groupby("tree"):
                own = np.frombuffer(b"".join(part["signature"]), np.uint16).reshape(len(part), _values)
                yield pd.DataFrame({"tree": t, "id": part["id"], "node": _keys(own, t, depth)})

    return rows.select("tree", "id").join(sig, "id").select("tree", "id", "signature").mapInPandas(task, "tree int, id binary, node long")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _leaf_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs within leaves. members: leaf (key), id, signature, all rows of a leaf in one task, at most LEAF of them."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["id"].to_numpy()
            sig = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), _values)
            leaf, out = rows["leaf"].to_numpy(), [empty]
            for gap in range(1, LEAF):  # rows are sorted by leaf: all pairs of a leaf, gap by gap
                same = np.flatnonzero(leaf[gap:] == leaf[:-gap])
                if not len(same):
                    break
                good = same[_agreement(sig[same], sig[same + gap]) >= least]
                out.append(pd.DataFrame({"a": ids[good], "b": ids[good + gap]}))  # ids rise within a leaf
            return pd.concat(out)

        empty = pd.DataFrame({"a": [], "b": []}, dtype=object)
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= 20_000:
                rows = pd.concat(held, ignore_index=True)
                whole = rows["leaf"] != rows["leaf"].iloc[-1]
                if whole.any():
                    yield pairs(rows[whole])
                held, n = [rows[~whole]], int((~whole).sum())
        if n:
            yield pairs(pd.concat(held, ignore_index=True))

    return members.repartition("leaf").sortWithinPartitions("leaf", "id").mapInPandas(task, "a binary, b binary")


def _neighbour_pairs(deep: DataFrame, sig: DataFrame, least: float) -> DataFrame:
    """Pairs of neighbours in the sorted order of their tree, beyond the deepest prefix. deep: node, tree, id."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), _values)
            further = sig[np.arange(len(pdf))[:, None], _order[pdf["tree"].to_numpy()][:, DEEPEST:]]
            yield pdf.assign(further=[r.tobytes() for r in further.astype(">u2")])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame()
        for pdf in batches:
            rows = pd.concat([before, pdf], ignore_index=True)
            sig = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), _values)
            node, ids = rows["node"].to_numpy(), rows["id"].to_numpy()
            for gap in range(1, NEIGHBOURS + 1):
                near = np.flatnonzero(node[gap:] == node[:-gap])
                near = near[_agreement(sig[near], sig[near + gap]) >= least]
                a, b = ids[near], ids[near + gap]
                yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)})
            before = rows.iloc[-NEIGHBOURS:]

    rows = deep.join(sig, "id").select("node", "tree", "id", "signature").mapInPandas(keys, "node long, tree int, id binary, signature binary, further binary")
    return rows.repartitionByRange("node", "further").sortWithinPartitions("node", "further", "id").mapInPandas(task, "a binary, b binary")


def candidates(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of class ids; and the ids that lie in a large group, whose pairs may be incomplete. classes: id, signature."""
    level = materialize(_nodes(classes), "nodes")
    sig = classes.select("id", "signature")
    leaves, large = [], []
    for depth in (*DEPTHS[1:], None):
        size = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        here = level.join(size, "node")
        leaves.append(here.where(F.col("size") <= LEAF).select(F.col("node").alias("leaf"), "id"))
        large.append(materialize(here.where(F.col("size") > LEAF).select("node", "tree", "id"), "large"))
        level = materialize(_deeper(large[-1], sig, depth), "deeper") if depth else None
    small = leaves[0]
    for x in leaves[1:]:
        small = small.unionByName(x)
    pairs = _leaf_pairs(small.join(sig, "id"), least).unionByName(_neighbour_pairs(large[-1], sig, least))

    # Leaders of the large groups, at the first depth and at the last.
    members = materialize(large[0].unionByName(large[-1]).select("node", "id"), "members")
    central = members.groupBy("id").agg(F.count(F.lit(1)).alias("groups"))
    rest = members.join(central, "id").select("node", F.struct("groups", "id").alias("rank"))
    for _ in range(LEADERS):
        best = materialize(rest.groupBy("node").agg(F.max("rank").alias("best")), "leaders")
        rest = rest.join(best, "node").where("rank <> best").select("node", "rank")
        led = members.join(best.select("node", F.col("best.id").alias("leader")), "node").where("id <> leader")
        pairs = pairs.unionByName(led.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")))
    return pairs.distinct(), large[0].select("id").distinct()


def _crowd(crowded: DataFrame, linked: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, root (its component, or itself), s (array of the set's hashes) of the crowded classes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for i in range(0, len(pdf), 500):
                sets = [shingles(t, size) for t in pdf["text"].iloc[i : i + 500]]
                yield pd.DataFrame({"id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "s": [s.view(np.int64) for s in sets]})

    sets = _texts(crowded, classes, docs).mapInPandas(make, "id binary, s array<long>").dropDuplicates(["id"])
    return materialize(sets.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("root"), "s"), "crowd")


def crowd_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of classes of different components, all that link among them. crowd: id, root, s.

    All shingles are put in one order: first those that a single component holds (no pair sought here shares them), then
    from rare to frequent. Two sets that link share one of their first n - percent * n + 1 shingles, and what is left
    from the first one shared on suffices for the overlap.
    """
    rows = crowd.select(F.xxhash64("id").alias("k"), F.xxhash64("root").alias("root"), F.size("s").alias("n"), "s")
    each = rows.select("k", "root", F.explode("s").alias("x"))
    held = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("x", "df")
    held = materialize(held, "shared-shingles")
    total = held.agg(F.sum("df")).first()[0] or 0
    hot = F.col("df") > max(PART, total // 50_000)  # at most 50,000 shingles
    each = each.select("k", "x")
    shared = each.join(F.broadcast(held.where(hot)), "x").unionByName(each.join(held.where(~hot), "x"))
    shared = shared.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("at")).join(rows.drop("s"), "k")
    shared = shared.withColumn("before", F.col("n") - F.size("at"))
    reach = F.col("n") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1 - F.col("before")
    first = shared.where(reach > 0).select("k", "root", "n", "before", F.posexplode(F.slice("at", F.lit(1), reach)).alias("i", "at"))
    first = materialize(first.select("k", "root", "n", (F.col("n") - F.col("before") - F.col("i")).alias("left"), "at.df", "at.x"), "rare-shingles")
    # Within the component that holds most of a shingle's classes there is nothing to find: the others meet all, it meets them.
    main = first.groupBy("x", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("x").agg(F.max(F.struct("c", "root")).alias("m")).select("x", F.col("m.root").alias("main"))
    first = first.join(main, "x").withColumn("minor", F.col("root") != F.col("main")).drop("main")
    parts = F.ceil(F.col("df") / PART).cast("int")
    some = first.where("minor").select("x", F.pmod(F.xxhash64("k"), parts).cast("int").alias("part"), *[F.col(c).alias(f"{c}1") for c in ("k", "root", "n", "left")])
    others = first.select("x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}2") for c in ("k", "root", "n", "left", "minor")])
    enough = F.least("left1", "left2") * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    once = ~F.col("minor2") | (F.col("k1") < F.col("k2"))
    pairs = some.join(others, ["x", "part"]).where((F.col("root1") != F.col("root2")) & once & enough).select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    name = lambda k, c: crowd.select(F.xxhash64("id").alias(k), F.col("id").alias(c))
    pairs = pairs.join(name("k1", "i1"), "k1").join(name("k2", "i2"), "k2")
    return pairs.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"))


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """A document's text for each wanted class (and texts of other classes, where ids repeat or are absent). wanted: id."""
    ids = classes.join(wanted, "id").select("first.doc_id")
    return docs.alias("d").join(ids.select("doc_id").distinct().alias("i"), F.expr("d.doc_id <=> i.doc_id")).select("d.text")


def _representatives(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, s (the set's hashes) of the classes in pairs, each from the text of one document."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for i in range(0, len(pdf), 500):
                sets = [shingles(t, size).tobytes() for t in pdf["text"].iloc[i : i + 500]]
                yield pd.DataFrame({"id": [xxhash.xxh3_128_digest(s) for s in sets], "s": sets})

    return materialize(_texts(wanted, classes, docs).mapInPandas(make, "id binary, s binary").dropDuplicates(["id"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. sets: id, s."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["s1"], pdf["s2"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
    return both.select("a", "b", "s1", "s2").mapInPandas(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of an edge a - b.

    Large-star and small-star steps in turn until nothing changes; both only ever hold as many rows as there are edges.
    """
    step = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: from each u to its neighbours v below it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step = materialize(step, "stars")
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == last:
            break
        last = now
    return step.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def _found(df: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, first (of the row's component, the row with the smallest id: absent, doc_id, text_key)."""
    docs = text_rows(df, id_col, text_col)
    with scratch(df.sparkSession, "forest"):
        signed = materialize(_sign(docs, size), "signed")
        rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")  # rows without an id come last
        classes = signed.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("id")).agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
        classes = materialize(classes, "set-classes")
        pairs, crowded = candidates(classes, percent / 100 - SLACK)
        pairs = materialize(pairs, "pairs")
        links = confirm(pairs, _representatives(pairs, classes, docs, size), percent)
        linked = components(links)
        if not crowded.isEmpty():
            pairs = materialize(crowd_pairs(_crowd(crowded, linked, classes, docs, size), percent), "crowd-pairs")
            if not pairs.isEmpty():
                more = confirm(pairs, _representatives(pairs, classes, docs, size), percent)
                linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        rooted = materialize(classes.join(linked, "id", "left").select("id", "n", "first", F.coalesce("component", "id").alias("root")), "rooted")
        roots = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
        per_class = join_hot(rooted.select("id", "root"), roots.drop("n"), "root", roots.select("root", "n")).select(F.col("id").alias("set_key"), "first")
        rows = join_hot(signed.drop("signature"), per_class, "set_key", rooted.select(F.col("id").alias("set_key"), "n"))
        return materialize(rows.select("doc_id", "text_key", "n_shingles", "set_key", "first"), "near-duplicates", keep=True)


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept, for every document.

    Documents are linked if 100 * intersection >= percent * union holds for their sets of `size`-word shingles
    (words in lower case A-Z, separated by ASCII white space; a text of fewer words is one shingle; null, empty and
    blank texts have no shingle and no link). Equal sets are linked without comparing. Repeated rows get equal
    results; rows with a null id link like others, but only an id can name a component (null if no row has one;
    kept is then true); an empty table gives no rows; other columns are not read.
    """
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return _found(df, size, percent, id_col, text_col).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id.

    What goes is decided by id and text, so that rows which share an id but not their group each have their say. Of
    rows that repeat id and text one stays; rows without an id go for one that has an id; documents without a shingle
    all stay.
    """
    found = _found(df, size, percent, id_col, text_col).where("set_key IS NOT NULL")
    is_first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_key") == F.col("first.text_key"))
    key, gone_id, gone_key = free_names(df, "_key", "_gone_id", "_gone_key")
    pair = (F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    rest = df.withColumn(key, text_key(text_col)).join(found.where(~is_first).select(*pair).distinct(), same, "left_anti")
    again = found.where(is_first).groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():
        again = materialize(again, "repeated-rows")
        rest = rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([id_col, key]))
    return rest.drop(key)


#: The same for three-word shingles and 85 percent, comparing all documents that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT n.doc_id, n.n AS n_shingles, m.u AS component_id, n.doc_id = m.u AS kept FROM n JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = n.doc_id
"""
