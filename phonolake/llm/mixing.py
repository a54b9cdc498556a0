"""Mixing of sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, join_on_key, number_among_equal

#: A Poisson count of a larger mean is the sum of counts of means up to this, whose probabilities a double can hold.
MOST_MEAN = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, 52 bits of it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(count <= k) for k from 0 to far beyond the mean, as an array."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    none = F.exp(-mean)
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(none.alias("p"), F.array(none).alias("cdf")), step)["cdf"]


def rates(df: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """One row for each source: source_key, n_docs, rate (the mean number of copies of each of its documents), parts, cdf.

    Target weights are those given (a source without one gets 0), or n_docs ** exponent. The copies of all sources
    add up to total (the number of input rows where None) on average. Null is a source of its own.
    """
    key = source_key(source_col)
    n = df.groupBy(key.alias("source_key")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(float(exponent))))
    else:
        known = {"n" if k is None else f"s{k}": float(v) for k, v in weights.items()}
        pairs = [F.lit(x) for kv in known.items() for x in kv] or [F.lit(""), F.lit(0.0)]
        n = n.withColumn("w", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source_key")), F.lit(0.0)))
    whole = n.agg(F.sum("w").alias("w_all"), F.sum("n_docs").alias("n_all"))  # one row
    rate = F.coalesce(F.try_divide((F.lit(float(total)) if total is not None else F.col("n_all")) * F.col("w") / F.col("w_all"), F.col("n_docs")), F.lit(0.0))
    out = n.join(F.broadcast(whole)).select("source_key", "n_docs", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int"))
    return out.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def source_key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Repeat every document a Poisson number of times, then shuffle all copies globally.

    The count inverts the Poisson distribution of the source's rate at a number hashed from seed and the document's
    id: the same in every run, whatever the partitioning. Adds mix_n (copies of this document), mix_copy (from 0)
    and mix_key; rows lie in hash partitions of mix_key, ordered by it, which is a seeded global shuffle.

    Rows that share an id, or have none, are drawn one by one, each with a number of its own in its hash: their counts
    depend on how the table is read. A source of rate 0 leaves; all of the input's columns are kept, those named like
    the added ones are replaced; an empty table stays empty.
    """
    df = df.drop("mix_n", "mix_copy", "mix_key")
    source, parts, cdf, number, doc = free_names(df, "_source", "_parts", "_cdf", "_number", "_doc")
    table = rates(df, weights, exponent, total, source_col).select(F.col("source_key").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = number_among_equal(df, id_col, None, number)
    rows = rows.withColumn(doc, F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(number))).withColumn(source, source_key(source_col))
    one = lambda k: F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(str(seed)), k.cast("string"), F.col(doc))))
    count = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda n, k: n + one(k))
    out = join_on_key(rows, table, source).withColumn("mix_n", count).where("mix_n > 0").drop(source, parts, cdf, number)
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(doc), F.col("mix_copy").cast("string")).cast("binary"))).drop(doc)
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


SQL = """
WITH n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
r AS (SELECT source, (SELECT count(*) FROM documents) * sqrt(n_docs) / (SELECT sum(sqrt(n_docs)) FROM n) / n_docs AS rate FROM n),
k AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c
      FROM r, range(0, 200) t(k)),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('17:0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM k WHERE k.source = u.source AND k.c <= u.u) AS mix_n FROM u)
SELECT doc_id, source, md5(text) AS text_md5, mix_n::INTEGER AS mix_n, c::INTEGER AS mix_copy, md5('17:order:' || doc_id || ':' || c) AS mix_key
FROM m, LATERAL (SELECT unnest(range(0, mix_n)) AS c)
"""
