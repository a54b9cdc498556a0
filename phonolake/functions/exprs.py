"""Column expressions that the operators share. All stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, with single apostrophes inside.
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*"


def turkish_lower(c: Column) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"))


def sha1_mod100(c: Column) -> Column:
    """The SHA-1 of a text, as a number, modulo 100: its five 32-bit parts folded with 2**32 mod 100 = 96."""
    digest = F.sha1(F.encode(c, "UTF-8"))
    out = F.lit(0).cast("long")
    for k in range(5):
        out = (out * 96 + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) % 100
    return out


#: Named schemes of speaker-disjoint splits: (split, buckets below).
SPLITS = {"90_5_5": (("train", 90), ("dev", 95), ("test", 100)), "90_10": (("train", 90), ("test", 100)), "80_10_10": (("train", 80), ("dev", 90), ("test", 100))}


def split_of(speaker: Column, scheme: str) -> Column:
    """A speaker's split: the same for all of the speaker's rows. Without a speaker: train."""
    bucket, out = sha1_mod100(speaker), F.lit(None).cast("string")
    for name, below in reversed(SPLITS[scheme]):
        out = F.when(bucket < below, F.lit(name)).otherwise(out)
    return F.when(speaker.isNull() | (speaker == ""), F.lit("train")).otherwise(out)


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast("decimal(20,6)")).cast("double")


def exact_avg(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def rate_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def error_rate(edits: Column, ref_len: Column) -> Column:
    """Edits by length of the reference; an empty reference is right (0) if nothing was to edit, else wrong (1)."""
    return F.when(ref_len > 0, edits / ref_len).when(edits == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def rate_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the Wilson interval of a proportion; null without trials."""
    p = F.try_divide(successes.cast("double"), n)
    some = F.nullif(n, F.lit(0))
    half = z * F.sqrt(p * (1 - p) / some + z * z / (4 * some * some))
    middle, scale = p + z * z / (2 * some), 1 + z * z / some
    return F.when(n > 0, F.greatest(F.lit(0.0), (middle - half) / scale)), F.when(n > 0, F.least(F.lit(1.0), (middle + half) / scale))


def empty_as(c: Column, label: str) -> Column:
    """Null and blank texts as a label."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(label))


def length_cue_score(z: Column, tau: Column) -> Column:
    return F.exp(-0.5 * F.pow(z / tau, F.lit(2.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def next_after(c: Column) -> Column:
    """The next greater double: a threshold just above a value."""

    @F.pandas_udf("double")
    def up(x: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.to_numpy(float), np.inf))

    return up(c.cast("double"))
