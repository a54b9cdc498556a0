"""Names and keys taken from texts and paths."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import turkish_lower


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Composed form; Spark has no function for it, so batches go through Python."""
    return _composed(c)


def bare(c: Column) -> Column:
    """Without the punctuation (ASCII) and white space around it."""
    return F.regexp_replace(c, r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def plain_word(c: Column) -> Column:
    """Lower case without punctuation but apostrophes."""
    return turkish_lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s'’]", ""))


def edged_word(c: Column) -> Column:
    """Lower case without what is no letter, digit or underscore at either end, and without apostrophes."""
    return F.replace(turkish_lower(F.regexp_replace(c, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), F.lit("'"), F.lit(""))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def last_number(c: Column) -> Column:
    """The last run of digits, or an empty text."""
    return F.regexp_extract(c, r"(\d+)\D*$", 1)


def safe_component(c: Column) -> Column:
    """Whether a text may name a file: letters, digits, dots, underscores and dashes only, and not the folder or its parent."""
    return c.rlike("^[A-Za-z0-9._-]+$") & ~c.isin(".", "..")


def speaker_of(provider: Column, segment: Column, path: Column, client: Column, folder: Column) -> Column:
    """speaker_id, speaker_source by the provider's rule; a folder stands before the path's second part."""
    short = lambda c: F.substring(F.sha1(c.cast("binary")), 1, 12)
    place = F.coalesce(F.nullif(folder, F.lit("")), F.split_part(path, F.lit("/"), F.lit(2)))
    split = F.when(folder.isin("train", "dev", "test"), folder).otherwise(F.split_part(segment, F.lit("_"), F.lit(2)))
    rules = {
        "common_voice": (F.coalesce(client, F.concat(F.lit("common_voice_missing_"), short(segment))), F.when(client.isNull(), "missing_cv_client_id").otherwise("validated.tsv.client_id")),
        "issai_tsc": (F.concat(F.lit("issai_"), split), F.lit("issai_split_fallback")),
        "audiobooks": (F.concat(F.lit("audiobook_"), short(place)), F.lit("book_folder")),
        "podcasts": (F.concat(F.lit("podcast_"), short(place)), F.lit("podcast_name")),
        "youtube": (F.concat(F.lit("youtube_"), short(place)), F.lit("yt_channel")),
    }
    who, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in rules.items():
        who, source = F.when(provider == name, a).otherwise(who), F.when(provider == name, b).otherwise(source)
    known = F.coalesce(provider.isin(list(rules)), F.lit(False))
    return F.struct(F.when(known, who).otherwise(F.concat(F.lit("legacy_unknown_"), short(segment))).alias("speaker_id"), F.when(known, source).otherwise("unknown_provider").alias("speaker_source"))


def shard_of(spec: str) -> tuple[list[int], int]:
    """('2,5/7') the shards from 0, sorted, and how many there are; the spec counts from 1."""
    found = re.fullmatch(r"(\d+(?:,\d+)*)/(\d+)", spec.strip())
    if not found:
        raise ValueError("a shard is N/TOTAL or A,B/TOTAL")
    total, wanted = int(found[2]), sorted({int(x) for x in found[1].split(",")})
    if total < 1 or wanted[0] < 1 or wanted[-1] > total:
        raise ValueError(f"shards go from 1 to {total}: {spec}")
    return [x - 1 for x in wanted], total


def in_shard(id_: Column, spec: str) -> Column:
    """Whether an id (from 1) is in the shards of a spec."""
    wanted, total = shard_of(spec)
    return ((id_ - 1) % total).isin(wanted)


def noted_id(notes: Column, key: str = "ref_feature_id") -> Column:
    """The number that notes give for a key, or null."""
    return F.nullif(F.regexp_extract(notes, f"{key}=([0-9]+)", 1), F.lit("")).try_cast("long")
