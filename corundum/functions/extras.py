"""Time buckets, vectors, full text and distances on a sphere."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


#: Microseconds of the units that a bucket's width may have.
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(width: str) -> int:
    """A width such as '5 minutes' in microseconds."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", width.lower())
    if not found or found[2] not in UNITS or not int(found[1]):
        raise ValueError(f"bad width {width}")
    return int(found[1]) * UNITS[found[2]]


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the bucket of a width such as '5 minutes', counted from 1970; null for a null time.  Use a session in UTC."""
    size = F.lit(micros(width))
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, size))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    la, lb = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def terms(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def match(text: Column, query: str) -> Column:
    """True where the text has every word of the query, as whole words; each is searched for, texts are not taken apart.

    A query without any word matches nothing.
    """
    low = F.lower(text)
    found = [low.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{w}\E(?![\p{{L}}\p{{N}}])") for w in query_words(query)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key) pairs; keep it in a table with an index on term to look terms up without reading texts."""
    return df.select(F.explode(terms(F.col(text))).alias("term"), F.col(key))


def search(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys of an inverted index (term, key) that have every word of the query: only the postings of its words are read."""
    words = query_words(query)
    hits = index.filter(F.col("term").isin(words)).select("term", key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return hits.filter(F.col("_n") == max(1, len(words))).select(key)
