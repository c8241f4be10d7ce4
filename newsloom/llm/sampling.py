"""Bounded, repeatable samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in no part."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def lowest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those whose key hashes lowest: the same rows on every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)
