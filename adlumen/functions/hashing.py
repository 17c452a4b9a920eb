"""Deterministic row buckets, equal under any partitioning and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_number(key: Column, seed: int = 42) -> Column:
    """32-bit number from the md5 of ``key|seed``."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    """Bucket in ``0 .. buckets-1``."""
    return (hash_number(key, seed) % F.lit(buckets)).cast("int")
