"""Seeded hash keys: the same sample on any engine and under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """md5 of `seed:col:col...` as hex, a uniform sort key."""
    parts = [F.lit(str(seed))] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_int(seed, *cols) -> Column:
    """First 60 bits of the hash key, as bigint: enough for row numbers of any table."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 15), 16, 10).cast("bigint")
