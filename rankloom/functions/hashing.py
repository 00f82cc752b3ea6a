"""Portable hashing: the same integer in Spark and in plain SQL engines.

``portable_hash(s) = int(first 8 hex digits of md5(s), 16)``; md5 exists in
every engine, so sampling decisions can be reproduced by an independent
oracle. (xxhash64 has no portable equal.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    s = F.concat_ws("", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def sql_portable_hash(expr: str) -> str:
    """DuckDB form of :func:`portable_hash` for a string expression."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"
