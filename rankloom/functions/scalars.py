"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(x: Column, digits: int) -> Column:
    """Round half away from zero on the *binary* value (``floor(|x| 10^d + 0.5)``),
    as C's ``round`` and Python's ``round`` see a double. Spark's ``round`` rounds
    the shortest decimal string instead, so 36.035 (stored as 36.03499...) would
    go up. Used where ties at the last kept digit are common (e.g. medians of
    2-decimal latencies)."""
    p = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``TIMESTAMP_NTZ`` wall-clock value,
    independent of the session time zone (no cast to a zoned timestamp)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_epoch_seconds(x: Column) -> Column:
    """Epoch seconds -> ``TIMESTAMP_NTZ`` holding the UTC wall clock, zone-independent."""
    return F.timestamp_add("SECOND", x, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
