"""Arithmetic shared by the reports. All of it stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_MS = 1_000_000


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c: Column | str) -> Column:
    """Two places, halves up, computed on the double itself (1.005 is stored below the half: 1.0)."""
    return F.floor(_column(c) * 100 + 0.5) / 100


def rate(rows: Column | str, ms: Column | str) -> Column:
    """Rows per second; 0 when no time was measured."""
    rows, ms = _column(rows), _column(ms)
    return F.when(ms > 0, rows / (ms / 1000)).otherwise(0.0)


def latency(ms: Column | str, rows: Column | str) -> Column:
    """Milliseconds per row; 0 when there are no rows."""
    ms, rows = _column(ms), _column(rows)
    return F.when(rows > 0, ms / rows).otherwise(0.0)


def size_mb(size: Column | str) -> Column:
    """Bytes as mebibytes with two places."""
    return round2(_column(size) / 1024 / 1024)


def bytes_per_row(data_bytes: Column | str, rows: Column | str) -> Column:
    """Data bytes (without indexes) per row, not rounded; 0 for an empty table."""
    data_bytes, rows = _column(data_bytes), _column(rows)
    return F.when(rows > 0, data_bytes / rows).otherwise(0.0)


def db_name(url: Column | str) -> Column:
    """Database of a connection URL: cut at the first ``?``, keep what follows the last ``/``."""
    return F.substring_index(F.substring_index(_column(url), "?", 1), "/", -1)


def exact_sum(ms: Column | str) -> Column:
    """Sum of milliseconds that does not depend on the order in which tasks finish.

    Adding doubles gives other last digits with another partitioning. Here each value becomes a whole
    number of nanoseconds, and whole milliseconds and the rest are added as two bigints, so the sum can
    pass 2^63 nanoseconds.
    """
    nanos = F.floor(_column(ms) * NANOS_PER_MS + 0.5)
    whole = F.sum(F.call_function("div", nanos, F.lit(NANOS_PER_MS)))
    rest = F.sum(nanos % NANOS_PER_MS)
    return whole + rest / NANOS_PER_MS
