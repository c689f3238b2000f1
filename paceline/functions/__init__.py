"""Column expressions."""

from paceline.functions.measures import (
    bytes_per_row,
    db_name,
    exact_sum,
    latency,
    rate,
    round2,
    size_mb,
)

__all__ = ["bytes_per_row", "db_name", "exact_sum", "latency", "rate", "round2", "size_mb"]
