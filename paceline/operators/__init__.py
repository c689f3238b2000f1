"""Queries, constraint checks, storage footprint, measurement reports and comparison tables."""
