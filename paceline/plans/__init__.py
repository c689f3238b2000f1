"""Runs: timed queries, the standard workload and custom workloads, and their reports."""

from paceline.plans.reports import custom_report, standard_report
from paceline.plans.runner import (
    CustomRun,
    QuerySet,
    StandardRun,
    custom_run,
    read_query_sets,
    run_queries,
    standard_run,
    standard_schema,
    time_df,
)

__all__ = [
    "CustomRun",
    "QuerySet",
    "StandardRun",
    "custom_report",
    "custom_run",
    "read_query_sets",
    "run_queries",
    "standard_report",
    "standard_run",
    "standard_schema",
    "time_df",
]
