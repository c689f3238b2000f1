"""Where rows come from and go to: generators, workload files, CSV, JDBC and tables."""

from paceline.sources.config import Config, missing_files, read_config, resolve_text
from paceline.sources.csv import CSV_DIALECTS, csv_dialect_of, read_csv
from paceline.sources.generate import gen_orders, gen_users
from paceline.sources.jdbc import JDBC_DRIVERS, read_jdbc, write_jdbc
from paceline.sources.layout import file_ranges, files_holding, layout_report, overlap_depth
from paceline.sources.records import csv_records
from paceline.sources.tables import (
    append,
    apply_ddl,
    drop_table,
    load_refused,
    load_table,
    load_to_threshold,
    scale_to_threshold,
    stage,
    trial_load,
    trial_summary,
    write_sorted,
)

__all__ = [
    "CSV_DIALECTS",
    "Config",
    "JDBC_DRIVERS",
    "append",
    "apply_ddl",
    "csv_dialect_of",
    "csv_records",
    "drop_table",
    "file_ranges",
    "files_holding",
    "gen_orders",
    "gen_users",
    "layout_report",
    "load_refused",
    "load_table",
    "load_to_threshold",
    "missing_files",
    "overlap_depth",
    "read_config",
    "read_csv",
    "read_jdbc",
    "resolve_text",
    "scale_to_threshold",
    "stage",
    "trial_load",
    "trial_summary",
    "write_jdbc",
    "write_sorted",
]
