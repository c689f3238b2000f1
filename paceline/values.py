"""Names, texts, labels and settings that results must carry exactly as they are here."""

from __future__ import annotations

# Generated users and orders.
USER_NAME_START = "BenchUser_"
USER_NAME_END = "1"
EMAIL_START = "user_"
EMAIL_END = "@benchmark.com"
FIRST_AMOUNT = 10

# Settings of the workloads.
READ_RUNS = 50
THRESHOLD_RUNS = 5
LOAD_TRIALS = 50
JOIN_BOUND = 50.0
TOTAL_BOUND = 10.0

# Standard tables, and the longest texts that their columns take.
USERS_TABLE = "benchmark_users"
ORDERS_TABLE = "benchmark_orders"
TEXT_LIMITS = {"name": 100, "email": 100}

# Driver class of each database type.
JDBC_DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
    "oraclesql": "oracle.jdbc.OracleDriver",
    "duckdb": "org.duckdb.DuckDBDriver",
}

# How each database reads CSV; None: it has no bulk load.
CSV_DIALECTS = {
    "mysql": "raw",
    "postgresql": "quoted",
    "mariadb": "raw",
    "clickhouse": "named",
    "oraclesql": None,
    "duckdb": "quoted",
}

# Messages.
NO_QUERIES = "No queries configuration found for database type: "
UNSUPPORTED = "Unsupported database type: "
NOT_UPLOADED = " not uploaded"
NO_MESSAGE = "Check table import or queries failure above."

# Category of a query that has none.
NO_CATEGORY = "QUERY"

# Columns of a metric row that hold a measurement, in report order.
METRIC_COLUMNS = [
    "connection_time_ms",
    "schema_creation_time_ms",
    "total_single_insert_time_ms",
    "avg_single_insert_latency",
    "single_insert_rate",
    "batch_insertion_time_ms",
    "batch_insertion_rate",
    "read_time_ms",
    "join_time_ms",
    "aggregate_time_ms",
]

# Metrics drawn for a standard comparison.
CHARTED = [
    "connection_time_ms",
    "schema_creation_time_ms",
    "batch_insertion_rate",
    "single_insert_rate",
    "read_time_ms",
    "join_time_ms",
    "aggregate_time_ms",
]

# Which metrics lead a standard comparison and a custom workload, and whether lower is better.
STANDARD_LEADERS = {
    "connection_time_ms": True,
    "batch_insertion_rate": False,
    "avg_single_insert_latency": True,
    "read_time_ms": True,
}
CUSTOM_LEADERS = {
    "total_import_time_ms": True,
    "csv_import_rate": False,
    "average_table_import_time_ms": True,
    "avg_query_time_ms": True,
}

# How numbers are written: whole with grouping, two places with grouping, two places without.
WHOLE = "whole"
GROUPED = "grouped"
PLAIN = "plain"

# Rows of the statistics grid, in report order: label, column, unit, style.
STATISTICS = [
    ("Row Count", "row_count", "", WHOLE),
    ("Data Size (Bytes)", "data_size_bytes", " Bytes", WHOLE),
    ("Total Size (Bytes)", "total_size_bytes", " Bytes", WHOLE),
    ("Total Size (MB)", "total_size_mb", " MB", GROUPED),
    ("Avg Bytes / Row", "bytes_per_row", " Bytes", PLAIN),
]

# Rows of the import grid, in report order: label, column, unit, style.
IMPORT_TOTALS = [
    ("Total Rows Loaded", "total_rows_loaded", "", WHOLE),
    ("Total Import Time (ms)", "total_import_time_ms", " ms", PLAIN),
    ("Average Table Import (ms)", "average_table_import_time_ms", " ms", PLAIN),
    ("CSV Import Rate (rows/s)", "csv_import_rate", " rows/s", GROUPED),
]
