"""Whole runs as queries: the standard workload, and the custom one in its other modes and beyond two formats.

Times are left out; what is compared is which metrics were taken, what succeeded, row counts and totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.plans import bindings as b
from paceline.plans.catalog import RUNS, TRIALS, Query, custom_workload
from paceline.plans.reports import custom_report, standard_report
from paceline.plans.runner import StandardRun, standard_run
from paceline.values import METRIC_COLUMNS, STANDARD_LEADERS, THRESHOLD_RUNS

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Metrics that a run without a handshake and without single-row statements does not take.
NOT_TAKEN = ("connection_time_ms", "total_single_insert_time_ms", "avg_single_insert_latency", "single_insert_rate")


def query(sql: str):
    """Register a query under its function name, with the SQL of its rows."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__], SQL[run.__name__] = run, sql
        return run

    return register


# --- the standard run, filled from customer and orders -------------------------------------------

PLACES = [("columnar", "parquet"), ("striped", "orc"), ("unknown", "db2"), ("lines", "json")]
WORKING = "(VALUES ('columnar'), ('striped'), ('lines')) c(connection_name)"


_RUNS: dict[tuple, StandardRun] = {}


def _standard_run(spark, sf_dir) -> StandardRun:
    """Made once per session: four queries look at it."""

    def source(session) -> tuple[DataFrame, DataFrame]:
        return b.users(session, sf_dir), b.money_orders(session, sf_dir)

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = standard_run(spark, PLACES, runs=RUNS, source=source)
    return _RUNS[key]


@query(
    f"""SELECT connection_name, db_type, position, db_type <> 'db2' AS success, metric,
      db_type <> 'db2' AND metric NOT IN {NOT_TAKEN} AS taken,
      CASE WHEN db_type = 'db2' THEN 'No queries configuration found for database type: db2' END AS error, {RUNS} AS runs
    FROM (VALUES {", ".join(f"('{name}', '{kind}', {i})" for i, (name, kind) in enumerate(PLACES))}) p(connection_name, db_type, position),
      (VALUES {", ".join(f"('{m}')" for m in METRIC_COLUMNS)}) m(metric)"""
)
def r07_standard_metrics(spark, sf_dir):
    """Which metrics each connection has."""
    metrics = _standard_run(spark, sf_dir).metrics
    long = metrics.unpivot(["connection_name", "db_type", "position", "success", "error"], METRIC_COLUMNS, "metric", "value")
    taken = (F.col("value").isNotNull() & (F.col("value") > 0)).alias("taken")
    return long.select("connection_name", "db_type", "position", "success", "metric", taken, "error", F.lit(RUNS).alias("runs"))


@query(
    f"""SELECT connection_name, table_name, statistic, text FROM {WORKING}, (
      SELECT 'benchmark_users' AS table_name, 'Row Count' AS statistic, format('{{:,}}', count(*)) AS text FROM customer
      UNION ALL SELECT 'benchmark_orders', 'Row Count', format('{{:,}}', count(*)) FROM orders)"""
)
def r08_standard_statistics(spark, sf_dir):
    long = standard_report(_standard_run(spark, sf_dir), wide=False)["statistics_long"]
    return long.where("statistic = 'Row Count'").select("connection_name", "table_name", "statistic", "text")


@query(
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) > 0 AS won_by_a_working_one, count(*) > 0 AS has_value FROM customer"
        for m in STANDARD_LEADERS
        if m not in NOT_TAKEN
    )
)
def r09_standard_leaders(spark, sf_dir):
    """The metrics that have a leader, and whether it can be one."""
    leaders = standard_report(_standard_run(spark, sf_dir), wide=False)["leaders"]
    working = F.col("connection_name").isin("columnar", "striped", "lines").alias("won_by_a_working_one")
    return leaders.select("metric", working, (F.col("value") > 0).alias("has_value"))


@query("SELECT 'unknown' AS connection_name, 'No queries configuration found for database type: db2' AS error")
def r10_standard_failures(spark, sf_dir):
    return standard_report(_standard_run(spark, sf_dir), wide=False)["failures"].select("connection_name", "error")


# --- the custom run: threshold, trials, and more formats -----------------------------------------

FILES = "(VALUES ('columnar'), ('striped')) c(connection_name)"


@query(
    f"""WITH goal AS (SELECT count(*) AS t FROM lineitem),
    tables AS (SELECT 0 AS position, 'clients' AS table_name, count(*) AS n FROM customer
      UNION ALL SELECT 1, 'orders', count(*) FROM orders UNION ALL SELECT 2, 'broken', 0)
    SELECT connection_name, position, table_name,
      CASE WHEN n > 0 THEN n * CAST(ceil(t * 1.0 / n) AS BIGINT) ELSE 0 END AS rows_loaded, n > 0 AS success
    FROM {FILES}, tables, goal"""
)
def r11_threshold_loads(spark, sf_dir):
    """Tables filled with copies up to the lines' number, which is above both; queries run 5 times, as this mode does."""
    goal = b.table(spark, sf_dir, "lineitem").count()
    loads = custom_workload(spark, sf_dir, threshold=goal, runs=None).loads
    return loads.select("connection_name", "position", "table_name", "rows_loaded", "success")


@query(
    f"""SELECT connection_name, query_name, success, {THRESHOLD_RUNS} AS runs, true AS timed_if_good FROM {FILES},
      (VALUES ('all clients', true), ('totals', true), ('no such column', false)) q(query_name, success), (SELECT count(*) FROM orders)"""
)
def r11_threshold_timings(spark, sf_dir):
    goal = b.table(spark, sf_dir, "lineitem").count()
    timings = custom_workload(spark, sf_dir, threshold=goal, runs=None).timings
    timed = (F.col("success") == (F.col("execution_time_ms") > 0)).alias("timed_if_good")
    return timings.select("connection_name", "query_name", "success", F.lit(THRESHOLD_RUNS).alias("runs"), timed)


@query(
    f"""SELECT connection_name, position, table_name, rows_loaded, success, success AS timed, {TRIALS} AS trials, {RUNS} AS runs
    FROM {FILES}, (SELECT 0 AS position, 'clients' AS table_name, count(*) AS rows_loaded, true AS success FROM customer
      UNION ALL SELECT 1, 'orders', count(*), true FROM orders UNION ALL SELECT 2, 'broken', 0, false)"""
)
def r12_trial_loads(spark, sf_dir):
    """Tables made anew and loaded several times."""
    loads = custom_workload(spark, sf_dir, threshold=0, trials=TRIALS, runs=RUNS).loads
    counts = [F.lit(TRIALS).alias("trials"), F.lit(RUNS).alias("runs")]
    return loads.select("connection_name", "position", "table_name", "rows_loaded", "success", (F.col("load_time_ms") > 0).alias("timed"), *counts)


MORE = ("json", "csv")
FOUR = "(VALUES ('columnar'), ('striped'), ('json'), ('csv')) c(connection_name)"


@query(
    f"""SELECT connection_name, 'OK' AS state, tables_imported, total_rows_loaded, CAST(NULL AS VARCHAR) AS error
    FROM {FOUR}, (SELECT 3 AS tables_imported, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS total_rows_loaded)
    UNION ALL SELECT * FROM (VALUES
      ('columnar (2)', 'failed', 0, 0, 'Unsupported database type: avro'),
      ('elsewhere', 'failed', 0, 0, 'Unsupported database type: db2'))"""
)
def r13_more_connections(spark, sf_dir):
    """Two failing connections among four that work: all others keep their totals."""
    run = custom_workload(spark, sf_dir, MORE)
    totals = run.results.join(run.imports, "connection_name", "left")
    count = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tables_imported", "total_rows_loaded")]
    return totals.select("connection_name", F.when(F.col("success"), "OK").otherwise("failed").alias("state"), *count, "error")


@query(
    f"""SELECT connection_name, table_name, text FROM {FOUR}, (
      SELECT 'clients' AS table_name, format('{{:,}}', count(*)) AS text FROM customer
      UNION ALL SELECT 'orders', format('{{:,}}', count(*)) FROM orders UNION ALL SELECT 'broken', '0')"""
)
def r13_more_statistics(spark, sf_dir):
    """The same run's row counts."""
    long = custom_report(custom_workload(spark, sf_dir, MORE), wide=False)["statistics_long"]
    return long.where("statistic = 'Row Count'").select("connection_name", "table_name", "text")
