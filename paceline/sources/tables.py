"""Tables: DDL, loads that report instead of raising, repeated and multiplied loads, sorted layout.

A target is a path (anything with a ``/``, written as files of ``fmt``) or the name of a catalog table,
which must exist and is filled by position, so its DDL keeps the column types, length limits and defaults.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paceline.errors import error_text
from paceline.functions import exact_sum, round2
from paceline.schemas import LOAD
from paceline.session import report_rows, scratch_path

# Bytes one task should write when a table is multiplied, and an estimate that says nothing.
BYTES_PER_TASK = 128 << 20
UNKNOWN_BYTES = 1 << 60


def apply_ddl(spark: SparkSession, statements: list[str | None]) -> int:
    """Run DDL statements in order, skipping empty ones; returns how many ran."""
    wanted = [s for s in statements if s and s.strip()]
    for statement in wanted:
        spark.sql(statement)
    return len(wanted)


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def append(df: DataFrame, target: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Add all rows to a target in one job, or replace its rows."""
    if "/" in target:
        df.write.mode("overwrite" if overwrite else "append").format(fmt).save(target)
    else:
        df.write.insertInto(target, overwrite=overwrite)


def stage(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a DataFrame to the shared scratch folder and read it back.

    The plan is cut there: a lost executor costs nothing but reading files again. And the optimizer now
    knows the true size, so a small result is broadcast and a large one is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", files: int | None = None) -> None:
    """Write files that are sorted by ``keys`` inside and cover one key range each.

    Parquet keeps the smallest and largest value per row group, so a filter on the leading keys skips
    most of the data. A key that many rows share would make one huge range, so rows of one key are split
    further by the partition they come from and by their hash. Both stay the same when a lost task is
    repeated, which a random number would not: rows could then be lost or doubled.
    """
    hashed = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    spread = df.withColumn("_from", F.spark_partition_id()).withColumn("_hash", F.xxhash64(*hashed))
    by = [*keys, "_from", "_hash"]
    ranged = spread.repartitionByRange(files, *by) if files else spread.repartitionByRange(*by)
    rows = ranged.sortWithinPartitions(*keys).drop("_from", "_hash")
    rows.write.mode("errorifexists").format(fmt).save(path)


def _load_row(connection: str, position: int, table: str, csv_file: str | None, rows, ms, error) -> tuple:
    ms = round(ms, 2) if error is None else 0.0
    return (connection, position, table, csv_file, rows if error is None else 0, ms, error is None, error)


def _attempt(read: Callable[[], DataFrame], target: str, fmt: str, overwrite: bool) -> tuple:
    """Run one load: rows written, milliseconds, error text or None.

    The rows are counted by the writing tasks themselves, so the input is read once. Spark counts a task
    that had to be repeated only once, as the count sits in the last stage.
    """
    start = time.perf_counter()
    try:
        counted = Observation()
        append(read().observe(counted, F.count(F.lit(1)).alias("n")), target, fmt, overwrite)
        return counted.get["n"], (time.perf_counter() - start) * 1000, None
    except Exception as error:  # a failed load is a result row
        return 0, 0.0, error_text(error)


def load_table(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    target: str,
    table: str,
    csv_file: str | None = None,
    connection: str = "spark",
    position: int = 0,
    fmt: str = "parquet",
    overwrite: bool = False,
) -> DataFrame:
    """Load what ``read`` returns into a target and report it as one LOAD row.

    A failure gives 0 rows, 0 ms and the error text. A failed job commits no files.
    """
    rows, ms, error = _attempt(read, target, fmt, overwrite)
    return report_rows(spark, [_load_row(connection, position, table, csv_file, rows, ms, error)], LOAD)


def load_refused(
    spark: SparkSession, table: str, csv_file: str | None, error: str, connection: str = "spark", position: int = 0
) -> DataFrame:
    """The LOAD row of a load that was not tried."""
    return report_rows(spark, [_load_row(connection, position, table, csv_file, 0, 0.0, error)], LOAD)


def trial_load(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    target: str,
    table: str,
    csv_file: str | None = None,
    connection: str = "spark",
    position: int = 0,
    trials: int = 50,
    fmt: str = "parquet",
    prepare: Callable[[], object] | None = None,
) -> DataFrame:
    """Load ``trials`` times, replacing the rows each time, and report one LOAD row.

    ``prepare`` runs before every load (drop and create the table). The time is the mean over all trials,
    a failed one counting as 0 ms; rows, success and error are those of the last trial.
    """
    attempts = []
    for number in range(trials):
        if prepare:
            prepare()
        rows, ms, error = _attempt(read, target, fmt, overwrite=True)
        attempts.append((number, *_load_row(connection, position, table, csv_file, rows, ms, error)))
    schema = "trial_no int, " + ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in LOAD)
    runs = report_rows(spark, attempts, schema)
    return trial_summary(runs, ["connection_name", "position", "table_name", "csv_file_name"]).select(*LOAD.names)


def trial_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Per table: mean time over its trials; rows, success and error of the last one (by ``trial_no``).

    The first step groups by the error text as well, which keeps every aggregate in the hash aggregate and
    leaves few rows for the second, where picking the last error text needs a sort.
    """
    ms = F.coalesce(F.when(F.col("success"), F.col("load_time_ms")), F.lit(0.0))
    by_error = trials.groupBy(*keys, "error_message").agg(
        F.max_by("rows_loaded", "trial_no").alias("rows_loaded"),
        F.max_by("success", "trial_no").alias("success"),
        F.max("trial_no").alias("trial_no"),
        exact_sum(ms).alias("ms"),
        F.count(F.lit(1)).alias("n"),
    )
    return by_error.groupBy(*keys).agg(
        F.max_by("rows_loaded", "trial_no").alias("rows_loaded"),
        round2(exact_sum("ms") / F.sum("n")).alias("load_time_ms"),
        F.max_by("success", "trial_no").alias("success"),
        F.max_by("error_message", "trial_no").alias("error_message"),
    )


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def copies_needed(rows: int, threshold: int) -> int:
    """How often a table of ``rows`` rows is loaded to hold at least ``threshold``: at least once."""
    if rows < 1:
        raise ValueError("no rows to load: the threshold can never be reached")
    return max(1, -(-threshold // rows))


def _planned(df: DataFrame) -> tuple[int, int]:
    """Partitions and estimated bytes of a DataFrame, from its plan."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.rdd.getNumPartitions(), size


def scale_to_threshold(df: DataFrame, threshold: int, rows: int | None = None) -> DataFrame:
    """All rows ``copies_needed`` times, numbered by ``copy_no`` from 0.

    Copies are made where the rows are read, unless the output is estimated to need more tasks than the input has
    partitions; then rows are dealt out evenly first. That shuffle moves the rows, not their copies. Where there are
    fewer rows than tasks each row goes out once per block of copies. Give ``rows`` when the count is known, to
    save the counting job.
    """
    rows = df.count() if rows is None else rows
    copies = copies_needed(rows, threshold)
    partitions, size = _planned(df)
    tasks = -(-size * copies // BYTES_PER_TASK) if size < UNKNOWN_BYTES else 1
    if tasks <= partitions:
        return df.withColumn("copy_no", F.explode(F.sequence(_big(0), _big(copies - 1))))
    blocks = min(copies, -(-tasks // rows))
    per_block = -(-copies // blocks)
    first = F.col("_block") * per_block
    last = F.least(first + (per_block - 1), _big(copies - 1))
    return (
        df.withColumn("_block", F.explode(F.sequence(_big(0), _big(-(-copies // per_block) - 1))))
        .repartition(tasks)
        .withColumn("copy_no", F.explode(F.sequence(first, last)))
        .drop("_block")
    )


def load_to_threshold(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    target: str,
    table: str,
    threshold: int,
    csv_file: str | None = None,
    connection: str = "spark",
    position: int = 0,
    fmt: str = "parquet",
    keep_copy_no: bool = False,
    count: Callable[[], int] | None = None,
) -> DataFrame:
    """Fill a target with whole copies of a table until it holds ``threshold`` rows, as one LOAD row.

    One job writes all copies, so the time is that of the whole load; the rows are counted before it starts, by ``count``
    if that is given. An empty or unreadable input gives an error row. ``keep_copy_no`` adds the copy number as last
    column, which keeps repeated primary keys apart.
    """
    try:
        rows = count() if count else read().count()
    except Exception as error:  # a failed load is a result row
        return load_refused(spark, table, csv_file, error_text(error), connection, position)

    def copies() -> DataFrame:
        scaled = scale_to_threshold(read(), threshold, rows)
        return scaled if keep_copy_no else scaled.drop("copy_no")

    return load_table(spark, copies, target, table, csv_file, connection, position, fmt)
