"""Averages, roll-ups and leaders over measurement rows.

Every group is reduced inside the tasks before rows are shuffled, and "first row wins" is an aggregate
over ``position`` instead of a window, so one connection with a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import exact_sum, rate, round2
from paceline.values import CUSTOM_LEADERS, STANDARD_LEADERS


def mean_runs(runs: DataFrame, keys: list[str], ms: str = "execution_time_ms") -> DataFrame:
    """Mean time of the runs of each key, with two places, and the number of runs."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), round2(exact_sum(ms) / F.count(F.lit(1))).alias("mean_ms")
    )


def import_metrics(loads: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per connection: tables, rows, total time, mean time per table and rows per second.

    Failed loads count as tables with 0 rows and 0 ms. The mean and the rate use the unrounded total. With
    ``results`` each connection in it has a row, of zeros if it has no load. Names tell connections apart.
    """
    if results is not None:
        names = results.select("connection_name").distinct()
        return with_imports(names, import_metrics(loads))
    totals = loads.groupBy("connection_name").agg(
        F.count(F.lit(1)).alias("tables_imported"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0).cast("bigint")).alias("total_rows_loaded"),
        F.coalesce(exact_sum("load_time_ms"), F.lit(0.0)).alias("_ms"),
        F.coalesce(F.bool_or("success"), F.lit(False)).alias("any_loaded"),
    )
    return totals.select(
        "connection_name",
        "tables_imported",
        "total_rows_loaded",
        round2("_ms").alias("total_import_time_ms"),
        round2(F.col("_ms") / F.col("tables_imported")).alias("average_table_import_time_ms"),
        round2(rate("total_rows_loaded", "_ms")).alias("csv_import_rate"),
        "any_loaded",
    )


def with_imports(results: DataFrame, imports: DataFrame) -> DataFrame:
    """Results with their import totals; a connection that imported no table has zeros."""
    zero = F.lit(0).cast("bigint")
    joined = results.join(imports, "connection_name", "left")
    return joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), zero) for c in ("tables_imported", "total_rows_loaded")},
            **{
                c: F.coalesce(F.col(c), F.lit(0.0))
                for c in ("total_import_time_ms", "average_table_import_time_ms", "csv_import_rate")
            },
            "any_loaded": F.coalesce("any_loaded", F.lit(False)),
        }
    )


def avg_query_time(timings: DataFrame) -> DataFrame:
    """Mean time of each connection's successful queries; +Infinity, which ranks last, if it has none.

    ``shown`` is the text for the report: two places, or N/A.
    """
    good = F.when(F.col("success"), F.col("execution_time_ms"))
    means = timings.groupBy("connection_name").agg((exact_sum(good) / F.count_if("success")).alias("_mean"))
    mean = F.col("_mean")
    return means.select(
        "connection_name",
        F.coalesce(mean, F.lit(float("inf"))).alias("avg_query_time_ms"),
        F.coalesce(round2(mean).cast("decimal(18,2)").cast("string"), F.lit("N/A")).alias("shown"),
    )


def leaders(df: DataFrame, metrics: dict[str, bool], eligible: Column | None = None) -> DataFrame:
    """The best row for each metric: (metric, connection_name, value), and its db_type if rows have one.

    ``metrics`` says whether lower is better. Among equal values the row with the smallest ``position``
    wins. NULL values do not compete, nor do rows that are not ``eligible``. All metrics come from one
    pass that sends one row per task to the final step.
    """
    if eligible is not None:
        df = df.where(eligible)
    kind = ["db_type"] if "db_type" in df.columns else []
    best = []
    for metric, lower in metrics.items():
        value = F.col(metric).cast("double")
        order = F.struct(value if lower else -value, F.col("position"))
        row = F.struct("connection_name", value.alias("value"), *kind)
        best.append(F.min_by(row, F.when(value.isNotNull(), order)).alias(metric))
    names = list(metrics)
    return (
        df.agg(*best)
        .unpivot([], names, "metric", "best")
        .where(F.col("best").isNotNull())
        .select("metric", "best.connection_name", "best.value", *[f"best.{c}" for c in kind])
    )


def leader(df: DataFrame, metric: str, lower: bool = True) -> DataFrame:
    """The best successful row for one metric."""
    return leaders(df, {metric: lower}, F.col("success"))


def standard_leaders(metrics: DataFrame) -> DataFrame:
    """Leaders of a standard comparison among the successful connections."""
    return leaders(metrics, STANDARD_LEADERS, F.col("success"))


def custom_leaders(results: DataFrame, imports: DataFrame, queries: DataFrame, strict: bool = True) -> DataFrame:
    """Leaders of a custom workload among connections that succeeded.

    A connection that loaded nothing, or all of whose loads failed, spent 0 ms and would lead the time metrics; ``strict`` leaves
    it out of the import metrics. Connections without a successful query rank last by query time.
    """
    rows = (
        with_imports(results.where("success"), imports)
        .join(queries.select("connection_name", "avg_query_time_ms"), "connection_name", "left")
        .withColumn("avg_query_time_ms", F.coalesce("avg_query_time_ms", F.lit(float("inf"))))
    )
    if strict:
        for metric in ["total_import_time_ms", "csv_import_rate", "average_table_import_time_ms"]:
            rows = rows.withColumn(metric, F.when(F.col("any_loaded"), F.col(metric)))
    return leaders(rows, CUSTOM_LEADERS)
