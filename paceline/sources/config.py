"""Workload files: connections, tables with their CSV files, and queries by dialect."""

from __future__ import annotations

from typing import NamedTuple, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.schemas import CONFIG
from paceline.values import NO_QUERIES, NOT_UPLOADED

T = TypeVar("T")


class Config(NamedTuple):
    """The three parts of a workload file as tables. Credentials are left out on purpose."""

    connections: DataFrame
    tables: DataFrame
    queries: DataFrame


def read_config(spark: SparkSession, path: str, multiline: bool = True) -> Config:
    """Read workload files into connections, tables and queries.

    A file is one JSON document; with ``multiline=False`` it holds one document per line, which lets
    Spark split a file that describes many workloads.
    """
    docs = spark.read.schema(CONFIG).json(path, multiLine=multiline, mode="FAILFAST")

    def part(array: str) -> DataFrame:
        return docs.select(F.posexplode(array).alias("position", "e"))

    return Config(
        connections=part("connectionDetails").select(
            "position", F.col("e.name").alias("name"), F.col("e.dbType").alias("db_type"), "e.url"
        ),
        tables=part("tables").select(
            "position",
            F.col("e.tableName").alias("table_name"),
            F.col("e.csvFileName").alias("csv_file_name"),
            "e.schemas",
        ),
        queries=part("queries").select(
            "position", "e.name", "e.category", F.col("e.queriesByDb").alias("queries_by_db")
        ),
    )


def missing_files(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Tables whose CSV file was not given, with the message for each. No rows: the workload is usable.

    ``tables`` has ``table_name`` and ``csv_file_name``, ``files`` has ``csv_file_name``.
    """
    return tables.join(files, "csv_file_name", "left_anti").select(
        "table_name",
        "csv_file_name",
        F.concat(F.col("csv_file_name"), F.lit(NOT_UPLOADED)).alias("error"),
    )


def text_for(texts: Column | str, dialect: str) -> Column:
    """The entry of a dialect-to-text map: that of exactly this key, else of the first key, in code-point order, that
    differs in case alone."""
    alike = F.filter(F.map_entries(texts), lambda e: F.lower(e["key"]) == dialect.lower())
    return F.coalesce(F.try_element_at(texts, F.lit(dialect)), F.try_element_at(F.array_sort(alike), F.lit(1))["value"])


def pick(entries: dict[str, T] | None, dialect: str) -> T | None:
    """The same choice from a dictionary."""
    entries = entries or {}
    if entries.get(dialect) is not None:
        return entries[dialect]
    return next((entries[key] for key in sorted(entries) if key.lower() == dialect.lower()), None)


def resolve_text(queries: DataFrame, dialect: str) -> DataFrame:
    """Pick each query's SQL for one dialect; a query without one gets an error text instead."""
    missing = F.lit(NO_QUERIES + dialect)
    sql = text_for("queries_by_db", dialect)
    return queries.select(
        "position",
        "name",
        "category",
        sql.alias("sql_text"),
        F.when(sql.isNull(), missing).alias("error_message"),
    )
