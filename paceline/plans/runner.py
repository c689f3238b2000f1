"""Run and time queries, the standard workload, and workloads described by a file.

A connection is a place to keep tables: a Spark file format (parquet, orc, csv, json) with a database of
its own in the session catalog. Connections run one after another, so that each is timed alone, and the
failure of one becomes a result row. What passes through the driver is the workload description and one
row per measurement, never table rows.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from paceline.errors import error_text
from paceline.functions import round2
from paceline.operators.measures import import_metrics
from paceline.operators.multisets import same_rows
from paceline.operators.queries import q_aggregate, q_join, q_read
from paceline.operators.storage import table_stats
from paceline.schemas import COMPARED_TEXTS, LOAD, METRIC, ORDERS, QUERY_TIMING, RESULT, TABLE_STATS, USERS
from paceline.session import release, report_rows, scratch_path
from paceline.sources.config import Config, missing_files, pick, resolve_text
from paceline.sources.csv import csv_dialect_of, read_csv
from paceline.sources.generate import gen_orders, gen_users
from paceline.sources.tables import apply_ddl, drop_table, load_to_threshold, trial_load
from paceline.values import (
    JOIN_BOUND,
    LOAD_TRIALS,
    METRIC_COLUMNS,
    NO_QUERIES,
    ORDERS_TABLE,
    READ_RUNS,
    TEXT_LIMITS,
    THRESHOLD_RUNS,
    TOTAL_BOUND,
    UNSUPPORTED,
    USERS_TABLE,
)

SPARK_FORMATS = ("parquet", "orc", "csv", "json")
# Names of missing files that one error message spells out.
NAMED = 20


class QuerySet(NamedTuple):
    """What a standard run executes on one type of connection; ``?`` stands for the bound."""

    schema: list[str]
    read: str
    join: str
    aggregate: str


def standard_schema(fmt: str, amount_type: str | None = None) -> list[str]:
    """Statements that make the standard tables anew in a file format, from the schemas of their rows."""

    def columns(schema: StructType) -> str:
        kinds = {c.name: c.dataType.simpleString() for c in schema}
        kinds |= {c: f"varchar({n})" for c, n in TEXT_LIMITS.items() if c in kinds}
        if amount_type and "amount" in kinds:
            kinds["amount"] = amount_type
        stamped = {c.name for c in schema if isinstance(c.dataType, TimestampType)}
        return ", ".join(f"{c} {k}" + (" DEFAULT current_timestamp()" if c in stamped else "") for c, k in kinds.items())

    made = {USERS_TABLE: USERS, ORDERS_TABLE: ORDERS}
    drops = [f"DROP TABLE IF EXISTS {name}" for name in made]
    return drops + [f"CREATE TABLE {name} ({columns(schema)}) USING {fmt}" for name, schema in made.items()]


def read_query_sets(spark: SparkSession, path: str, dialects: list[str] | None = None) -> dict[str, QuerySet]:
    """Read query sets by dialect from a JSON file ``{dialect: {schema: [..], read, join, aggregate}}``.

    Keys stay as they are written. With ``dialects``, only the sets that one of them may pick are kept.
    """
    one = "struct<schema:array<string>,read:string,join:string,aggregate:string>"
    docs = spark.read.text(path, wholetext=True)
    sets = docs.select(F.explode(F.from_json("value", f"map<string,{one}>", {"mode": "FAILFAST"})))
    if dialects is not None:
        sets = sets.where(F.lower("key").isin([d.lower() for d in dialects]))
    return {row["key"]: QuerySet(**row["value"].asDict()) for row in sets.toLocalIterator()}


def _elapsed_ms(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return (time.perf_counter() - start) * 1000


def drain(df: DataFrame) -> None:
    """Compute every row and column and throw them away."""
    df.write.format("noop").mode("overwrite").save()


def time_df(df: DataFrame, runs: int) -> float:
    """Mean milliseconds of draining a DataFrame ``runs`` times. Cached data stays cached."""
    return _elapsed_ms(lambda: [drain(df) for _ in range(runs)]) / runs


def run_queries(
    spark: SparkSession,
    queries: DataFrame,
    dialect: str = "spark",
    runs: int = READ_RUNS,
    connection: str = "spark",
    args: dict | None = None,
) -> DataFrame:
    """Run each query's text for a dialect ``runs`` times and report QUERY_TIMING rows.

    ``queries`` are those of a workload file. A query that fails, or has no text for the dialect, gives an
    error row with 0 ms and the next one runs. ``args`` are named parameters for the texts. The texts go
    to ``spark.sql`` unchanged and reach the driver a partition at a time, in order.
    """
    rows = []
    for place, query in enumerate(resolve_text(queries, dialect).orderBy("position", "name").toLocalIterator()):
        ms, error = 0.0, query["error_message"]
        if error is None:
            try:
                ms = time_df(spark.sql(query["sql_text"], args=args), runs)
            except Exception as failure:  # a failed query is a result row
                error = error_text(failure)
        rows.append((connection, place, query["name"], query["category"], round(ms, 2), error is None, error))
    return report_rows(spark, rows, QUERY_TIMING)


def compare_texts(spark: SparkSession, queries: DataFrame, first: str, second: str, args: dict | None = None) -> DataFrame:
    """Whether two dialects' texts of each query give the same rows, each as often: COMPARED_TEXTS rows.

    Results are compared by position of their columns, whatever the order of rows. A query without one of the texts, with one that
    fails, or with texts of other column types has an error text, and NULL for the rest.
    """
    both = resolve_text(queries, first).withColumnRenamed("sql_text", "left_text").withColumnRenamed("error_message", "left_error")
    other = resolve_text(queries, second).select("position", "name", F.col("sql_text").alias("right_text"), F.col("error_message").alias("right_error"))
    texts = both.join(other, ["position", "name"]).orderBy("position", "name")
    rows = []
    for query in texts.toLocalIterator():
        told, error = (None, None, None), query["left_error"] or query["right_error"]
        if error is None:
            try:
                left, right = (spark.sql(query[f"{side}_text"], args=args) for side in ("left", "right"))
                told = tuple(same_rows(left, right).first())
            except Exception as failure:  # a failed query is a result row
                error = error_text(failure)
        rows.append((query["position"], query["name"], *told, error))
    return report_rows(spark, rows, COMPARED_TEXTS)


class _Place(NamedTuple):
    """A connection's own session and database."""

    session: SparkSession
    database: str
    folder: str


def _open(spark: SparkSession, db_type: str) -> _Place:
    """A new session with a database of its own, whose tables lie in the shared scratch folder."""
    if db_type.lower() not in SPARK_FORMATS:
        raise ValueError(UNSUPPORTED + db_type)
    session = spark.newSession()
    database = f"paceline_{uuid.uuid4().hex}"
    place = _Place(session, database, scratch_path(spark, database))
    session.sql(f"CREATE DATABASE {database} LOCATION '{place.folder}'")
    try:
        session.catalog.setCurrentDatabase(database)
    except Exception:
        _close(place)
        raise
    return place


def _close(place: _Place) -> None:
    place.session.sql(f"DROP DATABASE {place.database} CASCADE")
    release(place.session, [place.folder.rpartition("/")[0]])


def _closing_error(place: _Place | None) -> str | None:
    """Close a connection's place; the error text if that fails, as the other connections are to run all the same."""
    if place is None:
        return None
    try:
        _close(place)
    except Exception as failure:  # a connection that cannot be closed is told in its result row
        return error_text(failure)
    return None


def _labels(names: list[str]) -> list[str]:
    """Names of connections for the reports; a repeated one gets a number, so that its rows stay its own."""
    used, out = set(names), []
    for i, name in enumerate(names):
        label, number = name, 1
        while label in out or (number > 1 and label in used):
            number += 1
            label = f"{name} ({number})"
        out.append(label if name in names[:i] else name)
    return out


def _stats(spark: SparkSession, tables: list[str], connection: str) -> list[tuple]:
    """TABLE_STATS rows of a connection's tables."""
    stats = table_stats(spark, {t: t for t in tables}).withColumn("connection_name", F.lit(connection))
    return [tuple(row) for row in stats.select(*TABLE_STATS.names).collect()]


class StandardRun(NamedTuple):
    """Reports of a standard run: METRIC and TABLE_STATS rows."""

    metrics: DataFrame
    stats: DataFrame


class _Work(NamedTuple):
    """The steps of a standard run on one connection: statements, and the three queries on a session."""

    schema: list[str]
    read: Callable[[SparkSession], DataFrame]
    join: Callable[[SparkSession], DataFrame]
    aggregate: Callable[[SparkSession], DataFrame]


def _work(db_type: str, query_sets: dict[str, QuerySet] | None, amount_type: str | None) -> _Work:
    dialect = db_type.lower()
    if query_sets is None and dialect in SPARK_FORMATS:
        both = lambda s: (s.table(USERS_TABLE), s.table(ORDERS_TABLE))
        return _Work(
            standard_schema(dialect, amount_type),
            lambda s: q_read(s.table(USERS_TABLE)),
            lambda s: q_join(*both(s), JOIN_BOUND),
            lambda s: q_aggregate(*both(s), TOTAL_BOUND),
        )
    found = pick(query_sets, db_type)
    if found is None:
        raise ValueError(NO_QUERIES + db_type)
    return _Work(
        found.schema,
        lambda s: s.sql(found.read),
        lambda s: s.sql(found.join, args=[JOIN_BOUND]),
        lambda s: s.sql(found.aggregate, args=[TOTAL_BOUND]),
    )


# Makes the users and the orders of a standard run, with the session that they are to be read by.
Source = Callable[[SparkSession], tuple[DataFrame, DataFrame]]


def generated(rows: int, day: dt.date, amount_type: str | None = None) -> Source:
    """As many users and as many orders, made up by rule."""
    typed = {"amount_type": amount_type} if amount_type else {}
    return lambda spark: (gen_users(spark, rows), gen_orders(spark, rows, day, **typed))


def _insert(spark: SparkSession, source: Source) -> None:
    """Fill the standard tables, one job each. Columns are named, so others get their defaults."""
    for table, df in zip((USERS_TABLE, ORDERS_TABLE), source(spark), strict=True):
        names = ", ".join(df.columns)
        spark.sql(f"INSERT INTO {table} ({names}) SELECT {names} FROM {{rows}}", rows=df)


def _measure(place: _Place, work: _Work, source: Source, inserted: int, runs: int) -> dict[str, float]:
    """Metrics of one connection, in the order in which they are taken."""
    session = place.session
    values = {
        "schema_creation_time_ms": _elapsed_ms(lambda: apply_ddl(session, work.schema)),
        "batch_insertion_time_ms": _elapsed_ms(lambda: _insert(session, source)),
        "read_time_ms": time_df(work.read(session), runs),
        "join_time_ms": time_df(work.join(session), 1),
        "aggregate_time_ms": time_df(work.aggregate(session), 1),
    }
    ms = values["batch_insertion_time_ms"]
    return values | {"batch_insertion_rate": inserted / (ms / 1000) if ms > 0 else 0.0}


def standard_run(
    spark: SparkSession,
    connections: list[tuple[str, str]],
    rows: int = 1000,
    order_date: dt.date | None = None,
    runs: int = READ_RUNS,
    query_sets: dict[str, QuerySet] | None = None,
    amount_type: str | None = None,
    source: Source | None = None,
) -> StandardRun:
    """Create, fill, read, join, aggregate and measure the standard tables on each (name, type) connection.

    ``rows`` users and as many orders are made up, unless ``source`` makes both frames from a session: with the columns of the standard
    tables, but those that have defaults.

    ``query_sets`` replaces the standard tables and queries by those of a file. Rows are inserted by Spark jobs only;
    the single-insert metrics, which time one-row statements, and the connection time are NULL. Give a wider
    ``amount_type`` than decimal(10,2) for 10^8 rows and more.
    """
    inserted = 2 * rows if source is None else sum(df.count() for df in source(spark))
    source = source or generated(rows, order_date or dt.date.today(), amount_type)
    metrics, stats = [], []
    labels = _labels([name for name, _ in connections])
    for position, (name, (_, db_type)) in enumerate(zip(labels, connections, strict=True)):
        place, values, error, measured = None, {}, None, []
        try:
            work = _work(db_type, query_sets, amount_type)
            place = _open(spark, db_type)
            values = _measure(place, work, source, inserted, runs)
            measured = _stats(place.session, [USERS_TABLE, ORDERS_TABLE], name)
        except Exception as failure:  # a failed connection is a result row
            error, values = error_text(failure), {}
        closing = _closing_error(place)
        stats += measured
        text = "; ".join(e for e in (error, closing) if e) or None
        metrics.append((name, db_type, position, error is None, *[values.get(c) for c in METRIC_COLUMNS], text))
    raw = report_rows(spark, metrics, METRIC)
    rounded = raw.select(*[round2(c).alias(c) if c in METRIC_COLUMNS else F.col(c) for c in METRIC.names])
    return StandardRun(rounded, report_rows(spark, stats, TABLE_STATS))


class CustomRun(NamedTuple):
    """Reports of a custom run: RESULT, LOAD, QUERY_TIMING and TABLE_STATS rows and the import totals."""

    results: DataFrame
    loads: DataFrame
    timings: DataFrame
    stats: DataFrame
    imports: DataFrame


def _join_by_measure(session: SparkSession) -> None:
    """Let a session broadcast a table by the bytes that a shuffle of it has, not by the bytes of its files.

    Copies of a row compress to next to nothing, so files far below the limit can hold millions of rows, and each partner of
    these is then looked up among all the copies of its key.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    session.conf.set(measured, session.conf.get(measured, None) or session.conf.get(limit))
    session.conf.set(limit, "-1")


def _check_files(spark: SparkSession, tables: DataFrame, files: dict[str, str]) -> None:
    given = report_rows(spark, [(name,) for name in files], "csv_file_name string")
    missing = missing_files(tables, given)
    named = missing.orderBy("table_name").limit(NAMED).collect()
    if named:
        more = missing.count() - len(named)
        raise ValueError("; ".join(row["error"] for row in named) + (f"; and {more} more" if more else ""))


def _load(
    place: _Place, label: str, connection, table, path: str, dialect: str, threshold: int, trials: int, multiline: bool, counted: dict
):
    """Create one table and load it; its LOAD row. ``counted`` remembers rows of files for the connections that read them alike."""
    session, name = place.session, table["table_name"]
    ddl = pick(table["schemas"], connection["db_type"])
    if not ddl:
        raise ValueError(f"No schema for table {name} and database type: {connection['db_type']}")

    def create() -> None:
        drop_table(session, name)
        apply_ddl(session, [ddl])

    def read() -> DataFrame:
        return read_csv(session, path, session.table(name).schema, dialect, multiline)

    def count() -> int:
        key = (path, dialect, session.table(name).schema.json())
        if key not in counted:
            counted[key] = read().count()
        return counted[key]

    labels = dict(csv_file=table["csv_file_name"], connection=label, position=table["position"])
    create()
    if threshold == 0:
        load = trial_load(session, read, name, name, trials=trials, prepare=create, **labels)
    else:
        load = load_to_threshold(session, read, name, name, threshold, count=count, **labels)
    return tuple(load.first())


def custom_run(
    spark: SparkSession,
    config: Config,
    files: dict[str, str],
    threshold: int = 0,
    trials: int = LOAD_TRIALS,
    runs: int | None = None,
    multiline: bool = False,
) -> CustomRun:
    """Run a workload file: create its tables, load their CSV files, run its queries, measure, drop.

    ``files`` maps the CSV file names of the workload to paths; a missing one stops the run before it
    starts. Tables and queries pick their text by the connection's type, in any case. A connection whose name occurs
    before gets a number in the reports. Without tables the queries run and all import totals are 0. With ``threshold`` 0 every table
    is loaded ``trials`` times and the mean time reported; otherwise it is loaded once with as many copies
    as reach the threshold. ``runs`` defaults to 50 runs per query, or 5 with a threshold.
    """
    _check_files(spark, config.tables, files)
    runs = runs or (READ_RUNS if threshold == 0 else THRESHOLD_RUNS)
    tables = config.tables.orderBy("position").collect()
    no_queries = config.queries.isEmpty()
    results, loads, timings, stats, counted = [], [], [], [], {}
    connections = config.connections.orderBy("position").collect()
    for name, connection in zip(_labels([c["name"] for c in connections]), connections, strict=True):
        db_type, place, error = connection["db_type"], None, None
        try:
            if no_queries:
                raise ValueError(NO_QUERIES + db_type)
            dialect = csv_dialect_of(db_type)
            place = _open(spark, db_type)
            loaded = [
                _load(place, name, connection, t, files[t["csv_file_name"]], dialect, threshold, trials, multiline, counted)
                for t in tables
            ]
            if any(0 < rows < threshold for rows in counted.values()):
                _join_by_measure(place.session)
            timed = run_queries(place.session, config.queries, db_type, runs, name).collect()
            measured = _stats(place.session, [t["table_name"] for t in tables], name)
            loads, timings, stats = loads + loaded, timings + [tuple(t) for t in timed], stats + measured
        except Exception as failure:  # a failed connection is a result row
            error = error_text(failure)
        closing = _closing_error(place)
        text = "; ".join(e for e in (error, closing) if e) or None
        results.append((name, db_type, connection["position"], error is None, text))
    load_rows, result_rows = report_rows(spark, loads, LOAD), report_rows(spark, results, RESULT)
    return CustomRun(
        results=result_rows,
        loads=load_rows,
        timings=report_rows(spark, timings, QUERY_TIMING),
        stats=report_rows(spark, stats, TABLE_STATS),
        imports=import_metrics(load_rows, result_rows.where("success")),
    )
