"""Side-by-side tables of several connections.

The long form has a row per (name, connection) and holds for any number of connections. A wide table is a view of it
with a column per connection, for a list of names that the caller gives; a connection outside the list is an error,
never left out. Rows are reduced to one cell per (name, connection) inside the tasks first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import round2
from paceline.operators.measures import with_imports
from paceline.values import (
    CHARTED,
    GROUPED,
    IMPORT_TOTALS,
    METRIC_COLUMNS,
    NO_CATEGORY,
    NO_MESSAGE,
    PLAIN,
    STATISTICS,
    WHOLE,
)


def union_results(results: list[DataFrame]) -> DataFrame:
    """All rows of several result tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def successful(results: DataFrame, metric: str | None = None) -> DataFrame:
    """Results that succeeded and, if ``metric`` names a column, have that metric."""
    good = results.where(F.col("success"))
    return good if metric is None else good.where(F.col(metric).isNotNull())


def failures(results: DataFrame, custom: bool = False) -> DataFrame:
    """Connections that failed, with the error text.

    In a custom workload a result with an error text is a failure even if it is marked successful, and
    one without a text gets a standard text.
    """
    error = F.nullif(F.col("error"), F.lit(""))
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    if custom:
        failed, error = failed | error.isNotNull(), F.coalesce(error, F.lit(NO_MESSAGE))
    return results.where(failed).select("connection_name", error.alias("error"))


def names_in_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, in the order in which they first occur."""
    return df.groupBy(column).agg(F.min("position").alias("position")).orderBy("position", column)


def connection_list(results: DataFrame) -> list[str]:
    """Names of the connections in report order, to be used as columns of a wide table."""
    return [row["connection_name"] for row in names_in_order(results, "connection_name").toLocalIterator()]


def number_text(c: Column | str, style: str, unit: str = "") -> Column:
    """A number as text in one of the three styles, with its unit."""
    value = F.col(c) if isinstance(c, str) else c
    if style == WHOLE:
        text = F.format_number(value, 0)
    elif style == GROUPED:
        text = F.format_number(round2(value), 2)
    else:
        text = round2(value).cast("decimal(18,2)").cast("string")
    return F.concat(text, F.lit(unit))


def category_of(timings: DataFrame) -> DataFrame:
    """Category of each query: that of its first row, or QUERY if that row has none.

    Rows become one per (query, category) first, so the sort that picking a text needs is a small one.
    """
    seen = timings.groupBy("query_name", "category").agg(F.min("position").alias("position"))
    first = F.min_by("category", "position")
    return seen.groupBy("query_name").agg(_category(first).alias("category"))


def _category(c: Column | str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_CATEGORY))


def _cells(df: DataFrame, name: str, values: dict[str, Column]) -> DataFrame:
    """The first row's values of each (name, connection), with its position."""
    return df.groupBy(name, "connection_name").agg(
        F.min("position").alias("position"),
        *[F.min_by(column, "position").alias(label) for label, column in values.items()],
    )


def _listed(df: DataFrame, connections: list[str]) -> DataFrame:
    """All rows, or an error when the job meets a connection that is not in the list.

    The check is in the column, not in a filter: a filter on a join key would be tried on the other side's rows too.
    """
    name = F.col("connection_name")
    message = F.concat(F.lit("connection without a column, use the long form: "), F.coalesce(name, F.lit("NULL")))
    checked = F.when(name.isin(connections), name).otherwise(F.raise_error(message).cast("string"))
    return df.withColumn("connection_name", checked)


def _refuse_clashes(connections: list[str], taken: list[str]) -> None:
    used = {c.lower() for c in taken}
    wrong = sorted({c for c in connections if c.lower() in used or connections.count(c) > 1})
    if wrong:
        raise ValueError(f"connections that cannot be columns beside {', '.join(taken)}: {', '.join(wrong)}")


def _widen(cells: DataFrame, keys: list[str], connections: list[str], cell: Column, missing, *extra: Column) -> DataFrame:
    """One row per key with a column per connection, and where the key first occurs.

    A key has one cell per listed connection, so the map that is collected for it is never larger than
    the list.
    """
    entry = F.struct("connection_name", cell.alias("cell"))
    wide = cells.groupBy(*keys).agg(
        F.min("position").alias("position"), *extra, F.map_from_entries(F.collect_list(entry)).alias("_cells")
    )
    kept = [c for c in wide.columns if c != "_cells"]
    _refuse_clashes(connections, kept)
    shown = [F.coalesce(F.try_element_at("_cells", F.lit(c)), F.lit(missing)).alias(c) for c in connections]
    return wide.select(*[F.col(f"`{c}`") for c in kept], *shown)


def _outcome(ok: Column, shown: Column) -> Column:
    return F.when(ok, shown).when(~ok, F.lit("Error"))


def _load_cells(loads: DataFrame) -> DataFrame:
    return _cells(
        loads, "table_name", {"ok": F.col("success"), "ms": F.col("load_time_ms"), "n": F.col("rows_loaded")}
    )


def _load_text() -> Column:
    shown = F.concat(number_text("ms", PLAIN, " ms"), F.lit(" ("), number_text("n", WHOLE), F.lit(" rows)"))
    return _outcome(F.col("ok"), shown)


def _spent() -> Column:
    return F.when(F.col("ok"), F.col("ms")).otherwise(0.0)


def loads_long(loads: DataFrame) -> DataFrame:
    """First load of each table on each connection: its time (0 if it failed) and its text (``Error`` if it failed)."""
    return _load_cells(loads).select(
        "table_name", "connection_name", "position", _spent().alias("load_time_ms"), _load_text().alias("shown")
    )


def pivot_loads(loads: DataFrame, connections: list[str]) -> DataFrame:
    """Load time of each table (rows) on each connection (columns); 0 if it failed or is missing.

    ``position`` is where the table first occurs, to sort by.
    """
    cells = _cells(
        _listed(loads, connections), "table_name", {"ok": F.col("success"), "ms": F.col("load_time_ms")}
    )
    return _widen(cells, ["table_name"], connections, _spent(), 0.0)


def load_grid(loads: DataFrame, connections: list[str]) -> DataFrame:
    """Load time and rows of each table on each connection as text; ``Error`` if failed, ``-`` if missing."""
    return _widen(_load_cells(_listed(loads, connections)), ["table_name"], connections, _load_text(), "-")


def _query_cells(timings: DataFrame) -> DataFrame:
    """Rows are kept apart by category in the first step, so that only the few rows left after it are sorted
    to find the first category."""
    seen = timings.groupBy("query_name", "connection_name", "category").agg(
        F.min("position").alias("position"),
        F.min_by("success", "position").alias("success"),
        F.min_by("execution_time_ms", "position").alias("ms"),
    )
    values = {"ok": F.col("success"), "ms": F.col("ms"), "category": F.col("category")}
    return _cells(seen, "query_name", values)


def _query_text() -> Column:
    return _outcome(F.col("ok"), number_text("ms", PLAIN, " ms"))


def queries_long(timings: DataFrame) -> DataFrame:
    """First run of each query on each connection: the query's category, time (0 if it failed) and text."""
    cells = _query_cells(timings).withColumnRenamed("category", "_category")
    return cells.join(category_of(timings), "query_name").select(
        "query_name",
        "connection_name",
        "position",
        "category",
        _spent().alias("execution_time_ms"),
        _query_text().alias("shown"),
    )


def pivot_queries(timings: DataFrame, connections: list[str]) -> DataFrame:
    """Time of each query (rows) on each connection (columns); 0 if it failed or is missing."""
    values = {"ok": F.col("success"), "ms": F.col("execution_time_ms")}
    cells = _cells(_listed(timings, connections), "query_name", values)
    return _widen(cells, ["query_name"], connections, _spent(), 0.0)


def query_grid(timings: DataFrame, connections: list[str]) -> DataFrame:
    """Category of each query and its time on each connection as text; ``Error`` if failed, ``-`` if missing."""
    category = _category(F.min_by("category", "position")).alias("category")
    return _widen(
        _query_cells(_listed(timings, connections)), ["query_name"], connections, _query_text(), "-", category
    )


def _statistic_cells(stats: DataFrame) -> DataFrame:
    return _cells(stats, "table_name", {column: F.col(column) for _, column, _, _ in STATISTICS})


def stats_long(stats: DataFrame) -> DataFrame:
    """Each table's five statistics on each connection as text, a row each; ``-`` where one is not known."""
    lines = [
        F.struct(
            F.lit(line).alias("line"),
            F.lit(label).alias("statistic"),
            F.coalesce(number_text(column, style, unit), F.lit("-")).alias("text"),
        )
        for line, (label, column, unit, style) in enumerate(STATISTICS)
    ]
    return _statistic_cells(stats).select("table_name", "connection_name", "position", F.inline(F.array(*lines)))


def stats_grid(stats: DataFrame, connections: list[str]) -> DataFrame:
    """Each table's five statistics (rows) on each connection (columns) as text; ``-`` if missing.

    The numbers of a table come together as one row; lines and texts are made of it after the last shuffle.
    """
    _refuse_clashes(connections, ["table_name", "position", "line", "statistic"])
    numbers = F.struct(*[column for _, column, _, _ in STATISTICS])
    entry = F.struct("connection_name", numbers.alias("cell"))
    tables = (
        _statistic_cells(_listed(stats, connections))
        .groupBy("table_name")
        .agg(F.min("position").alias("position"), F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    )

    def texts(column: str, unit: str, style: str) -> list[Column]:
        cell = lambda c: F.try_element_at("_cells", F.lit(c))[column]
        return [F.coalesce(number_text(cell(c), style, unit), F.lit("-")).alias(c) for c in connections]

    lines = [
        F.struct(F.lit(line).alias("line"), F.lit(label).alias("statistic"), *texts(column, unit, style))
        for line, (label, column, unit, style) in enumerate(STATISTICS)
    ]
    return tables.select("table_name", "position", F.inline(F.array(*lines)))


def comparison(metrics: DataFrame) -> DataFrame:
    """One row per connection: status and every metric as text, ``-`` where it failed."""
    ok = F.col("success")

    def text(column: str) -> Column:
        written = number_text(column, GROUPED, " rows/s") if column.endswith("_rate") else number_text(column, PLAIN, " ms")
        return F.coalesce(F.when(ok, written), F.lit("-")).alias(column)

    status = F.when(ok, "OK").otherwise("Error").alias("status")
    return metrics.select("connection_name", "db_type", "position", status, *map(text, METRIC_COLUMNS))


def chart_overall(metrics: DataFrame) -> DataFrame:
    """Chart rows of a standard comparison: the seven charted metrics, 0 where one is missing."""
    zero = F.lit(0.0)
    return successful(metrics).select(
        "connection_name", "db_type", "position", *[F.coalesce(F.col(c), zero).alias(c) for c in CHARTED]
    )


def chart_imports(results: DataFrame, imports: DataFrame) -> DataFrame:
    """Chart rows of a custom workload: import rate and total import time, 0 where nothing was imported."""
    return with_imports(successful(results), imports).select(
        "connection_name", "db_type", "position", "csv_import_rate", "total_import_time_ms"
    )


def imports_long(results: DataFrame, imports: DataFrame) -> DataFrame:
    """The four import totals of each successful connection as text, a row each."""
    lines = [
        F.struct(
            F.lit(line).alias("position"), F.lit(label).alias("metric"), number_text(column, style, unit).alias("text")
        )
        for line, (label, column, unit, style) in enumerate(IMPORT_TOTALS)
    ]
    chosen = successful(results).select("connection_name").distinct()
    return with_imports(chosen, imports).select("connection_name", F.inline(F.array(*lines)))


def import_grid(results: DataFrame, imports: DataFrame, connections: list[str]) -> DataFrame:
    """The four import totals (rows) of each connection (columns) as text; ``-`` where it failed."""
    long = imports_long(_listed(results, connections), imports)
    return _widen(long, ["metric"], connections, F.col("text"), "-")
