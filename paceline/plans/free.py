"""Queries that reach beyond the fixed shapes: what users of free SQL do to loads and runs, as operators.

Joins along time, trailing means, multiset comparison, exact quantiles, sketches, totals on many levels, and how files lie.
Each comes with the SQL that must give the same rows. Events are the runs; those of type ``signup`` are loads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import round2
from paceline.operators import constraints, multisets, quantiles, queries, storage, temporal, totals
from paceline.plans import bindings as b
from paceline.plans.catalog import STAT_TABLES, Query, write_csv
from paceline.plans.runner import compare_texts
from paceline.session import scratch_path
from paceline.sources import file_ranges, files_holding, layout_report, read_csv, stage, write_sorted

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MINUTE = 60_000_000
TOLERANCE_DAYS = 30
RUNS_BEFORE = 20
SHARES = {"median_ms": 0.5, "p95_ms": 0.95}


def query(sql: str):
    """Register a query under its function name, with the SQL of its rows."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__], SQL[run.__name__] = run, sql
        return run

    return register


def _events(spark, sf_dir, loads: bool) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    return events.where(F.col("event_type") == "signup") if loads else events.where(F.col("event_type") != "signup")


# --- along time ----------------------------------------------------------------------------------


def _asof_sql(compare: str) -> str:
    return f"""SELECT r.event_id, r.user_id, l.event_id AS load_id, l.value AS load_ms
    FROM (SELECT * FROM events WHERE event_type <> 'signup') r
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') l ON r.user_id = l.user_id AND r.ts {compare} l.ts"""


def _asof(spark, sf_dir, forward: bool = False) -> DataFrame:
    runs = _events(spark, sf_dir, False).select("event_id", "user_id", "ts")
    loads = _events(spark, sf_dir, True).select("user_id", F.col("ts").alias("loaded"), "event_id", "value")
    carry = {"event_id": "load_id", "value": "load_ms"}
    return temporal.asof_join(runs, loads, ["user_id"], "ts", "loaded", carry, forward=forward, buckets=16).drop("ts")


@query(_asof_sql(">="))
def w01_last_load(spark, sf_dir):
    """The last load of a user before each of its runs."""
    return _asof(spark, sf_dir)


@query(_asof_sql("<="))
def w01_next_load(spark, sf_dir):
    """The first load of a user after each of its runs."""
    return _asof(spark, sf_dir, forward=True)


@query(
    f"""SELECT l_orderkey, l_linenumber,
      CASE WHEN l_shipdate - o_orderdate <= INTERVAL {TOLERANCE_DAYS} DAY THEN last_order END AS last_order,
      CASE WHEN l_shipdate - o_orderdate <= INTERVAL {TOLERANCE_DAYS} DAY THEN o_orderdate END AS ordered_on
    FROM lineitem ASOF LEFT JOIN (
      SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey, o_orderdate) o
    ON l_suppkey = o_custkey AND l_shipdate > o_orderdate"""
)
def w01_last_order_in_time(spark, sf_dir):
    """The last order, on an earlier day and at most 30 days before, of the customer with a line's supplier number."""
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    orders = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l_suppkey"), "o_orderdate", "o_orderkey")
    carry = {"o_orderkey": "last_order", "o_orderdate": "ordered_on"}
    found = temporal.asof_join(
        lines, orders, ["l_suppkey"], "l_shipdate", "o_orderdate", carry, "o_orderkey", True, tolerance=TOLERANCE_DAYS * 86400, buckets=16
    )
    return found.drop("l_suppkey", "l_shipdate")


def _spans(spark, sf_dir, kind: str, name: str) -> DataFrame:
    """Events of a kind as spans of as many minutes as their value."""
    length = F.round(F.col("value") * MINUTE).cast("bigint")
    events = b.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    end = F.timestamp_add("MICROSECOND", length, "ts")
    return events.select(F.col("event_id").alias(f"{name}_id"), "user_id", F.col("ts").alias(f"{name}_start"), end.alias(f"{name}_end"))


def _overlap_sql(on: str) -> str:
    def spans(kind: str, name: str) -> str:
        return f"""{name}s AS (SELECT event_id AS {name}_id, user_id, ts AS {name}_start,
      ts + to_microseconds(CAST(round(value * {MINUTE}) AS BIGINT)) AS {name}_end FROM events WHERE event_type = '{kind}')"""

    return f"""WITH {spans('view', 'run')}, {spans('signup', 'load')}
    SELECT run_id, load_id, epoch_us(least(run_end, load_end)) - epoch_us(greatest(run_start, load_start)) AS shared_us
    FROM runs JOIN loads ON {on} run_start <= load_end AND load_start <= run_end"""


def _overlaps(spark, sf_dir, on: list[str]) -> DataFrame:
    runs, loads = _spans(spark, sf_dir, "view", "run"), _spans(spark, sf_dir, "signup", "load")
    if not on:
        runs, loads = runs.drop("user_id"), loads.drop("user_id")

    # Microseconds are taken once a span, as there are far more pairs.
    def micros(spans, *columns):
        return spans.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in columns})

    runs, loads = micros(runs, "run_start", "run_end"), micros(loads, "load_start", "load_end")
    pairs = temporal.overlap_join(runs, loads, on, ("run_start", "run_end"), ("load_start", "load_end"))
    shared = F.least("run_end", "load_end") - F.greatest("run_start", "load_start")
    return pairs.select("run_id", "load_id", shared.alias("shared_us"))


@query(_overlap_sql(""))
def w02_runs_during_loads(spark, sf_dir):
    """Runs that were going on while something was loaded, and for how long."""
    return _overlaps(spark, sf_dir, [])


@query(_overlap_sql("runs.user_id = loads.user_id AND"))
def w02_runs_during_own_loads(spark, sf_dir):
    """Runs of a user during loads of its own."""
    return _overlaps(spark, sf_dir, ["user_id"])


@query(
    f"""SELECT event_id, count(*) OVER w AS runs_before,
      floor((value - CAST(sum(CAST(value AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(*) OVER w) * 100 + 0.5) / 100 AS change_ms
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {RUNS_BEFORE} PRECEDING AND 1 PRECEDING)"""
)
def w08_change_of_runs(spark, sf_dir):
    """Each run's time against the mean of the last 20 of its connection."""
    events = b.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    over = {"runs_before": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,6)"))}
    framed = temporal.trailing(events, ["event_type"], ["ts", "event_id"], RUNS_BEFORE, over, block=1000, buckets=16)
    mean = F.col("total").cast("double") / F.nullif("runs_before", F.lit(0))
    return framed.select("event_id", "runs_before", round2(F.col("value") - mean).alias("change_ms"))


# --- rows as sets --------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def i01_pk_violations_by_hash(spark, sf_dir):
    return constraints.pk_violations(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], by_hash=True)


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 OR text IS NULL")
def i01_wide_key_by_hash(spark, sf_dir):
    """Texts that several documents share: whole texts are the key."""
    return constraints.pk_violations(b.table(spark, sf_dir, "documents"), ["text"], by_hash=True)


COMPARED = {"1-URGENT": "", "2-HIGH": "", "3-MEDIUM": "DISTINCT ", "4-NOT SPECIFIED": "", "5-LOW": "DISTINCT "}


@query(
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{p}' AS query_name, count(*) AS rows_left,
          {"count(DISTINCT (o_custkey, o_orderstatus))" if distinct else "count(*)"} AS rows_right,
          {"count(*) = count(DISTINCT (o_custkey, o_orderstatus))" if distinct else "true"} AS equal, CAST(NULL AS VARCHAR) AS error_message
        FROM orders WHERE o_orderpriority = '{p}'"""
        for i, (p, distinct) in enumerate(COMPARED.items())
    )
)
def w04_compare_texts(spark, sf_dir):
    """Whether the texts of two dialects give the same rows: two of the second dialect's drop repeated rows."""
    path = f"{sf_dir}/orders.parquet"
    rows = [
        (
            i,
            p,
            "SELECT",
            {
                "plain": f"SELECT o_custkey, o_orderstatus FROM parquet.`{path}` WHERE o_orderpriority = '{p}'",
                "other": f"SELECT {distinct}o_custkey AS c, o_orderstatus AS s FROM parquet.`{path}` WHERE o_orderpriority LIKE '{p[0]}%'",
            },
        )
        for i, (p, distinct) in enumerate(COMPARED.items())
    ]
    texts = spark.createDataFrame(rows, "position int, name string, category string, queries_by_db map<string,string>")
    found = compare_texts(spark, texts, "plain", "other")
    return found.select("position", "query_name", "rows_left", "rows_right", "equal", "error_message")


@query(
    """WITH a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    z AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 OR l_suppkey % 2 = 0 GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, coalesce(a.n, 0) AS n_left, coalesce(z.n, 0) AS n_right
    FROM a FULL JOIN z USING (l_suppkey, l_returnflag) WHERE coalesce(a.n, 0) <> coalesce(z.n, 0)"""
)
def w04_row_differences(spark, sf_dir):
    """Where two results differ: one lacks the third lines of every other supplier."""
    lines = b.table(spark, sf_dir, "lineitem")
    fewer = lines.where((F.col("l_linenumber") != 3) | (F.col("l_suppkey") % 2 == 0))
    names = ["l_suppkey", "l_returnflag"]
    return multisets.row_differences(lines.select(*names), fewer.select(*names))


# --- measurements --------------------------------------------------------------------------------


def _within(estimate, exact, error: float):
    """Whether an estimate is within four standard errors, or one whole thing, of the truth."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), 4 * error * exact)


@query(
    """SELECT event_type AS connection_name, count(*) AS n, true AS distinct_ok, true AS median_ok, true AS p95_ok
    FROM events GROUP BY event_type"""
)
def w05_merged_sketches(spark, sf_dir):
    """Sketches per connection and day, stored and merged: whether users and quantiles of run times are within their bounds."""
    runs = b.table(spark, sf_dir, "events")
    daily = totals.sketch_runs(runs.withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], "user_id", "value")
    merged = totals.merge_sketches(stage(daily, "sketches"), ["event_type"])
    told = totals.sketch_report(merged, ["event_type"], SHARES).withColumnRenamed("n", "n_runs")
    exact = runs.join(told, "event_type").groupBy("event_type", "n_runs", "n_distinct").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        *[x for name in SHARES for x in (F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_to"))],
    )

    def ranked(name: str):
        """The wanted rank lies among the ranks of the value told, or off by the sketch's bound at most."""
        slack = F.lit(1) + F.col("n") * totals.KLL_ERROR
        wanted = F.col("n") * SHARES[name]
        return (wanted >= F.col(f"{name}_below") - slack) & (wanted <= F.col(f"{name}_to") + slack) & (F.col("n") == F.col("n_runs"))

    return exact.select(
        F.col("event_type").alias("connection_name"),
        "n",
        _within(F.col("n_distinct"), F.col("users"), totals.HLL_ERROR).alias("distinct_ok"),
        ranked("median_ms").alias("median_ok"),
        ranked("p95_ms").alias("p95_ok"),
    )


def _quantiles_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(value) AS n, quantile_disc(value, 0.5) AS median_ms, quantile_disc(value, 0.95) AS p95_ms
    FROM events GROUP BY ALL"""


@query(_quantiles_sql("event_type"))
def w06_quantiles_by_connection(spark, sf_dir):
    return quantiles.exact_quantiles(b.table(spark, sf_dir, "events"), ["event_type"], "value", SHARES)


@query(_quantiles_sql("event_type, user_id"))
def w06_quantiles_by_query(spark, sf_dir):
    return quantiles.exact_quantiles(b.table(spark, sf_dir, "events"), ["event_type", "user_id"], "value", SHARES)


def _totals_sql(levels: str) -> str:
    ms = "CAST(coalesce(sum(CAST(load_time_ms AS DECIMAL(18,6))), 0) AS DOUBLE)"
    return f"""WITH {b.LOADS_SQL},
    dated AS (SELECT loads.*, year(o_orderdate) AS year FROM loads JOIN orders ON position = o_orderkey)
    SELECT connection_name, year, success, CAST(grouping(connection_name, year, success) AS BIGINT) AS level,
      count(*) AS tables_imported, CAST(sum(rows_loaded) AS BIGINT) AS total_rows_loaded,
      floor({ms} * 100 + 0.5) / 100 AS total_import_time_ms,
      floor({ms} / count(*) * 100 + 0.5) / 100 AS average_table_import_time_ms,
      CASE WHEN {ms} > 0 THEN floor(CAST(sum(rows_loaded) AS BIGINT) / ({ms} / 1000) * 100 + 0.5) / 100 ELSE 0 END AS csv_import_rate
    FROM dated GROUP BY {levels}"""


def _dated_loads(spark, sf_dir) -> DataFrame:
    days = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.year("o_orderdate").cast("bigint").alias("year"))
    return b.loads(spark, sf_dir).join(days, "position")


LEVEL_KEYS = ["connection_name", "year", "success"]


@query(_totals_sql("CUBE (connection_name, year, success)"))
def w07_import_cube(spark, sf_dir):
    return totals.import_totals(_dated_loads(spark, sf_dir), LEVEL_KEYS)


@query(_totals_sql("ROLLUP (connection_name, year, success)"))
def w07_import_rollup(spark, sf_dir):
    return totals.import_totals(_dated_loads(spark, sf_dir), LEVEL_KEYS, "rollup")


@query(_totals_sql("GROUPING SETS ((year), (connection_name, success), ())"))
def w07_import_levels(spark, sf_dir):
    return totals.import_totals(_dated_loads(spark, sf_dir), LEVEL_KEYS, [["year"], ["success", "connection_name"], []])


# --- files ---------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, true AS several_files, true AS all_ordered, true AS one_file_deep, true AS filter_reads_one FROM orders")
def i07_layout(spark, sf_dir):
    """How well the sorted layout lies: every file in order, and no order key in two files."""
    path = scratch_path(spark, "sorted")
    write_sorted(b.orders(spark, sf_dir), path, ["id"], files=8)
    report = layout_report(spark, path, ["id"])
    holding = files_holding(stage(file_ranges(spark, path, ["id"]), "ranges"), F.lit(1)).count()
    return report.select(
        "rows",
        (F.col("files") > 1).alias("several_files"),
        (F.col("ordered_files") == F.col("files")).alias("all_ordered"),
        (F.col("depth") == 1).alias("one_file_deep"),
        F.lit(holding == 1).alias("filter_reads_one"),
    )


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def s05_csv_quoted_split(spark, sf_dir):
    """One file whose texts hold line breaks, read by several tasks."""
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "documents")
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema, multiline=True, split=True)


@query("SELECT count(*) AS row_count FROM lineitem")
def q04_count_from_footers(spark, sf_dir):
    return queries.q_count(storage.footers(spark, f"{sf_dir}/lineitem.parquet"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAT_TABLES))
def t01_table_rows_from_footers(spark, sf_dir):
    tables = {name: f"{sf_dir}/{name}.parquet" for name in STAT_TABLES}
    return storage.table_stats(spark, tables, from_footers=True).select("table_name", "row_count")
