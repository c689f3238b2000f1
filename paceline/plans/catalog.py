"""Every operator as a query over the given tables, with the SQL that must give the same rows.

Names start with the part of the inventory they cover: s sources, i integrity, q query shapes,
t storage, m measurements, r whole runs. Wall-clock times are left out of a query where they are all that differs
between two runs, so that its other columns can be compared.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import bytes_per_row, db_name, latency, rate, round2, size_mb
from paceline.operators import compare, constraints, measures, queries, storage
from paceline.plans import bindings as b
from paceline.plans.reports import custom_report
from paceline.plans.runner import CustomRun, custom_run, run_queries, time_df
from paceline.schemas import ORDERS, USERS
from paceline.session import report_rows, scratch_path
from paceline.sources import (
    append,
    apply_ddl,
    drop_table,
    gen_orders,
    gen_users,
    load_table,
    load_to_threshold,
    missing_files,
    read_config,
    read_csv,
    resolve_text,
    scale_to_threshold,
    trial_load,
    trial_summary,
    write_sorted,
)
from paceline.values import CHARTED, CUSTOM_LEADERS, METRIC_COLUMNS, NO_MESSAGE, STANDARD_LEADERS, STATISTICS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

JOIN_BOUND = 300_000
TOTAL_BOUND = 1_000_000
BLOCK_SIZE = 262_144
# How often the queries of repeated loads and runs repeat them; the operators' default is 50.
TRIALS = 3
RUNS = 2


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if rows can be compared."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def write_csv(df: DataFrame, path: str) -> None:
    """Write quoted CSV with a header: the input of the CSV queries."""
    df.write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


# --- sources -------------------------------------------------------------------------------------


@query(
    """SELECT i + 1 AS id, 'BenchUser_' || i || '1' AS name, 'user_' || (i + 1) || '@benchmark.com' AS email
    FROM range((SELECT count(*) FROM customer)) t(i)"""
)
def s01_gen_users(spark, sf_dir):
    return gen_users(spark, b.table(spark, sf_dir, "customer").count())


@query(
    f"""SELECT i + 1 AS id, i + 1 AS user_id, CAST(i + 10 AS DECIMAL(10,2)) AS amount, DATE '{b.DAY}' AS order_date
    FROM range((SELECT count(*) FROM orders)) t(i)"""
)
def s02_gen_orders(spark, sf_dir):
    return gen_orders(spark, b.table(spark, sf_dir, "orders").count(), dt.date.fromisoformat(b.DAY))


def _config(spark, sf_dir, mixed_case: bool = False):
    path = scratch_path(spark, "config")
    b.config_docs(spark, sf_dir, mixed_case).write.json(path)
    return read_config(spark, path, multiline=False)


@query(
    """SELECT p.position, p.prefix || c_custkey AS name, lower(c_mktsegment) AS db_type,
      'jdbc://host/db_' || c_custkey || '?ssl=true' AS url
    FROM customer, (VALUES (0, 'main_'), (1, 'spare_')) p(position, prefix)"""
)
def s03_config_connections(spark, sf_dir):
    return _config(spark, sf_dir).connections


@query(
    """SELECT 0 AS position, 'table_' || c_custkey AS table_name, 'file_' || c_custkey || '.csv' AS csv_file_name,
      lower(c_mktsegment) AS dialect, 'CREATE TABLE table_' || c_custkey || ' (id INT)' AS ddl
    FROM customer"""
)
def s03_config_tables(spark, sf_dir):
    tables = _config(spark, sf_dir).tables
    return tables.select("position", "table_name", "csv_file_name", F.explode("schemas").alias("dialect", "ddl"))


@query(
    """SELECT p.position, p.prefix || c_custkey AS name, p.category, d.dialect, p.text || c_custkey AS sql_text
    FROM customer,
      (VALUES (0, 'read_', 'SELECT', 'SELECT * FROM orders WHERE o_custkey = '),
        (1, 'count_', '', 'SELECT count(*) FROM orders WHERE o_custkey = ')) p(position, prefix, category, text),
      LATERAL (SELECT unnest([lower(c_mktsegment), 'spark']) AS dialect) d"""
)
def s03_config_queries(spark, sf_dir):
    rows = _config(spark, sf_dir).queries
    return rows.select("position", "name", "category", F.explode("queries_by_db").alias("dialect", "sql_text"))


@query(
    """SELECT 'doc_' || doc_id AS table_name, doc_id || '.csv' AS csv_file_name,
      doc_id || '.csv not uploaded' AS error
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def s04_missing_files(spark, sf_dir):
    def file_name(name):
        return F.concat(F.col("doc_id").cast("string"), F.lit(".csv")).alias(name)

    documents, labels = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")
    tables = documents.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("table_name"), file_name("csv_file_name")
    )
    return missing_files(tables, labels.select(file_name("csv_file_name")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def s05_csv_quoted(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "documents")
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema, multiline=True)


@query(
    """SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
      CAST(o_orderdate AS DATE) AS order_date FROM orders"""
)
def s05_csv_typed(spark, sf_dir):
    path = scratch_path(spark, "orders")
    write_csv(b.money_orders(spark, sf_dir), path)
    return read_csv(spark, path, ORDERS)


@query(
    """SELECT p_partkey, '"' || p_name AS p_name, p_type || '"' AS p_type, CAST(p_retailprice AS DECIMAL(10,2)) AS price
    FROM part"""
)
def s06_csv_raw(spark, sf_dir):
    # One quoted field with a comma becomes two, and its quotes stay.
    part = b.table(spark, sf_dir, "part")
    both = F.concat_ws(",", "p_name", "p_type").alias("both")
    path = scratch_path(spark, "part")
    write_csv(part.select("p_partkey", both, F.col("p_retailprice").cast("decimal(10,2)").alias("price")), path)
    return read_csv(spark, path, "p_partkey bigint, p_name string, p_type string, price decimal(10,2)", "raw")


@query(
    """SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
      CAST(o_orderdate AS DATE) AS order_date FROM orders"""
)
def s07_csv_named(spark, sf_dir):
    path = scratch_path(spark, "orders")
    write_csv(b.money_orders(spark, sf_dir).select("order_date", "amount", "user_id", "id"), path)
    return read_csv(spark, path, ORDERS, "named")


def _report(load: DataFrame) -> DataFrame:
    return load.select("table_name", "csv_file_name", "rows_loaded", "success", "error_message")


@query(
    """SELECT 'orders' AS table_name, 'orders.csv' AS csv_file_name, count(*) AS rows_loaded, true AS success,
      CAST(NULL AS VARCHAR) AS error_message FROM orders"""
)
def s08_load_table(spark, sf_dir):
    path = scratch_path(spark, "orders")
    write_csv(b.money_orders(spark, sf_dir), path)
    target = scratch_path(spark, "loaded")
    return _report(load_table(spark, lambda: read_csv(spark, path, ORDERS), target, "orders", "orders.csv"))


@query()
def s08_load_time(spark, sf_dir):
    source = b.table(spark, sf_dir, "lineitem")
    return load_table(spark, lambda: source, scratch_path(spark, "loaded"), "lineitem")


@query("SELECT 'lineitem' AS table_name, count(*) AS rows_loaded, true AS success, true AS took_time FROM lineitem")
def s08_load_time_checked(spark, sf_dir):
    """What of a timed load must hold whatever the time."""
    took = (F.col("load_time_ms") > 0).alias("took_time")
    return s08_load_time(spark, sf_dir).select("table_name", "rows_loaded", "success", took)


@query(
    """SELECT user_id, count(*) AS n, sum(amount) AS total FROM (
      SELECT o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS amount FROM orders
      UNION ALL SELECT o_custkey, CAST(o_totalprice AS DECIMAL(10,2)) FROM orders) GROUP BY user_id"""
)
def s09_append(spark, sf_dir):
    target, rows = scratch_path(spark, "orders"), b.money_orders(spark, sf_dir)
    append(rows, target)
    append(rows, target)
    total = F.sum("amount").cast("decimal(38,2)").alias("total")
    return spark.read.parquet(target).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), total)


@query(
    f"""SELECT 'customer' AS table_name, CAST(NULL AS VARCHAR) AS csv_file_name, count(*) AS rows_loaded,
      true AS success, CAST(NULL AS VARCHAR) AS error_message, {TRIALS} AS trials FROM customer"""
)
def s10_trial_load(spark, sf_dir):
    source = b.table(spark, sf_dir, "customer")
    loaded = trial_load(spark, lambda: source, scratch_path(spark, "customer"), "customer", trials=TRIALS)
    return _report(loaded).withColumn("trials", F.lit(TRIALS))


@query(
    f"""WITH {b.LOADS_SQL}
    SELECT connection_name, arg_max(rows_loaded, position) AS rows_loaded,
      {_r2("CAST(sum(CAST(load_time_ms AS DECIMAL(18,6))) AS DOUBLE) / count(*)")} AS load_time_ms,
      arg_max(success, position) AS success,
      CASE WHEN arg_max(success, position) THEN NULL ELSE 'load failed' END AS error_message
    FROM loads GROUP BY connection_name"""
)
def s10_trial_summary(spark, sf_dir):
    trials = b.loads(spark, sf_dir).withColumnRenamed("position", "trial_no")
    return trial_summary(trials, ["connection_name"])


@query(
    """WITH k AS (
      SELECT greatest(1, CAST(ceil((SELECT count(*) FROM lineitem) * 1.0 / (SELECT count(*) FROM customer)) AS BIGINT)) AS k)
    SELECT c_custkey, c_name, copy_no FROM customer, range((SELECT k FROM k)) r(copy_no)"""
)
def s11_scale_to_threshold(spark, sf_dir):
    threshold = b.table(spark, sf_dir, "lineitem").count()
    return scale_to_threshold(b.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), threshold)


@query(
    """SELECT 'customer' AS table_name, CAST(NULL AS VARCHAR) AS csv_file_name,
      count(*) * greatest(1, CAST(ceil((SELECT count(*) FROM orders) * 1.0 / count(*)) AS BIGINT)) AS rows_loaded,
      true AS success, CAST(NULL AS VARCHAR) AS error_message FROM customer"""
)
def s11_load_to_threshold(spark, sf_dir):
    source, threshold = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders").count()
    return _report(load_to_threshold(spark, lambda: source, scratch_path(spark, "many"), "customer", threshold))


@query(
    f"""SELECT c_custkey AS id, c_name AS name, 'user_' || c_custkey || '@benchmark.com' AS email,
      CAST('{b.DAY}' AS DATE) AS created_on FROM customer"""
)
def s14_ddl_load_drop(spark, sf_dir):
    # A table made, filled and dropped by name; its rows are read back from its folder.
    path = scratch_path(spark, "users")
    name = "users_" + path.split("/")[-2].replace("-", "_")
    columns = "id BIGINT, name VARCHAR(100), email VARCHAR(100), created_at TIMESTAMP"
    apply_ddl(
        spark,
        [None, " ", f"DROP TABLE IF EXISTS {name}", f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}'"],
    )
    rows = constraints.with_default(b.users(spark, sf_dir), "created_at", F.lit(b.DAY).cast("timestamp"))
    append(rows.select(*USERS.names), name)
    apply_ddl(spark, [f"DROP TABLE IF EXISTS {name}"])
    created_on = F.col("created_at").cast("date").alias("created_on")
    return spark.read.parquet(path).select("id", "name", "email", created_on)


@query("SELECT count(*) AS rows_before, false AS exists_after FROM customer")
def s15_drop_table(spark, sf_dir):
    path = scratch_path(spark, "dropped")
    name = "dropped_" + path.split("/")[-2].replace("-", "_")
    b.table(spark, sf_dir, "customer").write.parquet(path)
    apply_ddl(spark, [f"CREATE TABLE {name} USING parquet LOCATION '{path}'"])
    before = spark.table(name).agg(F.count(F.lit(1)).alias("rows_before"))
    drop_table(spark, name)
    drop_table(spark, name)
    return before.withColumn("exists_after", F.lit(spark.catalog.tableExists(name)))


@query(f"SELECT 'lineitem' AS query_name, count(*) AS row_count, true AS timed, {RUNS} AS runs FROM lineitem")
def s16_time_df(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    timed = F.lit(time_df(lines, runs=RUNS) > 0).alias("timed")
    return queries.q_count(lines).select(F.lit("lineitem").alias("query_name"), "row_count", timed, F.lit(RUNS).alias("runs"))


# --- integrity -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def i01_pk_violations(spark, sf_dir):
    return constraints.pk_violations(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


PENDING_SQL = "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END"


def _pending(spark, sf_dir) -> DataFrame:
    """Orders whose pending rows have no user yet."""
    rows = b.table(spark, sf_dir, "orders")
    user = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return rows.withColumn("user_id", user)


@query(
    f"""SELECT user_id, o_orderpriority, count(*) AS n
    FROM (SELECT {PENDING_SQL} AS user_id, o_orderpriority FROM orders)
    GROUP BY user_id, o_orderpriority HAVING count(*) > 1 OR user_id IS NULL"""
)
def i01_pk_null_key(spark, sf_dir):
    return constraints.pk_violations(_pending(spark, sf_dir), ["user_id", "o_orderpriority"])


@query(
    f"""SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS null_rows FROM orders
    UNION ALL SELECT 'user_id', count(*) - count({PENDING_SQL}) FROM orders
    UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM orders"""
)
def i02_null_violations(spark, sf_dir):
    return constraints.null_violations(_pending(spark, sf_dir), ["o_orderkey", "user_id", "o_totalprice"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def i03_fk_orphans(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return constraints.fk_orphans(documents, b.table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def i03_fk_orphans_staged(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return constraints.fk_orphans(documents, b.table(spark, sf_dir, "labels"), "doc_id", "doc_id", staged=True)


@query(
    f"""SELECT o_orderkey, {PENDING_SQL} AS user_id FROM orders
    WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
)
def i03_fk_orphans_null_key(spark, sf_dir):
    child = _pending(spark, sf_dir).select("o_orderkey", "user_id")
    solvent = b.table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return constraints.fk_orphans(child, solvent, "user_id", "c_custkey")


def _cascade(spark, sf_dir, staged=False):
    in_debt = F.col("c_acctbal") < 0
    customer, orders = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    return constraints.cascade_delete(customer, orders, in_debt, "c_custkey", "o_custkey", staged)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def i04_cascade_parent(spark, sf_dir):
    return _cascade(spark, sf_dir).parent.select("c_custkey", "c_name", "c_acctbal")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def i04_cascade_child(spark, sf_dir):
    return _cascade(spark, sf_dir).child.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def i04_cascade_child_staged(spark, sf_dir):
    return _cascade(spark, sf_dir, staged=True).child.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    """SELECT doc_id, n_chars, concat_ws(',', CASE WHEN length(text) > 1000 THEN 'text' END,
      CASE WHEN length(source) > 4 THEN 'source' END,
      CASE WHEN TRY_CAST(text AS DECIMAL(10,2)) IS NULL AND text IS NOT NULL THEN 'number' END) AS violations
    FROM documents
    WHERE length(text) > 1000 OR length(source) > 4
      OR (TRY_CAST(text AS DECIMAL(10,2)) IS NULL AND text IS NOT NULL)"""
)
def i05_type_violations(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents").withColumn("number", F.col("text"))
    limits = {"text": "VARCHAR(1000)", "source": "varchar2(4)", "number": "decimal(10,2)"}
    return constraints.type_violations(documents, limits).select("doc_id", "n_chars", "violations")


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice, 'price' AS violations FROM lineitem
    WHERE TRY_CAST(l_extendedprice * 2000 AS DECIMAL(10,2)) IS NULL"""
)
def i05_decimal_fit(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") * 2000)
    found = constraints.type_violations(lines, {"price": "decimal(10,2)"})
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", "violations")


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) ELSE DATE '{b.DAY}' END
      AS created_on, DATE '{b.DAY}' AS loaded_on FROM orders"""
)
def i06_with_default(spark, sf_dir):
    day = F.lit(b.DAY).cast("date")
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", known.alias("created_on"))
    return constraints.with_default(constraints.with_default(rows, "created_on", day), "loaded_on", day)


@query(
    """SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS order_date
    FROM orders"""
)
def i07_write_sorted(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    write_sorted(b.orders(spark, sf_dir), path, ["user_id", "order_date"])
    return spark.read.parquet(path)


# --- query shapes --------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, 'user_' || c_custkey || '@benchmark.com' AS email FROM customer")
def q01_read(spark, sf_dir):
    return queries.q_read(b.users(spark, sf_dir))


JOIN_SQL = f"""SELECT c_name AS name, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS order_date
    FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > {JOIN_BOUND}"""


@query(f"{JOIN_SQL} ORDER BY o_orderkey LIMIT 100")
def q02_join(spark, sf_dir):
    return queries.q_join(b.users(spark, sf_dir), b.orders(spark, sf_dir), JOIN_BOUND, order_by=["id"])


@query(JOIN_SQL)
def q02_join_all(spark, sf_dir):
    return queries.q_join(b.users(spark, sf_dir), b.orders(spark, sf_dir), JOIN_BOUND, limit=None)


@query()
def q02_join_any(spark, sf_dir):
    return queries.q_join(b.users(spark, sf_dir), b.orders(spark, sf_dir), JOIN_BOUND)


@query(f"SELECT least(100, count(*)) AS n, least(100, count(*)) AS of_the_join FROM ({JOIN_SQL})")
def q02_join_any_checked(spark, sf_dir):
    """How many rows the unordered join gives, and how many of them the whole join has."""
    whole = q02_join_all(spark, sf_dir).distinct().withColumn("hit", F.lit(1))
    some = q02_join_any(spark, sf_dir).join(whole, ["name", "amount", "order_date"], "left")
    return some.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("of_the_join"))


@query(
    f"""SELECT c_name AS name, sum(CAST(o_totalprice AS DECIMAL(10,2))) AS total_spent, count(o_orderkey) AS order_count
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name
    HAVING sum(CAST(o_totalprice AS DECIMAL(10,2))) > {TOTAL_BOUND}"""
)
def q03_aggregate(spark, sf_dir):
    totals = queries.q_aggregate(b.users(spark, sf_dir), b.money_orders(spark, sf_dir), TOTAL_BOUND)
    return totals.withColumn("total_spent", F.col("total_spent").cast("decimal(38,2)"))


@query("SELECT count(*) AS row_count FROM lineitem")
def q04_count(spark, sf_dir):
    return queries.q_count(b.table(spark, sf_dir, "lineitem"))


@query("SELECT * FROM lineitem WHERE l_extendedprice > 50000")
def q05_filter(spark, sf_dir):
    return queries.q_filter(b.table(spark, sf_dir, "lineitem"), "l_extendedprice", 50_000)


def _free_queries(spark, sf_dir) -> DataFrame:
    """A query per nation with customers, made from the tables: each totals one nation's accounts."""
    path = f"{sf_dir}/customer.parquet"
    text = F.concat(
        F.lit(f"SELECT count(*) AS n, sum(c_acctbal) AS total FROM parquet.`{path}` WHERE c_nationkey = "),
        F.col("c_nationkey").cast("string"),
    )
    nations = b.table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    return nations.select(
        F.col("c_nationkey").alias("position"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("name"),
        F.lit("AGGREGATE").alias("category"),
        F.create_map(F.lit("spark"), text).alias("queries_by_db"),
    )


@query(
    """SELECT DISTINCT 'spark' AS connection_name, 'nation_' || c_nationkey AS query_name, 'AGGREGATE' AS category,
      true AS success, CAST(NULL AS VARCHAR) AS error_message, 1 AS runs FROM customer"""
)
def q06_run_queries(spark, sf_dir):
    report = run_queries(spark, _free_queries(spark, sf_dir), "Spark", runs=1)
    return report.select("connection_name", "query_name", "category", "success", "error_message", F.lit(1).alias("runs"))


@query(
    f"""SELECT c_mktsegment AS segment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(10,2))) AS total
    FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > {JOIN_BOUND} GROUP BY c_mktsegment"""
)
def q07_bound_parameters(spark, sf_dir):
    text = """SELECT c.c_mktsegment AS segment, count(*) AS n,
        CAST(sum(CAST(o.o_totalprice AS DECIMAL(10,2))) AS DECIMAL(38,2)) AS total
      FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey
      WHERE o.o_totalprice > :bound GROUP BY c.c_mktsegment"""
    names = {name: b.table(spark, sf_dir, name) for name in ["customer", "orders"]}
    return spark.sql(text, args={"bound": JOIN_BOUND}, **names)


def _resolved_sql(dialect: str) -> str:
    return f"""SELECT p.position, p.prefix || c_custkey AS name, p.category,
      CASE WHEN c_mktsegment = 'BUILDING' THEN p.text || c_custkey END AS sql_text,
      CASE WHEN c_mktsegment <> 'BUILDING' THEN 'No queries configuration found for database type: {dialect}' END
        AS error_message
    FROM customer,
      (VALUES (0, 'read_', 'SELECT', 'SELECT * FROM orders WHERE o_custkey = '),
        (1, 'count_', '', 'SELECT count(*) FROM orders WHERE o_custkey = ')) p(position, prefix, category, text)"""


@query(_resolved_sql("Building"))
def q08_resolve_text(spark, sf_dir):
    return resolve_text(_config(spark, sf_dir).queries, "Building")


@query(_resolved_sql("BUILDing"))
def q08_resolve_text_mixed_case(spark, sf_dir):
    return resolve_text(_config(spark, sf_dir, mixed_case=True).queries, "BUILDing")


# --- storage -------------------------------------------------------------------------------------

STAT_TABLES = ["customer", "documents", "events", "lineitem", "orders", "part"]


def _stats(spark, sf_dir):
    return storage.table_stats(spark, {name: f"{sf_dir}/{name}.parquet" for name in STAT_TABLES})


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAT_TABLES))
def t01_table_rows(spark, sf_dir):
    return _stats(spark, sf_dir).select("table_name", "row_count")


@query()
def t01_table_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{t}' AS table_name, count(*) AS row_count, true AS sized, true AS rated FROM {t}"
        for i, t in enumerate(STAT_TABLES)
    )
)
def t01_table_stats_checked(spark, sf_dir):
    """Rows of each table, and whether its sizes and its bytes per row can be right."""
    data, total, n = F.col("data_size_bytes"), F.col("total_size_bytes"), F.col("row_count")
    return _stats(spark, sf_dir).select(
        "position",
        "table_name",
        "row_count",
        ((total >= data) & (data > 0)).alias("sized"),
        (F.col("bytes_per_row") == data / n).alias("rated"),
    )


@query(
    f"""WITH {b.STORAGE_PARTS_SQL},
    sizes AS (SELECT "table" AS table_name, CAST(coalesce(sum(bytes_on_disk) FILTER (WHERE active), 0) AS BIGINT) AS size
      FROM storage_parts GROUP BY "table"),
    counts AS (SELECT 'table_' || l_suppkey AS table_name, count(*) AS n FROM lineitem GROUP BY l_suppkey)
    SELECT 'table_' || s_suppkey AS table_name, coalesce(n, 0) AS row_count, size AS data_size_bytes,
      size AS total_size_bytes, {_r2("size / 1024 / 1024")} AS total_size_mb,
      CASE WHEN n > 0 THEN size / n ELSE CASE WHEN size IS NOT NULL THEN 0 END END AS bytes_per_row
    FROM supplier LEFT JOIN sizes ON sizes.table_name = 'table_' || s_suppkey
      LEFT JOIN counts ON counts.table_name = 'table_' || s_suppkey"""
)
def t01_footprint(spark, sf_dir):
    parts = b.storage_parts(spark, sf_dir).select(
        F.lit("all").alias("database"), "table", "active", "bytes_on_disk"
    )
    sizes = storage.active_parts_size(parts).withColumnRenamed("table", "table_name").drop("database")
    counts = (
        b.blocks(spark, sf_dir).groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    )
    return storage.footprint(b.segment_tables(spark, sf_dir), counts, sizes)


@query(f"SELECT p_partkey, {_r2('p_retailprice * 1000000 / 1024 / 1024')} AS size_mb FROM part")
def t02_size_mb(spark, sf_dir):
    size = F.col("p_retailprice") * 1_000_000
    return b.table(spark, sf_dir, "part").select("p_partkey", size_mb(size).alias("size_mb"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity,
      CASE WHEN l_discount > 0 THEN l_extendedprice / CAST(floor(l_discount * 100 + 0.5) AS BIGINT) ELSE 0 END
        AS bytes_per_row
    FROM lineitem"""
)
def t03_bytes_per_row(spark, sf_dir):
    rows = F.floor(F.col("l_discount") * 100 + 0.5)
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", bytes_per_row("l_extendedprice", rows).alias("bytes_per_row")
    )


SEGMENT_SUM_SQL = f"""WITH {b.CATALOG_SQL}
    SELECT table_schema, table_name, data_length AS data_size_bytes, index_length AS index_size_bytes,
      data_length + index_length AS total_size_bytes FROM catalog_tables"""


@query(SEGMENT_SUM_SQL)
def t04_sum_segments(spark, sf_dir):
    return storage.sum_segments(b.catalog_tables(spark, sf_dir))


@query(f"{SEGMENT_SUM_SQL} WHERE table_schema = 'Brand#7'")
def t04_sum_segments_of_schema(spark, sf_dir):
    return storage.sum_segments(b.catalog_tables(spark, sf_dir), schema="Brand#7")


@query(
    f"""WITH {b.STORAGE_PARTS_SQL}
    SELECT "database", "table", CAST(coalesce(sum(bytes_on_disk) FILTER (WHERE active), 0) AS BIGINT) AS data_size_bytes,
      CAST(coalesce(sum(bytes_on_disk) FILTER (WHERE active), 0) AS BIGINT) AS total_size_bytes
    FROM storage_parts GROUP BY "database", "table" """
)
def t05_active_parts_size(spark, sf_dir):
    return storage.active_parts_size(b.storage_parts(spark, sf_dir))


@query(
    f"""WITH {b.SEGMENTS_SQL},
    members AS (
      SELECT table_name, upper(table_name) AS segment_name FROM wanted
      UNION SELECT w.table_name, i.index_name FROM wanted w JOIN indexes i ON i.table_name = upper(w.table_name))
    SELECT m.table_name,
      CAST(coalesce(sum(s.bytes) FILTER (WHERE s.segment_name = upper(m.table_name) AND s.segment_type = 'TABLE'), 0)
        AS BIGINT) AS data_size_bytes,
      CAST(coalesce(sum(s.bytes), 0) AS BIGINT) AS total_size_bytes
    FROM members m LEFT JOIN segments s USING (segment_name) GROUP BY m.table_name"""
)
def t06_segment_sizes(spark, sf_dir):
    return storage.segment_sizes(
        b.segments(spark, sf_dir), b.segment_indexes(spark, sf_dir), b.segment_tables(spark, sf_dir)
    )


@query(
    f"""WITH {b.BLOCKS_SQL}
    SELECT table_name, count(DISTINCT block_id) * {BLOCK_SIZE} AS size_bytes,
      {_r2(f"count(DISTINCT block_id) * {BLOCK_SIZE} / 1024 / 1024")} AS size_mb
    FROM blocks GROUP BY table_name"""
)
def t07_block_sizes(spark, sf_dir):
    return storage.block_sizes(b.blocks(spark, sf_dir), BLOCK_SIZE)


@query("SELECT page_id, list_last(string_split(string_split(url, '?')[1], '/')) AS db_name FROM pages")
def t08_db_name(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", db_name("url").alias("db_name"))


# --- measurements --------------------------------------------------------------------------------


def _mean_sql(column: str, condition: str = "true") -> str:
    total = f"CAST(sum(CAST({column} AS DECIMAL(18,6))) FILTER (WHERE {condition}) AS DOUBLE)"
    return f"{total} / nullif(count(*) FILTER (WHERE {condition}), 0)"


@query(
    f"""WITH {b.TIMINGS_SQL}
    SELECT connection_name, query_name, count(*) AS runs, {_r2(_mean_sql("execution_time_ms"))} AS mean_ms
    FROM timings GROUP BY connection_name, query_name"""
)
def m01_mean_runs(spark, sf_dir):
    return measures.mean_runs(b.timings(spark, sf_dir), ["connection_name", "query_name"])


@query(
    f"""WITH {b.LOADS_SQL}
    SELECT position, CASE WHEN load_time_ms > 0 THEN rows_loaded / (load_time_ms / 1000) ELSE 0 END AS rows_per_s
    FROM loads"""
)
def m02_rate(spark, sf_dir):
    return b.loads(spark, sf_dir).select("position", rate("rows_loaded", "load_time_ms").alias("rows_per_s"))


@query(
    f"""WITH {b.LOADS_SQL}
    SELECT position, CASE WHEN rows_loaded > 0 THEN load_time_ms / (2 * rows_loaded) ELSE 0 END AS ms_per_row
    FROM loads"""
)
def m03_latency(spark, sf_dir):
    rows = F.col("rows_loaded") * 2
    return b.loads(spark, sf_dir).select("position", latency("load_time_ms", rows).alias("ms_per_row"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_r2('l_extendedprice * l_discount')} AS saved FROM lineitem")
def m04_round2(spark, sf_dir):
    saved = round2(F.col("l_extendedprice") * F.col("l_discount")).alias("saved")
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", saved)


def _imports_sql(loads: str) -> str:
    return f"""
import_totals AS (
  SELECT connection_name, count(*) AS tables_imported, CAST(sum(rows_loaded) AS BIGINT) AS total_rows_loaded,
    CAST(sum(CAST(load_time_ms AS DECIMAL(18,6))) AS DOUBLE) AS ms, bool_or(success) AS any_loaded
  FROM {loads} GROUP BY connection_name),
imports AS (
  SELECT connection_name, tables_imported, total_rows_loaded, {_r2("ms")} AS total_import_time_ms,
    {_r2("ms / tables_imported")} AS average_table_import_time_ms,
    CASE WHEN ms > 0 THEN {_r2("total_rows_loaded / (ms / 1000)")} ELSE 0 END AS csv_import_rate, any_loaded
  FROM import_totals)"""


@query(f"WITH {b.LOADS_SQL}, {_imports_sql('loads')} SELECT * FROM imports")
def m05_import_metrics(spark, sf_dir):
    return measures.import_metrics(b.loads(spark, sf_dir))


@query(f"WITH {b.USER_LOADS_SQL}, {_imports_sql('user_loads')} SELECT * FROM imports")
def m05_import_metrics_by_user(spark, sf_dir):
    return measures.import_metrics(b.user_loads(spark, sf_dir))


@query(
    f"""WITH {b.USER_LOADS_SQL}, {_imports_sql('user_loads')}, places AS (
      SELECT 'conn_' || c_custkey AS connection_name FROM customer UNION ALL SELECT 'supplier_' || s_suppkey FROM supplier)
    SELECT connection_name, coalesce(tables_imported, 0) AS tables_imported,
      coalesce(total_rows_loaded, 0) AS total_rows_loaded, coalesce(total_import_time_ms, 0) AS total_import_time_ms,
      coalesce(average_table_import_time_ms, 0) AS average_table_import_time_ms,
      coalesce(csv_import_rate, 0) AS csv_import_rate, coalesce(any_loaded, false) AS any_loaded
    FROM places LEFT JOIN imports USING (connection_name)"""
)
def m05_import_metrics_no_tables(spark, sf_dir):
    """Suppliers are connections too: they have no loads, and zeros."""
    suppliers = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("connection_name"))
    places = b.results(spark, sf_dir).select("connection_name").unionByName(suppliers)
    return measures.import_metrics(b.user_loads(spark, sf_dir), places)


QUERY_MEANS_SQL = f"""
query_means AS (
  SELECT connection_name, {_mean_sql("execution_time_ms", "success")} AS mean FROM user_timings GROUP BY connection_name)"""


@query(
    f"""WITH {b.USER_TIMINGS_SQL}, {QUERY_MEANS_SQL}
    SELECT connection_name, {_r2("mean")} AS mean_ms,
      coalesce(CAST(CAST({_r2("mean")} AS DECIMAL(18,2)) AS VARCHAR), 'N/A') AS shown FROM query_means"""
)
def m06_avg_query_time(spark, sf_dir):
    means = measures.avg_query_time(b.user_timings(spark, sf_dir))
    return means.select("connection_name", round2("avg_query_time_ms").alias("mean_ms"), "shown")


def _leader_sql(source: str, metric: str, lower: bool, condition: str = "true") -> str:
    direction = "ASC" if lower else "DESC"
    return f"""(SELECT '{metric}' AS metric, connection_name, CAST({metric} AS DOUBLE) AS value, db_type FROM {source}
      WHERE {metric} IS NOT NULL AND {condition} ORDER BY {metric} {direction}, position LIMIT 1)"""


def _leaders_sql(source: str, metrics: dict[str, bool], condition: str = "true") -> str:
    return " UNION ALL ".join(_leader_sql(source, m, lower, condition) for m, lower in metrics.items())


@query(f"WITH {b.METRICS_SQL} {_leaders_sql('metrics', STANDARD_LEADERS, 'success')}")
def m07_standard_leaders(spark, sf_dir):
    return measures.standard_leaders(b.metrics(spark, sf_dir))


@query(f"WITH {b.METRICS_SQL} {_leader_sql('metrics', 'join_time_ms', True, 'success')}")
def m07_leader(spark, sf_dir):
    return measures.leader(b.metrics(spark, sf_dir), "join_time_ms")


CUSTOM_ROWS_SQL = f"""WITH {b.USER_LOADS_SQL}, {b.USER_TIMINGS_SQL}, {b.RESULTS_SQL}, {_imports_sql("user_loads")},
  {QUERY_MEANS_SQL},
  custom_rows AS (
    SELECT r.connection_name, r.db_type, r.position, coalesce(i.total_import_time_ms, 0) AS total_import_time_ms,
      coalesce(i.csv_import_rate, 0) AS csv_import_rate,
      coalesce(i.average_table_import_time_ms, 0) AS average_table_import_time_ms,
      coalesce(i.any_loaded, false) AS any_loaded, floor(coalesce(q.mean, 1e9) * 1000 + 0.5) / 1000 AS avg_query_time_ms
    FROM results r LEFT JOIN imports i USING (connection_name) LEFT JOIN query_means q USING (connection_name)
    WHERE r.success),
  strict_rows AS (
    SELECT connection_name, db_type, position, avg_query_time_ms,
      CASE WHEN any_loaded THEN total_import_time_ms END AS total_import_time_ms,
      CASE WHEN any_loaded THEN csv_import_rate END AS csv_import_rate,
      CASE WHEN any_loaded THEN average_table_import_time_ms END AS average_table_import_time_ms
    FROM custom_rows)"""


def _custom_leaders(spark, sf_dir, strict: bool) -> DataFrame:
    found = measures.custom_leaders(
        b.results(spark, sf_dir),
        measures.import_metrics(b.user_loads(spark, sf_dir)),
        measures.avg_query_time(b.user_timings(spark, sf_dir)),
        strict,
    )
    return found.withColumn("value", F.floor(F.col("value") * 1000 + 0.5) / 1000)


@query(f"{CUSTOM_ROWS_SQL} {_leaders_sql('strict_rows', CUSTOM_LEADERS)}")
def m08_custom_leaders(spark, sf_dir):
    return _custom_leaders(spark, sf_dir, strict=True)


@query(f"{CUSTOM_ROWS_SQL} {_leaders_sql('custom_rows', CUSTOM_LEADERS)}")
def m08_custom_leaders_not_strict(spark, sf_dir):
    return _custom_leaders(spark, sf_dir, strict=False)


@query(
    f"""WITH {b.METRICS_SQL}
    SELECT connection_name, db_type, position, {", ".join(f"coalesce({c}, 0) AS {c}" for c in CHARTED)}
    FROM metrics WHERE success"""
)
def m09_chart_overall(spark, sf_dir):
    return compare.chart_overall(b.metrics(spark, sf_dir))


@query(
    f"""WITH {b.USER_LOADS_SQL}, {b.RESULTS_SQL}, {_imports_sql("user_loads")}
    SELECT connection_name, db_type, position, coalesce(csv_import_rate, 0) AS csv_import_rate,
      coalesce(total_import_time_ms, 0) AS total_import_time_ms
    FROM results LEFT JOIN imports USING (connection_name) WHERE success"""
)
def m09_chart_imports(spark, sf_dir):
    return compare.chart_imports(b.results(spark, sf_dir), measures.import_metrics(b.user_loads(spark, sf_dir)))


def _first_sql(source: str, name: str, columns: list[str]) -> str:
    """The first row of each (name, connection) by position."""
    return f"""firsts AS (
      SELECT {name}, connection_name, position, {", ".join(columns)} FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {name}, connection_name ORDER BY position) = 1)"""


def _pivot_sql(source: str, name: str, connections: list[str], columns: list[str], cell: str, missing: str) -> str:
    cells = ", ".join(
        f"""coalesce(max({cell}) FILTER (WHERE connection_name = '{c}'), {missing}) AS "{c}" """ for c in connections
    )
    return f"""WITH {source[1]}, {_first_sql(source[0], name, columns)}
    SELECT {name}, min(position) AS position, {cells} FROM firsts GROUP BY {name}"""


@query(
    _pivot_sql(
        ("loads", b.LOADS_SQL), "table_name", b.PRIORITIES, ["load_time_ms", "success"],
        "CASE WHEN success THEN load_time_ms ELSE 0 END", "0",
    )
)
def m10_pivot_loads(spark, sf_dir):
    return compare.pivot_loads(b.loads(spark, sf_dir), b.PRIORITIES)


@query(
    f"""WITH {b.USER_LOADS_SQL}, {_first_sql("user_loads", "table_name", ["load_time_ms", "success"])}
    SELECT table_name, connection_name, position, CASE WHEN success THEN load_time_ms ELSE 0 END AS load_time_ms
    FROM firsts"""
)
def m10_loads_long(spark, sf_dir):
    return compare.loads_long(b.user_loads(spark, sf_dir)).drop("shown")


@query(
    _pivot_sql(
        ("timings", b.TIMINGS_SQL), "query_name", b.EVENT_TYPES, ["execution_time_ms", "success"],
        "CASE WHEN success THEN execution_time_ms ELSE 0 END", "0",
    )
)
def m11_pivot_queries(spark, sf_dir):
    return compare.pivot_queries(b.timings(spark, sf_dir), b.EVENT_TYPES)


@query(
    f"""WITH {b.USER_TIMINGS_SQL}, {_first_sql("user_timings", "query_name", ["execution_time_ms", "success"])}
    SELECT query_name, connection_name, position, CASE WHEN success THEN execution_time_ms ELSE 0 END AS execution_time_ms
    FROM firsts"""
)
def m11_queries_long(spark, sf_dir):
    return compare.queries_long(b.user_timings(spark, sf_dir)).drop("category", "shown")


LOAD_TEXT_SQL = """CASE WHEN success THEN CAST(CAST(load_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms ('
      || format('{:,}', rows_loaded) || ' rows)' ELSE 'Error' END"""


@query(
    f"""WITH {b.USER_LOADS_SQL}, {_first_sql("user_loads", "table_name", ["load_time_ms", "rows_loaded", "success"])}
    SELECT table_name, connection_name, {LOAD_TEXT_SQL} AS shown FROM firsts"""
)
def m12_load_grid_long(spark, sf_dir):
    return compare.loads_long(b.user_loads(spark, sf_dir)).select("table_name", "connection_name", "shown")


@query(
    f"""WITH {b.USER_TIMINGS_SQL}, {_first_sql("user_timings", "query_name", ["execution_time_ms", "success"])},
    kinds AS (SELECT query_name, coalesce(nullif(arg_min(category, position), ''), 'QUERY') AS category
      FROM user_timings GROUP BY query_name)
    SELECT query_name, connection_name, category,
      CASE WHEN success THEN CAST(CAST(execution_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms' ELSE 'Error' END AS shown
    FROM firsts JOIN kinds USING (query_name)"""
)
def m12_query_grid_long(spark, sf_dir):
    long = compare.queries_long(b.user_timings(spark, sf_dir))
    return long.select("query_name", "connection_name", "category", "shown")


@query(
    _pivot_sql(
        ("loads", b.LOADS_SQL), "table_name", b.PRIORITIES, ["load_time_ms", "rows_loaded", "success"],
        "CASE WHEN success THEN CAST(CAST(load_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms (' "
        "|| format('{:,}', rows_loaded) || ' rows)' ELSE 'Error' END", "'-'",
    )
)
def m12_load_grid(spark, sf_dir):
    return compare.load_grid(b.loads(spark, sf_dir), b.PRIORITIES)


QUERY_CELLS_SQL = ", ".join(
    f"""coalesce(max(CASE WHEN success THEN CAST(CAST(execution_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms'
      ELSE 'Error' END) FILTER (WHERE connection_name = '{c}'), '-') AS "{c}" """
    for c in b.EVENT_TYPES
)


@query(
    f"""WITH {b.TIMINGS_SQL}, {_first_sql("timings", "query_name", ["execution_time_ms", "success", "category"])}
    SELECT query_name, min(position) AS position,
      coalesce(nullif(arg_min(category, position), ''), 'QUERY') AS category, {QUERY_CELLS_SQL}
    FROM firsts GROUP BY query_name"""
)
def m12_query_grid(spark, sf_dir):
    return compare.query_grid(b.timings(spark, sf_dir), b.EVENT_TYPES)


def _stat_cell_sql(column: str, unit: str) -> str:
    if column == "total_size_mb":
        return f"format('{{:,.2f}}', {_r2('total_size_bytes / 1024 / 1024')}) || '{unit}'"
    if column == "bytes_per_row":
        return f"CAST(CAST({_r2('data_size_bytes / row_count')} AS DECIMAL(18,2)) AS VARCHAR) || '{unit}'"
    return f"format('{{:,}}', {column}) || '{unit}'"


@query(
    f"WITH {b.TABLE_STATS_SQL} "
    + " UNION ALL ".join(
        f"SELECT table_name, min(position) AS position, {line} AS line, '{label}' AS statistic, "
        + ", ".join(
            f"""coalesce(max({_stat_cell_sql(column, unit)}) FILTER (WHERE connection_name = '{c}'), '-') AS "{c}" """
            for c in ["A", "N", "R"]
        )
        + " FROM stats GROUP BY table_name"
        for line, (label, column, unit, _) in enumerate(STATISTICS)
    )
)
def m13_stats_grid(spark, sf_dir):
    return compare.stats_grid(b.table_stats_rows(spark, sf_dir), ["A", "N", "R"])


@query(
    f"WITH {b.TABLE_STATS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT connection_name AS table_name, replace(table_name, 'table_', 'conn_') AS connection_name, position,
        {line} AS line, '{label}' AS statistic, {_stat_cell_sql(column, unit)} AS text FROM stats"""
        for line, (label, column, unit, _) in enumerate(STATISTICS)
    )
)
def m13_stats_long(spark, sf_dir):
    return compare.stats_long(b.table_stats_rows(spark, sf_dir, by_supplier=True))


@query(f"WITH {b.LOADS_SQL} SELECT table_name, min(position) AS position FROM loads GROUP BY table_name")
def m14_names_in_order(spark, sf_dir):
    return compare.names_in_order(b.loads(spark, sf_dir), "table_name")


@query(
    f"""WITH {b.TIMINGS_SQL}
    SELECT query_name, coalesce(nullif(arg_min(category, position), ''), 'QUERY') AS category
    FROM timings GROUP BY query_name"""
)
def m15_category_of(spark, sf_dir):
    return compare.category_of(b.timings(spark, sf_dir))


@query(f"WITH {b.METRICS_SQL} SELECT connection_name, error FROM metrics WHERE NOT success")
def m16_failures(spark, sf_dir):
    return compare.failures(b.metrics(spark, sf_dir))


@query(
    f"""WITH {b.RESULTS_SQL} SELECT connection_name, coalesce(error, '{NO_MESSAGE}') AS error FROM results
    WHERE NOT success OR error IS NOT NULL"""
)
def m16_failures_custom(spark, sf_dir):
    return compare.failures(b.results(spark, sf_dir), custom=True)


@query(
    f"""WITH {b.RESULTS_SQL}, {b.METRICS_SQL}
    SELECT connection_name, position, success, error, NULL AS read_time_ms FROM results
    UNION ALL SELECT connection_name, position, success, error, read_time_ms FROM metrics"""
)
def m17_union_results(spark, sf_dir):
    metrics = b.metrics(spark, sf_dir).select("connection_name", "position", "success", "error", "read_time_ms")
    return compare.union_results([b.results(spark, sf_dir).drop("db_type"), metrics])


def _metric_text_sql(column: str) -> str:
    text = f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR) || ' ms'"
    if column.endswith("_rate"):
        text = f"format('{{:,.2f}}', {column}) || ' rows/s'"
    return f"coalesce(CASE WHEN success THEN {text} END, '-') AS {column}"


@query(
    f"""WITH {b.METRICS_SQL}
    SELECT connection_name, db_type, position, CASE WHEN success THEN 'OK' ELSE 'Error' END AS status,
      {", ".join(_metric_text_sql(c) for c in METRIC_COLUMNS)}
    FROM metrics"""
)
def m18_comparison(spark, sf_dir):
    return compare.comparison(b.metrics(spark, sf_dir))


@query(
    f"""WITH {b.METRICS_SQL}
    SELECT connection_name, db_type, position FROM metrics WHERE success AND read_time_ms IS NOT NULL"""
)
def m19_successful(spark, sf_dir):
    return compare.successful(b.metrics(spark, sf_dir), "read_time_ms").select("connection_name", "db_type", "position")


@query(
    "WITH "
    + b.LOADS_SQL
    + ", "
    + _imports_sql("loads")
    + " "
    + " UNION ALL ".join(
        f"SELECT '{label}' AS metric, {line} AS position, "
        + ", ".join(
            f"""coalesce(max({text}) FILTER (WHERE connection_name = '{c}' AND connection_name <> '3-MEDIUM'), '-')
            AS "{c}" """
            for c in b.PRIORITIES
        )
        + " FROM imports"
        for line, (label, text) in enumerate({
            "Total Rows Loaded": "format('{:,}', total_rows_loaded)",
            "Total Import Time (ms)": "CAST(CAST(total_import_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms'",
            "Average Table Import (ms)": "CAST(CAST(average_table_import_time_ms AS DECIMAL(18,2)) AS VARCHAR) || ' ms'",
            "CSV Import Rate (rows/s)": "format('{:,.2f}', csv_import_rate) || ' rows/s'",
        }.items())
    )
)
def m18_import_grid(spark, sf_dir):
    imports = measures.import_metrics(b.loads(spark, sf_dir))
    places = imports.select("connection_name", (F.col("connection_name") != "3-MEDIUM").alias("success"))
    return compare.import_grid(places, imports, b.PRIORITIES)


# --- a whole custom run --------------------------------------------------------------------------


def custom_workload(spark, sf_dir, more: tuple[str, ...] = (), **modes) -> CustomRun:
    """The run below, made once per session and mode: many queries look at one."""
    key = (spark.sparkContext.applicationId, sf_dir, more, tuple(sorted(modes.items())))
    if key not in _RUNS:
        _RUNS[key] = _custom_workload(spark, sf_dir, more, **modes)
    return _RUNS[key]


_RUNS: dict[tuple, CustomRun] = {}


def _custom_workload(spark, sf_dir, more: tuple[str, ...], **modes) -> CustomRun:
    """A run over CSV files written from the tables: two connections that work, one without a schema under a name that
    another has, and one of an unknown type; a table whose file does not fit it, and a query that fails.

    ``more`` are further file formats, each of a connection of that name between these; ``modes`` go to the run.
    """
    folder = scratch_path(spark, "workload")
    customer, orders = (b.table(spark, sf_dir, name) for name in ("customer", "orders"))
    files = {
        "clients.csv": customer.select("c_custkey", "c_name", "c_acctbal"),
        "orders.csv": orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "broken.csv": customer.select("c_name"),
    }
    for name, df in files.items():
        write_csv(df, f"{folder}/{name}")
    columns = {
        "clients": "id BIGINT, name STRING, balance DOUBLE",
        "orders": "id BIGINT, client BIGINT, price DOUBLE",
        "broken": "id INT",
    }
    texts = {
        "all clients": ("SELECT", "SELECT * FROM clients"),
        "totals": ("", "SELECT c.name, sum(o.price) FROM clients c JOIN orders o ON c.id = o.client GROUP BY c.name"),
        "no such column": ("SELECT", "SELECT missing FROM clients"),
    }
    formats = {"Parquet": "parquet", "ORC": "orc"} | {kind: kind for kind in more}
    places = [("columnar", "Parquet"), ("striped", "orc"), ("columnar", "avro" if "json" in more else "json"), ("elsewhere", "db2")]
    places[3:3] = [(kind, kind) for kind in more]
    config = {
        "connectionDetails": [{"name": name, "dbType": kind, "url": "none"} for name, kind in places],
        "tables": [
            {
                "tableName": name,
                "csvFileName": f"{name}.csv",
                "schemas": {key: f"CREATE TABLE {name} ({ddl}) USING {fmt}" for key, fmt in formats.items()},
            }
            for name, ddl in columns.items()
        ],
        "queries": [
            {"name": name, "category": kind, "queriesByDb": dict.fromkeys(formats, text)}
            for name, (kind, text) in texts.items()
        ],
    }
    report_rows(spark, [(json.dumps(config),)], "value string").write.text(f"{folder}/config")
    described = read_config(spark, f"{folder}/config", multiline=False)
    return custom_run(spark, described, {name: f"{folder}/{name}" for name in files}, **({"threshold": 1, "runs": 1} | modes))


WORKING = "(VALUES ('columnar'), ('striped')) c(connection_name)"


@query(
    """SELECT * FROM (VALUES ('columnar', 'Parquet', 0, true, NULL), ('striped', 'orc', 1, true, NULL),
      ('columnar (2)', 'json', 2, false, 'No schema for table clients and database type: json'),
      ('elsewhere', 'db2', 3, false, 'Unsupported database type: db2'))
      r(connection_name, db_type, position, success, error)"""
)
def r01_custom_results(spark, sf_dir):
    return custom_workload(spark, sf_dir).results


@query(
    f"""SELECT connection_name, position, table_name, table_name || '.csv' AS csv_file_name, rows_loaded, success
    FROM {WORKING}, (SELECT 0 AS position, 'clients' AS table_name, count(*) AS rows_loaded, true AS success FROM customer
      UNION ALL SELECT 1, 'orders', count(*), true FROM orders UNION ALL SELECT 2, 'broken', 0, false)"""
)
def r02_custom_loads(spark, sf_dir):
    return custom_workload(spark, sf_dir).loads.drop("load_time_ms", "error_message")


@query(
    f"""SELECT connection_name, query_name, category, success FROM {WORKING},
      (VALUES ('all clients', 'SELECT', true), ('totals', '', true), ('no such column', 'SELECT', false))
      q(query_name, category, success)"""
)
def r03_custom_timings(spark, sf_dir):
    return custom_workload(spark, sf_dir).timings.select("connection_name", "query_name", "category", "success")


@query(
    """SELECT * FROM (VALUES ('columnar (2)', 'No schema for table clients and database type: json'),
      ('elsewhere', 'Unsupported database type: db2')) f(connection_name, error)"""
)
def r04_custom_failures(spark, sf_dir):
    return custom_report(custom_workload(spark, sf_dir), wide=False)["failures"]


@query(
    f"""SELECT connection_name, table_name, statistic, text FROM {WORKING}, (
      SELECT 'clients' AS table_name, 'Row Count' AS statistic, format('{{:,}}', count(*)) AS text FROM customer
      UNION ALL SELECT 'orders', 'Row Count', format('{{:,}}', count(*)) FROM orders UNION ALL SELECT 'broken', 'Row Count', '0')"""
)
def r05_custom_statistics(spark, sf_dir):
    long = custom_report(custom_workload(spark, sf_dir), wide=False)["statistics_long"]
    return long.where("statistic = 'Row Count'").select("connection_name", "table_name", "statistic", "text")


@query(
    """SELECT metric, connection_name, text FROM (VALUES ('columnar'), ('striped')) c(connection_name),
      (SELECT 'Total Rows Loaded' AS metric,
        format('{:,}', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)) AS text)"""
)
def r06_custom_imports(spark, sf_dir):
    long = custom_report(custom_workload(spark, sf_dir), wide=False)["imports_long"]
    return long.where("metric = 'Total Rows Loaded'").select("metric", "connection_name", "text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the users who spent most: join, group and filter."""
    return q03_aggregate(spark, sf_dir)
