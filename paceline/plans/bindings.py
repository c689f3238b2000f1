"""The given star-schema tables seen as the data and measurement tables the operators read.

Every view covers its whole source table. The SQL of each view stands beside it: the checks read the same
rows through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import bytes_per_row, exact_sum, latency, rate, round2, size_mb

# A fixed day for generated orders and default values.
DAY = "2024-01-01"
# A query that takes longer than this counts as timed out.
TIMEOUT_MS = 90
# An error event longer than this fails its whole connection.
FATAL_MS = 200

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    email = F.concat(F.lit("user_"), F.col("c_custkey").cast("string"), F.lit("@benchmark.com"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email")
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the amount as it is stored, so that filters on it reach the scan."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def money_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a decimal amount."""
    return orders(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(10,2)"))


def _timings(spark: SparkSession, sf_dir: str, connection, query_name) -> DataFrame:
    ok = F.col("value") <= TIMEOUT_MS
    return table(spark, sf_dir, "events").select(
        connection.alias("connection_name"),
        F.col("event_id").alias("position"),
        query_name.alias("query_name"),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("category"),
        F.when(ok, F.col("value")).otherwise(0.0).alias("execution_time_ms"),
        ok.alias("success"),
        F.when(~ok, F.lit("timed out")).alias("error_message"),
    )


def _timings_sql(name: str, connection: str, query_name: str) -> str:
    return f"""
{name} AS (
  SELECT {connection} AS connection_name, event_id AS position, {query_name} AS query_name,
    CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS category,
    CASE WHEN value <= {TIMEOUT_MS} THEN value ELSE 0 END AS execution_time_ms,
    value <= {TIMEOUT_MS} AS success,
    CASE WHEN value <= {TIMEOUT_MS} THEN NULL ELSE 'timed out' END AS error_message
  FROM events)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as query timings: the event type is the connection, the user the query.

    Values beyond the timeout failed, and a failed query took 0 ms. Clicks carry no category.
    """
    return _timings(spark, sf_dir, F.col("event_type"), _number("query_", "user_id"))


TIMINGS_SQL = _timings_sql("timings", "event_type", "'query_' || user_id")


def user_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same timings with a connection per user, so that connections grow with the data."""
    return _timings(spark, sf_dir, _number("conn_", "user_id"), F.col("event_type"))


USER_TIMINGS_SQL = _timings_sql("user_timings", "'conn_' || user_id", "event_type")


def _loads(spark: SparkSession, sf_dir: str, connection, table_name) -> DataFrame:
    ok = F.col("o_orderstatus") != "F"
    thousands = F.dayofyear("o_orderdate").cast("bigint") * 1000
    return table(spark, sf_dir, "orders").select(
        connection.alias("connection_name"),
        F.col("o_orderkey").alias("position"),
        table_name.alias("table_name"),
        F.concat(table_name, F.lit(".csv")).alias("csv_file_name"),
        F.when(ok, thousands).otherwise(F.lit(0).cast("bigint")).alias("rows_loaded"),
        F.when(ok, F.col("o_totalprice")).otherwise(0.0).alias("load_time_ms"),
        ok.alias("success"),
        F.when(~ok, F.lit("load failed")).alias("error_message"),
    )


def _loads_sql(name: str, connection: str, table_name: str) -> str:
    return f"""
{name} AS (
  SELECT {connection} AS connection_name, o_orderkey AS position, {table_name} AS table_name,
    {table_name} || '.csv' AS csv_file_name,
    CASE WHEN o_orderstatus <> 'F' THEN CAST(dayofyear(o_orderdate) AS BIGINT) * 1000 ELSE 0 END AS rows_loaded,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END AS load_time_ms,
    o_orderstatus <> 'F' AS success,
    CASE WHEN o_orderstatus = 'F' THEN 'load failed' END AS error_message
  FROM orders)"""


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loads: the priority is the connection, the customer the table, status F a failure."""
    return _loads(spark, sf_dir, F.col("o_orderpriority"), _number("table_", "o_custkey"))


LOADS_SQL = _loads_sql("loads", "o_orderpriority", "'table_' || o_custkey")


def user_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same loads with a connection per customer."""
    return _loads(spark, sf_dir, _number("conn_", "o_custkey"), F.col("o_orderpriority"))


USER_LOADS_SQL = _loads_sql("user_loads", "'conn_' || o_custkey", "o_orderpriority")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom result per customer: accounts in debt failed, machinery ones without a message.

    Building customers carry a warning although they succeeded.
    """
    ok = F.col("c_acctbal") >= 0
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        _number("conn_", "c_custkey").alias("connection_name"),
        F.lower(segment).alias("db_type"),
        F.col("c_custkey").alias("position"),
        ok.alias("success"),
        F.when(~ok & (segment != "MACHINERY"), F.lit("account in debt"))
        .when(ok & (segment == "BUILDING"), F.lit("slow disk"))
        .alias("error"),
    )


RESULTS_SQL = """
results AS (
  SELECT 'conn_' || c_custkey AS connection_name, lower(c_mktsegment) AS db_type, c_custkey AS position,
    c_acctbal >= 0 AS success,
    CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'MACHINERY' THEN 'account in debt'
      WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN 'slow disk' END AS error
  FROM customer)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standard metric row per user, made from its events: rows are events, times are their values.

    A user with a fatal error event failed and has no metrics.
    """
    def of(kind: str):
        hit = F.when(F.col("event_type") == kind, F.col("value"))
        return round2(exact_sum(hit) / F.nullif(F.count(hit), F.lit(0)))

    failed = (F.col("event_type") == "error") & (F.col("value") > FATAL_MS)
    per_user = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.min("event_id").alias("position"),
            (~F.bool_or(failed)).alias("success"),
            F.count(F.lit(1)).alias("n"),
            exact_sum("value").alias("ms"),
            *[of(kind).alias(kind) for kind in EVENT_TYPES],
        )
    )
    ok = F.col("success")
    values = {
        "connection_time_ms": F.col("signup"),
        "schema_creation_time_ms": F.col("error"),
        "total_single_insert_time_ms": round2("ms"),
        "avg_single_insert_latency": round2(latency("ms", F.col("n") * 2)),
        "single_insert_rate": round2(rate(F.col("n") * 2, "ms")),
        "batch_insertion_time_ms": round2(F.col("ms") / 10),
        "batch_insertion_rate": round2(rate(F.col("n") * 2, F.col("ms") / 10)),
        "read_time_ms": F.col("view"),
        "join_time_ms": F.col("click"),
        "aggregate_time_ms": F.col("purchase"),
    }
    return per_user.select(
        _number("conn_", "user_id").alias("connection_name"),
        F.when(F.col("n") > 66, "parquet").otherwise("orc").alias("db_type"),
        "position",
        "success",
        *[F.when(ok, value).alias(name) for name, value in values.items()],
        F.when(~ok, F.lit("timed out")).alias("error"),
    )


def _mean_sql(kind: str) -> str:
    exact = f"CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type = '{kind}') AS DOUBLE)"
    return f"floor({exact} / count(*) FILTER (WHERE event_type = '{kind}') * 100 + 0.5) / 100 AS {kind}"


METRICS_SQL = f"""
per_user AS (
  SELECT user_id, min(event_id) AS position,
    NOT bool_or(event_type = 'error' AND value > {FATAL_MS}) AS success,
    count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS ms,
    {", ".join(_mean_sql(kind) for kind in EVENT_TYPES)}
  FROM events GROUP BY user_id),
metrics AS (
  SELECT 'conn_' || user_id AS connection_name, CASE WHEN n > 66 THEN 'parquet' ELSE 'orc' END AS db_type,
    position, success,
    CASE WHEN success THEN signup END AS connection_time_ms,
    CASE WHEN success THEN error END AS schema_creation_time_ms,
    CASE WHEN success THEN floor(ms * 100 + 0.5) / 100 END AS total_single_insert_time_ms,
    CASE WHEN success THEN floor(ms / (n * 2) * 100 + 0.5) / 100 END AS avg_single_insert_latency,
    CASE WHEN success THEN CASE WHEN ms > 0 THEN floor((n * 2) / (ms / 1000) * 100 + 0.5) / 100 ELSE 0 END END
      AS single_insert_rate,
    CASE WHEN success THEN floor(ms / 10 * 100 + 0.5) / 100 END AS batch_insertion_time_ms,
    CASE WHEN success THEN CASE WHEN ms > 0 THEN floor((n * 2) / (ms / 10 / 1000) * 100 + 0.5) / 100 ELSE 0 END END
      AS batch_insertion_rate,
    CASE WHEN success THEN view END AS read_time_ms,
    CASE WHEN success THEN click END AS join_time_ms,
    CASE WHEN success THEN purchase END AS aggregate_time_ms,
    CASE WHEN NOT success THEN 'timed out' END AS error
  FROM per_user)"""


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog entries: the brand is the schema, price and size give the lengths."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_schema"),
        _number("table_", "p_partkey").alias("table_name"),
        (F.floor(F.col("p_retailprice") * 100)).alias("data_length"),
        (F.col("p_size").cast("bigint") * 1024).alias("index_length"),
    )


CATALOG_SQL = """
catalog_tables AS (
  SELECT p_brand AS table_schema, 'table_' || p_partkey AS table_name,
    CAST(floor(p_retailprice * 100) AS BIGINT) AS data_length, CAST(p_size AS BIGINT) * 1024 AS index_length
  FROM part)"""


def storage_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as data parts: open lines are active."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("database"),
        _number("table_", "l_suppkey").alias("table"),
        (F.col("l_linestatus") == "O").alias("active"),
        (F.col("l_quantity").cast("bigint") * 1024).alias("bytes_on_disk"),
    )


STORAGE_PARTS_SQL = """
storage_parts AS (
  SELECT l_returnflag AS "database", 'table_' || l_suppkey AS "table", l_linestatus = 'O' AS active,
    CAST(l_quantity AS BIGINT) * 1024 AS bytes_on_disk
  FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as storage extents: finished lines belong to tables, open ones to indexes."""
    of_table = F.col("l_linestatus") == "F"
    index = F.concat(_number("IX_", "l_suppkey"), F.lit("_"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(of_table, _number("TABLE_", "l_suppkey")).otherwise(index).alias("segment_name"),
        F.when(of_table, "TABLE").otherwise("INDEX").alias("segment_type"),
        (F.col("l_quantity").cast("bigint") * 1024).alias("bytes"),
    )


def segment_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes among those extents, once per extent; returned lines (flag R) are extents no index is listed for."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R"))
    return lines.select(
        F.concat(_number("IX_", "l_suppkey"), F.lit("_"), F.col("l_returnflag")).alias("index_name"),
        _number("TABLE_", "l_suppkey").alias("table_name"),
    )


def segment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the tables to report: one per supplier."""
    return table(spark, sf_dir, "supplier").select(_number("table_", "s_suppkey").alias("table_name"))


SEGMENTS_SQL = """
segments AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'TABLE_' || l_suppkey
      ELSE 'IX_' || l_suppkey || '_' || l_returnflag END AS segment_name,
    CASE WHEN l_linestatus = 'F' THEN 'TABLE' ELSE 'INDEX' END AS segment_type,
    CAST(l_quantity AS BIGINT) * 1024 AS bytes
  FROM lineitem),
indexes AS (
  SELECT DISTINCT 'IX_' || l_suppkey || '_' || l_returnflag AS index_name, 'TABLE_' || l_suppkey AS table_name
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'),
wanted AS (SELECT 'table_' || s_suppkey AS table_name FROM supplier)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as column blocks: open lines are not stored yet and have no block."""
    return table(spark, sf_dir, "lineitem").select(
        _number("table_", "l_suppkey").alias("table_name"),
        F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).alias("block_id"),
    )


BLOCKS_SQL = """
blocks AS (
  SELECT 'table_' || l_suppkey AS table_name, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS block_id
  FROM lineitem)"""


def table_stats_rows(spark: SparkSession, sf_dir: str, by_supplier: bool = False) -> DataFrame:
    """Statistics of a table per supplier on a connection per return flag, from order lines; or the other way round."""
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_suppkey")
        .agg(
            F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
            F.count(F.lit(1)).alias("row_count"),
            (F.sum(F.col("l_quantity").cast("bigint")) * 1024).alias("data_size_bytes"),
            (F.sum(F.col("l_quantity").cast("bigint")) * 1536).alias("total_size_bytes"),
        )
    )
    flag = F.col("l_returnflag")
    connection, name = (_number("conn_", "l_suppkey"), flag) if by_supplier else (flag, _number("table_", "l_suppkey"))
    return totals.select(
        connection.alias("connection_name"),
        "position",
        name.alias("table_name"),
        "row_count",
        "data_size_bytes",
        "total_size_bytes",
        size_mb("total_size_bytes").alias("total_size_mb"),
        bytes_per_row("data_size_bytes", "row_count").alias("bytes_per_row"),
    )


TABLE_STATS_SQL = """
stats AS (
  SELECT l_returnflag AS connection_name, min(l_orderkey * 10 + l_linenumber) AS position,
    'table_' || l_suppkey AS table_name, count(*) AS row_count,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 1024 AS data_size_bytes,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 1536 AS total_size_bytes
  FROM lineitem GROUP BY l_returnflag, l_suppkey)"""


def config_docs(spark: SparkSession, sf_dir: str, mixed_case: bool = False) -> DataFrame:
    """A workload description per customer, with two connections, a table and two queries.

    With ``mixed_case`` the keys of the texts are in capitals, or have a capital at the start.
    """
    key, kind = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    dialect = kind
    if mixed_case:
        dialect = F.when(F.col("c_custkey") % 2 == 0, F.upper(kind)).otherwise(F.initcap(kind))

    def connection(name: str):
        return F.struct(
            F.concat(F.lit(name), key).alias("name"),
            kind.alias("dbType"),
            F.concat(F.lit("jdbc://host/db_"), key, F.lit("?ssl=true")).alias("url"),
            F.lit("user").alias("username"),
            F.lit("secret").alias("password"),
        )

    def query(name: str, category: str, text: str):
        sql = F.concat(F.lit(text), key)
        return F.struct(
            F.concat(F.lit(name), key).alias("name"),
            F.lit(category).alias("category"),
            F.create_map(dialect, sql, F.lit("spark"), sql).alias("queriesByDb"),
        )

    return table(spark, sf_dir, "customer").select(
        F.array(connection("main_"), connection("spare_")).alias("connectionDetails"),
        F.array(
            F.struct(
                F.concat(F.lit("table_"), key).alias("tableName"),
                F.concat(F.lit("file_"), key, F.lit(".csv")).alias("csvFileName"),
                F.create_map(dialect, F.concat(F.lit("CREATE TABLE table_"), key, F.lit(" (id INT)"))).alias("schemas"),
            )
        ).alias("tables"),
        F.array(
            query("read_", "SELECT", "SELECT * FROM orders WHERE o_custkey = "),
            query("count_", "", "SELECT count(*) FROM orders WHERE o_custkey = "),
        ).alias("queries"),
    )
