"""Query shapes and timed runs."""

from __future__ import annotations

import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paceline.operators import storage
from paceline.operators.queries import q_aggregate, q_count, q_filter, q_join, q_read
from paceline.plans import (
    custom_report,
    custom_run,
    read_query_sets,
    run_queries,
    runner,
    standard_report,
    standard_run,
    standard_schema,
    time_df,
)
from paceline.schemas import METRIC, QUERY_TIMING, TABLE_STATS
from paceline.session import scratch, scratch_path
from paceline.sources import apply_ddl, drop_table, read_config
from paceline.values import CUSTOM_LEADERS, METRIC_COLUMNS
from tests.conftest import as_list, as_set

DAY = dt.date(2024, 1, 1)
USERS = "id long, name string"
ORDERS = "id long, user_id long, amount decimal(10,2), order_date date"


def money(text):
    return Decimal(text)


@pytest.fixture
def shop(rows):
    users = rows([(1, "ann"), (2, "bob"), (3, "ann"), (4, "eve")], USERS)
    orders = rows(
        [
            (1, 1, money("50.00"), DAY),
            (2, 1, money("50.01"), DAY),
            (3, 2, money("10.00"), DAY),
            (4, 3, money("100.00"), DAY),
            (5, 3, money("0.01"), DAY),
            (6, 9, money("999.00"), DAY),
            (7, None, money("999.00"), DAY),
        ],
        ORDERS,
    )
    return users, orders


def test_join_bound_is_strict(shop):
    assert as_set(q_join(*shop, 50.0)) == {("ann", money("50.01"), DAY), ("ann", money("100.00"), DAY)}
    assert as_list(q_join(*shop, 0, limit=2, order_by=["id"])) == [
        ("ann", money("50.00"), DAY),
        ("ann", money("50.01"), DAY),
    ]


def test_equal_names_stay_apart(shop):
    assert as_list(q_aggregate(*shop, 10.0)) == [("ann", money("100.01"), 2)] * 2
    assert as_set(q_aggregate(*shop, 9.99)) == {("ann", money("100.01"), 2), ("bob", money("10.00"), 1)}


def test_users_listed_twice_count_twice_as_in_a_plain_join(rows, shop):
    users = shop[0].union(rows([(1, "ann"), (2, "rob")], USERS))
    plain = (
        users.join(shop[1].withColumnRenamed("id", "oid"), F.col("id") == F.col("user_id"))
        .groupBy("id", "name")
        .agg(F.sum("amount").alias("total_spent"), F.count("oid").alias("order_count"))
        .where("total_spent > 1")
    )
    assert sorted(as_list(q_aggregate(users, shop[1], 1))) == sorted(as_list(plain.drop("id")))


def test_a_user_with_a_third_of_all_orders(spark):
    n = 300_000
    orders = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000).alias("user_id"),
        F.lit("1.25").cast("decimal(10,2)").alias("amount"),
        F.lit(DAY).alias("order_date"),
    )
    users = spark.range(1000).select("id", F.format_string("u%d", "id").alias("name"))
    found = {r.name: (r.total_spent, r.order_count) for r in q_aggregate(users, orders, 0).collect()}
    counts = [0] * 1000
    for i in range(n):
        counts[1 if i % 3 == 0 else i % 1000] += 1
    assert found == {f"u{u}": (c * money("1.25"), c) for u, c in enumerate(counts) if c}


def test_scan_count_filter(shop):
    orders = shop[1]
    assert as_set(q_read(orders)) == as_set(orders)
    assert as_list(q_count(orders)) == [(7,)]
    assert as_list(q_count(orders.limit(0))) == [(0,)]
    assert q_filter(orders, "amount", 100).count() == 2


def test_aggregate_shuffles_orders_once(spark, shop):
    users, orders = shop
    plan = q_aggregate(F.broadcast(users), orders, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_time_df(spark):
    assert time_df(spark.range(10), 3) > 0


def test_queries_run_on_after_a_failure(spark, shop):
    shop[1].createOrReplaceTempView("shop_orders")
    queries = spark.createDataFrame(
        [
            (0, "count", "AGG", {"spark": "SELECT count(*) FROM shop_orders WHERE amount > :bound", "orc": "x"}),
            (1, "broken", None, {"spark": "SELEKT 1"}),
            (2, "missing", "SELECT", {"orc": "SELECT 1"}),
            (3, "fails", "SELECT", {"spark": "SELECT raise_error('no luck')"}),
            (4, "last", "SELECT", {"spark": "SELECT * FROM shop_orders;"}),
        ],
        "position int, name string, category string, queries_by_db map<string,string>",
    )
    report = run_queries(spark, queries, "SPARK", runs=2, connection="c", args={"bound": 10})
    assert report.schema == QUERY_TIMING
    found = report.orderBy("position").collect()
    assert [r.query_name for r in found] == ["count", "broken", "missing", "fails", "last"]
    assert [r.success for r in found] == [True, False, False, False, True]
    assert [r.execution_time_ms > 0 for r in found] == [True, False, False, False, True]
    assert found[0].error_message is None and found[0].category == "AGG"
    assert "PARSE_SYNTAX_ERROR" in found[1].error_message
    assert found[2].error_message == "No queries configuration found for database type: SPARK"
    assert "no luck" in found[3].error_message


def test_standard_run(spark):
    before = {d.name for d in spark.catalog.listDatabases()}
    run = standard_run(spark, [("p", "parquet"), ("m", "mysql"), ("o", "ORC")], rows=500, order_date=DAY, runs=2)
    assert run.metrics.schema.names == METRIC.names
    found = run.metrics.orderBy("position").collect()
    assert [(r.connection_name, r.db_type, r.success) for r in found] == [
        ("p", "parquet", True),
        ("m", "mysql", False),
        ("o", "ORC", True),
    ]
    assert found[1].error == "No queries configuration found for database type: mysql"
    assert all(found[1][c] is None for c in METRIC_COLUMNS)
    for row in (found[0], found[2]):
        for column in METRIC_COLUMNS:
            assert row[column] is None if "single" in column or "connection" in column else row[column] > 0
    assert run.stats.schema == TABLE_STATS
    assert {(r.connection_name, r.table_name, r.row_count) for r in run.stats.collect()} == {
        (c, t, 500) for c in "po" for t in ["benchmark_users", "benchmark_orders"]
    }
    assert {d.name for d in spark.catalog.listDatabases()} == before


def workload(tmp_path, connections):
    ddl = "CREATE TABLE employee (id INT, name VARCHAR(50), salary DECIMAL(10,2))"
    config = {
        "connectionDetails": [{"name": n, "dbType": t, "url": "u", "password": "secret"} for n, t in connections],
        "tables": [
            {"tableName": "employee", "csvFileName": "employee.csv", "schemas": {"parquet": ddl, "orc": ddl + " USING orc"}}
        ],
        "queries": [
            {
                "name": "Select High Earners",
                "category": "SELECT",
                "queriesByDb": {t: "SELECT * FROM employee WHERE salary > 50000" for t in ["parquet", "orc"]},
            },
            {"name": "Only parquet", "queriesByDb": {"parquet": "SELECT count(*) FROM employee"}},
        ],
    }
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    return str(path)


def test_connections_share_the_count_of_a_file(spark, tmp_path, monkeypatch):
    from paceline.plans import runner

    reads, plain = [], runner.read_csv
    monkeypatch.setattr(runner, "read_csv", lambda session, path, *rest: reads.append(path) or plain(session, path, *rest))
    (tmp_path / "employee.csv").write_text("id,name,salary\n1,b,60000.50\n2,c,\n")
    config = read_config(spark, workload(tmp_path, [("p", "parquet"), ("o", "orc"), ("q", "parquet")]))
    run = custom_run(spark, config, {"employee.csv": str(tmp_path / "employee.csv")}, threshold=5, runs=1)
    assert {(r.connection_name, r.rows_loaded, r.success) for r in run.loads.collect()} == {(c, 6, True) for c in "poq"}
    # Once to count, and once for each load.
    assert len(reads) == 4


@pytest.mark.parametrize("threshold,join", [(1, "BroadcastHashJoin"), (2_000, "BroadcastHashJoin"), (800_000, "SortMergeJoin")])
def test_copies_are_broadcast_by_their_rows_not_by_their_files(spark, tmp_path, monkeypatch, threshold, join):
    plans = []

    def timed(df, runs):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])
        return 1.0

    monkeypatch.setattr(runner, "time_df", timed)
    (tmp_path / "employee.csv").write_text("id,name,salary\n" + "".join(f"{i},n{i},1\n" for i in range(1, 1001)))
    path = workload(tmp_path, [("p", "parquet"), ("o", "orc")])
    config = json.loads((tmp_path / "config.json").read_text())
    text = "SELECT a.name, b.salary FROM employee a JOIN employee b ON a.id = -b.id"
    config["queries"] = [{"name": "None", "queriesByDb": {"parquet": text, "orc": text}}]
    (tmp_path / "config.json").write_text(json.dumps(config))
    run = custom_run(spark, read_config(spark, path), {"employee.csv": str(tmp_path / "employee.csv")}, threshold=threshold, runs=1)
    assert {(r.rows_loaded, r.success) for r in run.loads.collect()} == {(max(threshold, 1000), True)}
    # All copies take less than a broadcast may in files.
    assert all(0 < r.total_size_bytes < 10 << 20 for r in run.stats.collect())
    assert len(plans) == 2 and all(join in plan for plan in plans)


@pytest.mark.parametrize("threshold,rows", [(0, 3), (100, 102)])
def test_custom_run(spark, tmp_path, threshold, rows):
    (tmp_path / "employee.csv").write_text('id,name,salary\n1,"b, a",60000.50\n2,c,\n3,d,1000\n')
    config = read_config(spark, workload(tmp_path, [("p", "parquet"), ("c", "csv"), ("x", "oraclesql"), ("o", "orc")]))
    files = {"employee.csv": str(tmp_path / "employee.csv")}
    run = custom_run(spark, config, files, threshold=threshold, trials=2, runs=1)
    results = run.results.orderBy("position").collect()
    assert [(r.connection_name, r.success) for r in results] == [("p", True), ("c", False), ("x", False), ("o", True)]
    assert results[1].error == "No schema for table employee and database type: csv"
    assert results[2].error == "CSV import is not supported for database type: oraclesql"
    loads = {(r.connection_name, r.table_name, r.rows_loaded, r.success) for r in run.loads.collect()}
    assert loads == {("p", "employee", rows, True), ("o", "employee", rows, True)}
    timings = {(r.connection_name, r.query_name, r.category, r.success) for r in run.timings.collect()}
    assert timings == {
        ("p", "Select High Earners", "SELECT", True),
        ("p", "Only parquet", None, True),
        ("o", "Select High Earners", "SELECT", True),
        ("o", "Only parquet", None, False),
    }
    assert {(r.connection_name, r.row_count) for r in run.stats.collect()} == {("p", rows), ("o", rows)}
    assert {(r.connection_name, r.tables_imported, r.total_rows_loaded) for r in run.imports.collect()} == {
        ("p", 1, rows),
        ("o", 1, rows),
    }
    for frame in run:
        assert "secret" not in str(frame.collect())


def test_custom_run_with_a_bad_file_still_reports(spark, tmp_path):
    (tmp_path / "employee.csv").write_text("id,name,salary\nx,a,1\n")
    config = read_config(spark, workload(tmp_path, [("p", "parquet")]))
    run = custom_run(spark, config, {"employee.csv": str(tmp_path / "employee.csv")}, trials=2, runs=1)
    load = run.loads.first()
    assert (load.rows_loaded, load.success) == (0, False) and 'For input string: "x"' in load.error_message
    assert run.results.first().success
    stats = run.stats.first()
    assert (stats.table_name, stats.row_count, stats.data_size_bytes, stats.bytes_per_row) == ("employee", 0, 0, 0.0)


def test_custom_run_names_missing_files(spark, tmp_path):
    config = read_config(spark, workload(tmp_path, [("p", "parquet")]))
    with pytest.raises(ValueError, match="employee.csv not uploaded"):
        custom_run(spark, config, {"other.csv": "x"})


JOINED = "FROM benchmark_users u, benchmark_orders o WHERE u.id = o.user_id"


def test_standard_run_with_query_sets_from_a_file(spark, tmp_path):
    own = {
        "schema": standard_schema("parquet"),
        "read": "SELECT id FROM benchmark_users",
        "join": f"SELECT name, amount {JOINED} AND amount > ?",
        "aggregate": f"SELECT max(name), sum(amount) AS s {JOINED} GROUP BY u.id HAVING s > ?",
        "insertUser": "unused",
    }
    (tmp_path / "sets.json").write_text(json.dumps({"Parquet": own, "json": {**own, "join": "SELEKT"}}, indent=1))
    sets = read_query_sets(spark, str(tmp_path / "sets.json"))
    assert sorted(sets) == ["Parquet", "json"] and sets["Parquet"].read == "SELECT id FROM benchmark_users"
    assert list(read_query_sets(spark, str(tmp_path / "sets.json"), ["PARQUET", "orc"])) == ["Parquet"]
    run = standard_run(spark, [("p", "PARQUET"), ("o", "orc"), ("j", "json")], 60, DAY, runs=1, query_sets=sets)
    found = run.metrics.orderBy("position").collect()
    assert [r.success for r in found] == [True, False, False]
    assert found[1].error == "No queries configuration found for database type: orc"
    assert "PARSE_SYNTAX_ERROR" in found[2].error
    report = standard_report(run)
    assert {r.connection_name for r in report["failures"].collect()} == {"o", "j"}
    assert {r.metric for r in report["leaders"].collect()} == {"batch_insertion_rate", "read_time_ms"}
    assert report["comparison"].count() == 3 and report["chart"].count() == 1
    grid = report["statistics"].where("statistic = 'Row Count'").select("p", "o", "j")
    assert as_list(grid) == [("60", "-", "-"), ("60", "-", "-")]
    assert "statistics" not in standard_report(run, wide=False)


def test_standard_tables_hold_the_generated_rows(spark):
    apply_ddl(spark, standard_schema("parquet"))
    try:
        runner._insert(spark, runner.generated(1000, DAY))
        users, orders = spark.table("benchmark_users"), spark.table("benchmark_orders")
        assert users.where("created_at is null").count() == 0
        work = runner._work("parquet", None, None)
        assert work.read(spark).count() == 1000
        assert work.join(spark).count() == 100
        assert q_join(users, orders, 50.0, limit=None).count() == 959
        assert work.aggregate(spark).count() == 999
    finally:
        drop_table(spark, "benchmark_users")
        drop_table(spark, "benchmark_orders")


def test_amounts_can_be_wider(spark):
    run = standard_run(spark, [("p", "parquet")], 100, DAY, runs=1, amount_type="decimal(18,2)")
    assert run.metrics.first().success
    assert "amount decimal(18,2)" in standard_schema("orc", "decimal(18,2)")[3]


def test_dialects_in_any_case(spark, tmp_path):
    (tmp_path / "employee.csv").write_text("id,name,salary\n1,b,60000.50\n")
    text = (tmp_path / "in.json", workload(tmp_path, [("p", "Parquet"), ("o", "ORC")]))[1]
    mixed = open(text).read().replace('"parquet":', '"Parquet":').replace('"orc":', '"oRc":')
    (tmp_path / "mixed.json").write_text(mixed)
    config = read_config(spark, str(tmp_path / "mixed.json"))
    run = custom_run(spark, config, {"employee.csv": str(tmp_path / "employee.csv")}, threshold=1, runs=1)
    assert [(r.success, r.error) for r in run.results.collect()] == [(True, None)] * 2
    assert run.timings.where("success").count() == 3


def test_workload_without_tables(spark, tmp_path):
    config = {
        "connectionDetails": [{"name": "p", "dbType": "parquet"}],
        "tables": [],
        "queries": [{"name": "one", "queriesByDb": {"parquet": "SELECT 1"}}],
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    run = custom_run(spark, read_config(spark, str(tmp_path / "config.json")), {}, runs=1)
    assert [tuple(r) for r in run.results.collect()] == [("p", "parquet", 0, True, None)]
    assert run.timings.first().success and run.stats.collect() == []
    assert [tuple(r) for r in run.imports.collect()] == [("p", 0, 0, 0.0, 0.0, 0.0, False)]
    report = custom_report(run)
    assert [r.p for r in report["imports"].collect()] == ["0", "0.00 ms", "0.00 ms", "0.00 rows/s"]


def test_connections_of_one_name_stay_apart(spark, tmp_path):
    (tmp_path / "employee.csv").write_text("id,name,salary\n1,b,60000.50\n")
    config = read_config(spark, workload(tmp_path, [("p", "parquet"), ("p", "orc"), ("p (2)", "parquet")]))
    run = custom_run(spark, config, {"employee.csv": str(tmp_path / "employee.csv")}, threshold=3, runs=1)
    assert [r.connection_name for r in run.results.orderBy("position").collect()] == ["p", "p (3)", "p (2)"]
    assert {(r.connection_name, r.total_rows_loaded) for r in run.imports.collect()} == {("p", 3), ("p (2)", 3), ("p (3)", 3)}


def test_a_failing_close_does_not_end_the_run(spark, monkeypatch):
    close, calls = runner._close, []

    def failing(place):
        close(place)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("cannot drop")

    monkeypatch.setattr(runner, "_close", failing)
    run = standard_run(spark, [("a", "parquet"), ("b", "parquet")], 50, DAY, runs=1)
    found = run.metrics.orderBy("position").collect()
    assert [(r.success, r.error) for r in found] == [(True, "cannot drop"), (True, None)]


def test_tables_of_a_run_are_in_the_shared_folder(spark, monkeypatch):
    seen, measure = [], runner._measure

    def watched(place, *args):
        out = measure(place, *args)
        location = storage.table_location(place.session, "benchmark_users")[0]
        seen.append((location, place.folder))
        return out

    monkeypatch.setattr(runner, "_measure", watched)
    standard_run(spark, [("a", "parquet")], 20, DAY, runs=1)
    ((location, folder),) = seen
    root = spark.conf.get("spark.checkpoint.dir")
    assert folder.startswith(root) and folder in location
    assert not os.path.exists(folder)


def test_a_run_on_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    def refused(spark, name):
        raise ValueError("set spark.checkpoint.dir")

    monkeypatch.setattr(runner, "scratch_path", refused)
    found = standard_run(spark, [("a", "parquet")], 20, DAY, runs=1).metrics.first()
    assert not found.success and "spark.checkpoint.dir" in found.error


def test_scratch_folders_are_released(spark):
    with scratch(spark):
        path = scratch_path(spark, "some")
        spark.range(3).write.parquet(path)
        kept = path.removeprefix("file:")
        assert os.path.exists(kept)
    assert not os.path.exists(kept)


def test_custom_report(spark, tmp_path):
    (tmp_path / "employee.csv").write_text("id,name,salary\n1,b,60000.50\n")
    config = read_config(spark, workload(tmp_path, [("p", "parquet"), ("x", "db2"), ("o", "orc")]))
    run = custom_run(spark, config, {"employee.csv": str(tmp_path / "employee.csv")}, threshold=5, runs=1)
    report = {name: frame.collect() for name, frame in custom_report(run).items()}
    assert {r.metric for r in report["leaders"]} == set(CUSTOM_LEADERS)
    assert {r.metric: (r.p, r.x, r.o) for r in report["imports"]}["Total Rows Loaded"] == ("5", "-", "5")
    assert report["loads"][0].p.endswith("(5 rows)") and report["loads"][0].x == "-"
    assert [(r.query_name, r.category, r.x, r.o == "Error") for r in report["queries"]] == [
        ("Select High Earners", "SELECT", "-", False),
        ("Only parquet", "QUERY", "-", True),
    ]
    assert [r.connection_name for r in report["import_chart"]] == ["p", "o"]
    assert set(report["load_chart"][0].asDict()) == {"table_name", "position", "p", "o"}
    assert report["query_chart"][1].o == 0.0
    assert [(r.connection_name, r.error) for r in report["failures"]] == [("x", "Unsupported database type: db2")]
    assert len(report["statistics"]) == 5
