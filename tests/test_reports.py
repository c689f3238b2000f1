"""Storage, measurement and comparison operators."""

from __future__ import annotations

import math
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceline.functions import bytes_per_row, db_name, exact_sum, latency, rate, round2, size_mb
from paceline.operators import compare, measures, storage
from paceline.schemas import LOAD, METRIC, QUERY_TIMING, RESULT, TABLE_STATS
from paceline.values import CHARTED, METRIC_COLUMNS, NO_MESSAGE
from tests.conftest import as_list, as_set

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
INF = float("inf")


def test_round2(spark):
    values = [1.005, 2.675, 0.125, -0.125, 10.0, 0.0, 1234.567, 99999999.995]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round2("x").alias("y"))
    assert as_list(df) == [(v, math.floor(v * 100 + 0.5) / 100) for v in values]


def test_rates_guard_against_zero(rows):
    df = rows([(100, 50.0), (100, 0.0), (0, 50.0), (0, 0.0)], "n long, ms double")
    found = df.select(rate("n", "ms"), latency("ms", F.col("n") * 2), bytes_per_row("ms", "n"))
    assert as_list(found) == [(2000.0, 0.25, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_size_and_database(rows):
    urls = ["jdbc:mysql://h:3306/db?ssl=a/b?c", "jdbc:duckdb:./x.db", "jdbc:oracle:thin:@h:1521:xe", "", "h/", "?x/y"]
    df = rows([(u,) for u in urls], "url string").select(db_name("url"))
    assert as_list(df) == [("db",), ("x.db",), ("jdbc:oracle:thin:@h:1521:xe",), ("",), ("",), ("",)]
    assert as_list(rows([(1572864,), (0,)], "n long").select(size_mb("n"))) == [(1.5,), (0.0,)]


def test_sum_does_not_depend_on_the_order(spark):
    values = [random.Random(3).uniform(0, 1e6) for _ in range(5000)]
    df = spark.createDataFrame([(round(v, 6),) for v in values], "ms double")
    sums = {df.repartition(n).agg(exact_sum("ms")).first()[0] for n in (1, 3, 16)}
    assert len(sums) == 1
    assert sums.pop() == pytest.approx(math.fsum(values), rel=1e-12)
    assert df.limit(0).agg(exact_sum("ms")).first()[0] is None
    huge = spark.createDataFrame([(9.0e12,), (9.0e12,), (0.25,)], "ms double")
    assert huge.agg(exact_sum("ms")).first()[0] == 1.8e13 + 0.25


# --- storage -------------------------------------------------------------------------------------


def test_table_stats(spark, tmp_path):
    paths = {}
    for name, n in {"big": 1000, "empty": 0}.items():
        paths[name] = str(tmp_path / name)
        spark.range(n).repartition(3).write.parquet(paths[name])

    def size(path, keep=lambda n: True):
        return sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))

    found = {r.table_name: r for r in storage.table_stats(spark, paths).collect()}
    big, total = found["big"], size(paths["big"])
    assert (big.position, big.row_count, big.data_size_bytes, big.total_size_bytes) == (0, 1000, total, total)
    assert big.bytes_per_row == total / 1000
    empty = found["empty"]
    assert (empty.row_count, empty.data_size_bytes, empty.bytes_per_row) == (0, 0, 0.0)
    assert empty.total_size_bytes == size(paths["empty"])


def test_table_stats_of_a_catalog_table(spark):
    spark.sql("CREATE TABLE measured (id INT) USING orc")
    try:
        nothing = storage.table_stats(spark, {"measured": "measured"}).first()
        assert (nothing.row_count, nothing.data_size_bytes, nothing.total_size_mb) == (0, 0, 0.0)
        spark.range(10).selectExpr("cast(id as int)").write.insertInto("measured")
        assert storage.table_stats(spark, {"measured": "measured"}).first().row_count == 10
    finally:
        spark.sql("DROP TABLE measured")


def test_footprint_keeps_unlisted_tables(rows):
    tables = rows([("a",), ("b",), ("c",)], "table_name string")
    counts = rows([("a", 4), ("b", 0)], "table_name string, row_count long")
    sizes = rows([("a", 10, 12), ("b", 5, 5)], "table_name string, data_size_bytes long, total_size_bytes long")
    assert as_set(storage.footprint(tables, counts, sizes)) == {
        ("a", 4, 10, 12, 0.0, 2.5),
        ("b", 0, 5, 5, 0.0, 0.0),
        ("c", 0, None, None, None, None),
    }


def test_catalog_listings(rows):
    catalog = rows(
        [("s", "t", 10, 2), ("s", "u", 1, 0), ("r", "t", 5, 5)],
        "table_schema string, table_name string, data_length long, index_length long",
    )
    assert as_set(storage.sum_segments(catalog, "s", "t")) == {("s", "t", 10, 2, 12)}
    assert storage.sum_segments(catalog).count() == 3
    parts = rows(
        [("d", "t", True, 5), ("d", "t", True, 7), ("d", "t", False, 100), ("d", "old", False, 9)],
        "database string, table string, active boolean, bytes_on_disk long",
    )
    assert as_set(storage.active_parts_size(parts)) == {("d", "t", 12, 12), ("d", "old", 0, 0)}
    blocks = rows([("t", 1), ("t", 1), ("t", 2), ("t", None), ("u", None)], "table_name string, block_id long")
    assert as_set(storage.block_sizes(blocks, 1 << 20)) == {("t", 2 << 20, 2.0), ("u", 0, 0.0)}


def test_segments(rows):
    segments = rows(
        [("T", "TABLE", 10), ("T", "TABLE", 5), ("I1", "INDEX", 3), ("I2", "INDEX", 4), ("L", "LOB", 50), ("U", "INDEX", 9)],
        "segment_name string, segment_type string, bytes long",
    )
    indexes = rows([("I1", "T"), ("I1", "T"), ("I2", "T"), ("GONE", "T"), ("L", "V")], "index_name string, table_name string")
    tables = rows([("t",), ("u",), ("v",), ("none",), ("t",)], "table_name string")
    sizes = storage.segment_sizes(segments, indexes, tables)
    assert as_set(sizes) == {("t", 15, 22), ("u", 0, 9), ("v", 0, 50), ("none", 0, 0)}


def test_no_tables_have_no_statistics(spark):
    assert storage.table_stats(spark, {}).collect() == []


def test_table_stats_plan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    plan = storage.table_stats(spark, {"t": path, "u": path})._jdf.queryExecution().executedPlan().toString()
    assert "file_path" not in plan and "binaryFile" not in plan and "Exchange hashpartitioning" not in plan


# --- measurements --------------------------------------------------------------------------------


def loads_of(rows, data):
    return rows([(c, p, t, f"{t}.csv", n, ms, ok, e) for c, p, t, n, ms, ok, e in data], LOAD)


def timings_of(rows, data):
    return rows([(c, p, q, k, ms, ok, None if ok else "bad") for c, p, q, k, ms, ok in data], QUERY_TIMING)


def test_mean_runs(rows):
    df = rows([("a", 1.0), ("a", 2.005), ("b", 3.0)], "name string, execution_time_ms double")
    assert as_set(measures.mean_runs(df, ["name"])) == {("a", 2, 1.5), ("b", 1, 3.0)}


def test_failed_loads_count_as_tables(rows):
    loads = loads_of(
        rows,
        [
            ("a", 0, "t", 1000, 100.0, True, None),
            ("a", 1, "u", 0, 0.0, False, "bad"),
            ("b", 0, "t", 0, 0.0, False, "bad"),
        ],
    )
    assert as_set(measures.import_metrics(loads)) == {
        ("a", 2, 1000, 100.0, 50.0, 10000.0, True),
        ("b", 1, 0, 0.0, 0.0, 0.0, False),
    }
    assert measures.import_metrics(loads.limit(0)).count() == 0


def test_query_time_without_success_is_infinite(rows):
    timings = timings_of(
        rows, [("a", 0, "q", "S", 10.0, True), ("a", 1, "r", "S", 0.0, False), ("a", 2, "s", "S", 5.0, True), ("b", 0, "q", "S", 0.0, False)]
    )
    assert as_set(measures.avg_query_time(timings)) == {("a", 7.5, "7.50"), ("b", INF, "N/A")}


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=12))
def test_first_row_wins_a_tie(spark, data):
    values = [(f"c{i}", i, ok, float(v) if v else None) for i, (v, ok) in enumerate(data)]
    df = spark.createDataFrame(values, "connection_name string, position int, success boolean, m double").repartition(4)
    competing = [r for r in values if r[2] and r[3] is not None]
    for lower in (True, False):
        best = min(competing, key=lambda r: (r[3] if lower else -r[3], r[1]), default=None)
        expected = [("m", best[0], best[3])] if best else []
        assert as_list(measures.leader(df, "m", lower)) == expected


def metric_row(name, position, ok=True, **values):
    return (name, "parquet", position, ok, *[values.get(c) for c in METRIC_COLUMNS], None if ok else "down")


@pytest.fixture
def metrics(spark):
    data = [
        metric_row("a", 0, connection_time_ms=5.0, batch_insertion_rate=10.0, avg_single_insert_latency=2.0, read_time_ms=3.0),
        metric_row("b", 1, connection_time_ms=5.0, batch_insertion_rate=1234567.5, avg_single_insert_latency=1.0, read_time_ms=3.0),
        metric_row("c", 2, ok=False),
    ]
    return spark.createDataFrame(data, METRIC)


def test_standard_leaders(metrics):
    assert as_set(measures.standard_leaders(metrics)) == {
        ("connection_time_ms", "a", 5.0, "parquet"),
        ("batch_insertion_rate", "b", 1234567.5, "parquet"),
        ("avg_single_insert_latency", "b", 1.0, "parquet"),
        ("read_time_ms", "a", 3.0, "parquet"),
    }
    assert measures.standard_leaders(metrics.where("not success")).count() == 0


def test_custom_leaders(rows):
    results = rows([("a", "x", 0, True, None), ("b", "x", 1, True, None), ("c", "x", 2, False, "down"), ("d", "x", 3, True, None)], RESULT)
    imports = measures.import_metrics(
        loads_of(
            rows,
            [
                ("a", 0, "t", 0, 0.0, False, "bad"),
                ("b", 0, "t", 100, 50.0, True, None),
                ("c", 0, "t", 100, 1.0, True, None),
                ("d", 0, "t", 100, 50.0, True, None),
            ],
        )
    )
    times = measures.avg_query_time(timings_of(rows, [("b", 0, "q", "S", 9.0, True), ("a", 0, "q", "S", 0.0, False)]))
    assert as_set(measures.custom_leaders(results, imports, times)) == {
        ("total_import_time_ms", "b", 50.0, "x"),
        ("csv_import_rate", "b", 2000.0, "x"),
        ("average_table_import_time_ms", "b", 50.0, "x"),
        ("avg_query_time_ms", "b", 9.0, "x"),
    }
    loose = {r.metric: r.connection_name for r in measures.custom_leaders(results, imports, times, strict=False).collect()}
    assert loose == {
        "total_import_time_ms": "a",
        "csv_import_rate": "b",
        "average_table_import_time_ms": "a",
        "avg_query_time_ms": "b",
    }
    nobody = measures.custom_leaders(results, imports, times.where("connection_name = 'a'"))
    assert {r.metric: r.connection_name for r in nobody.collect()}["avg_query_time_ms"] == "a"


# --- comparison ----------------------------------------------------------------------------------


@pytest.fixture
def loads(rows):
    return loads_of(
        rows,
        [
            ("a", 0, "t", 1234567, 12.5, True, None),
            ("a", 1, "u", 0, 0.0, False, "bad"),
            ("b", 2, "v", 7, 3.0, True, None),
            ("b", 3, "t", 8, 4.25, True, None),
            ("a", 4, "t", 1, 99.0, True, None),
            ("z", 5, "w", 1, 1.0, True, None),
        ],
    )


@pytest.fixture
def two(loads):
    return loads.where("connection_name <> 'z'")


def test_pivot(loads, two):
    assert as_set(compare.pivot_loads(two, ["a", "b"])) == {("t", 0, 12.5, 4.25), ("u", 1, 0.0, 0.0), ("v", 2, 0.0, 3.0)}
    assert compare.pivot_loads(loads, ["b", "a.b`c"]).columns == ["table_name", "position", "b", "a.b`c"]


def test_no_connection_is_left_out(loads, rows):
    for wide in (compare.pivot_loads, compare.load_grid):
        with pytest.raises(Exception, match="connection without a column, use the long form: z"):
            wide(loads, ["a", "b"]).collect()
    assert as_set(compare.loads_long(loads).where("connection_name = 'z'")) == {("w", "z", 5, 1.0, "1.00 ms (1 rows)")}
    nameless = loads_of(rows, [(None, 0, "t", 1, 1.0, True, None)])
    with pytest.raises(Exception, match="NULL"):
        compare.pivot_loads(nameless, ["a"]).collect()


@pytest.mark.parametrize("name", ["position", "Table_Name", "a"])
def test_names_that_cannot_be_columns_are_refused(two, name):
    with pytest.raises(ValueError, match=name):
        compare.pivot_loads(two, ["a", name])
    with pytest.raises(ValueError, match="statistic"):
        compare.stats_grid(two, ["Statistic"])


def test_long_form_is_the_wide_one(two, rows):
    wide = {r.table_name: r for r in compare.load_grid(two, ["a", "b"]).collect()}
    long = {(r.table_name, r.connection_name): r for r in compare.loads_long(two).collect()}
    for table, row in wide.items():
        for c in ("a", "b"):
            assert row[c] == (long[table, c].shown if (table, c) in long else "-")
    timings = timings_of(rows, [("a", 0, "q", "", 1234.5, True), ("b", 1, "q", "SELECT", 0.0, False)])
    assert as_set(compare.queries_long(timings)) == {("q", "a", 0, "QUERY", 1234.5, "1234.50 ms"), ("q", "b", 1, "QUERY", 0.0, "Error")}


def test_more_connections_than_a_page_holds(spark):
    data = [(f"c{i}", i, "t", "t.csv", 10, float(i), True, None) for i in range(501)]
    loads = spark.createDataFrame(data, LOAD)
    names = compare.connection_list(loads)
    assert names == [f"c{i}" for i in range(501)]
    (row,) = compare.pivot_loads(loads, names).collect()
    assert [row[c] for c in names] == [float(i) for i in range(501)]
    assert compare.loads_long(loads).count() == 501


def test_load_grid(two):
    assert as_set(compare.load_grid(two, ["a", "b"])) == {
        ("t", 0, "12.50 ms (1,234,567 rows)", "4.25 ms (8 rows)"),
        ("u", 1, "Error", "-"),
        ("v", 2, "-", "3.00 ms (7 rows)"),
    }


def test_query_tables(rows):
    timings = timings_of(
        rows,
        [("a", 0, "q", "", 1.0, True), ("b", 1, "q", "SELECT", 2.0, True), ("a", 2, "r", "JOIN", 0.0, False), ("b", 3, "s", None, 4.0, True)],
    )
    assert as_set(compare.category_of(timings)) == {("q", "QUERY"), ("r", "JOIN"), ("s", "QUERY")}
    assert as_set(compare.pivot_queries(timings, ["a", "b"])) == {("q", 0, 1.0, 2.0), ("r", 2, 0.0, 0.0), ("s", 3, 0.0, 4.0)}
    grid = compare.query_grid(timings, ["a", "b"]).select("query_name", "category", "a", "b")
    assert as_set(grid) == {("q", "QUERY", "1.00 ms", "2.00 ms"), ("r", "JOIN", "Error", "-"), ("s", "QUERY", "-", "4.00 ms")}


@FEW
@given(st.dictionaries(st.tuples(st.sampled_from("tuv"), st.sampled_from("abc")), st.integers(1, 99), max_size=9))
def test_pivot_and_back(spark, cells):
    data = [(c, i, t, f"{t}.csv", 1, float(ms), True, None) for i, ((t, c), ms) in enumerate(cells.items())]
    wide = compare.pivot_loads(spark.createDataFrame(data, LOAD), ["a", "b", "c"])
    back = wide.unpivot(["table_name"], ["a", "b", "c"], "connection", "ms").where("ms > 0")
    assert as_set(back) == {(t, c, float(ms)) for (t, c), ms in cells.items()}


def test_names_and_connections(loads):
    assert as_list(compare.names_in_order(loads, "table_name")) == [("t", 0), ("u", 1), ("v", 2), ("w", 5)]
    assert compare.connection_list(loads) == ["a", "b", "z"]


def test_failures(rows):
    results = rows(
        [("a", "x", 0, True, None), ("b", "x", 1, False, "down"), ("c", "x", 2, False, ""), ("d", "x", 3, True, "slow"), ("e", "x", 4, None, None)],
        RESULT,
    )
    assert as_set(compare.failures(results)) == {("b", "down"), ("c", None), ("e", None)}
    assert as_set(compare.failures(results, custom=True)) == {
        ("b", "down"),
        ("c", NO_MESSAGE),
        ("d", "slow"),
        ("e", NO_MESSAGE),
    }
    assert as_set(compare.successful(results).select("connection_name")) == {("a",), ("d",)}


def test_union_fills_missing_columns(rows):
    both = compare.union_results([rows([(1, "a")], "n int, x string"), rows([(2, True)], "n int, y boolean")])
    assert as_set(both) == {(1, "a", None), (2, None, True)}


def test_stats_grid(rows):
    stats = rows(
        [("a", 0, "t", 1234, 5000, 6000, 0.01, 4.051863857374392), ("b", 0, "t", 0, 0, 0, 0.0, 0.0), ("b", 1, "u", 1, None, None, None, 1234567.891)],
        TABLE_STATS,
    )
    found = compare.stats_grid(stats, ["a", "b"]).orderBy("table_name", "line").drop("position")
    assert as_list(found) == [
        ("t", 0, "Row Count", "1,234", "0"),
        ("t", 1, "Data Size (Bytes)", "5,000 Bytes", "0 Bytes"),
        ("t", 2, "Total Size (Bytes)", "6,000 Bytes", "0 Bytes"),
        ("t", 3, "Total Size (MB)", "0.01 MB", "0.00 MB"),
        ("t", 4, "Avg Bytes / Row", "4.05 Bytes", "0.00 Bytes"),
        ("u", 0, "Row Count", "-", "1"),
        ("u", 1, "Data Size (Bytes)", "-", "-"),
        ("u", 2, "Total Size (Bytes)", "-", "-"),
        ("u", 3, "Total Size (MB)", "-", "-"),
        ("u", 4, "Avg Bytes / Row", "-", "1234567.89 Bytes"),
    ]
    long = {(r.table_name, r.line, r.connection_name): r.text for r in compare.stats_long(stats).collect()}
    assert long == {(r.table_name, r.line, c): r[c] for r in found.collect() for c in "ab" if (r.table_name, c) != ("u", "a")}


def test_comparison_and_charts(metrics, rows):
    found = {r.connection_name: r for r in compare.comparison(metrics).collect()}
    assert (found["b"].status, found["b"].batch_insertion_rate, found["b"].read_time_ms) == ("OK", "1,234,567.50 rows/s", "3.00 ms")
    slow = compare.comparison(metrics.withColumn("read_time_ms", F.lit(1234.5))).first()
    assert slow.read_time_ms == "1234.50 ms"
    assert found["b"].join_time_ms == "-"
    assert found["c"].status == "Error" and all(found["c"][c] == "-" for c in METRIC_COLUMNS)
    chart = {r.connection_name: r for r in compare.chart_overall(metrics).collect()}
    assert set(chart) == {"a", "b"} and chart["a"].join_time_ms == 0.0 and chart["a"].read_time_ms == 3.0
    assert len(CHARTED) == 7


def test_import_tables(rows, loads):
    results = rows([("a", "x", 0, True, None), ("b", "x", 1, False, "down"), ("q", "x", 2, True, None)], RESULT)
    imports = measures.import_metrics(loads)
    assert as_set(compare.chart_imports(results, imports)) == {
        ("a", "x", 0, round(1234568 / 0.1115, 2), 111.5),
        ("q", "x", 2, 0.0, 0.0),
    }
    twice = results.union(results)
    grid = {r.metric: (r.a, r.b, r.q) for r in compare.import_grid(twice, imports, ["a", "b", "q"]).collect()}
    assert grid == {
        "Total Rows Loaded": ("1,234,568", "-", "0"),
        "Total Import Time (ms)": ("111.50 ms", "-", "0.00 ms"),
        "Average Table Import (ms)": ("37.17 ms", "-", "0.00 ms"),
        "CSV Import Rate (rows/s)": ("11,072,358.74 rows/s", "-", "0.00 rows/s"),
    }
    assert ("q", 0, 0, 0.0, 0.0, 0.0, False) in as_set(measures.import_metrics(loads, results))


def test_one_connection_with_a_third_of_all_rows(spark):
    n = 300_000
    loads = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("c%d", F.col("id") % 50)).alias("connection_name"),
        F.col("id").alias("position"),
        F.format_string("t%d", F.col("id") % 7).alias("table_name"),
        F.lit(10).cast("bigint").alias("rows_loaded"),
        (F.col("id") % 100 / 4).alias("load_time_ms"),
        (F.col("id") % 5 != 0).alias("success"),
    )
    names = ["hot", *[f"c{i}" for i in range(50)]]
    expected, first = {}, {}
    for i in range(n):
        c, t, ms = ("hot" if i % 3 == 0 else f"c{i % 50}"), f"t{i % 7}", i % 100 / 4
        k, s = expected.get(c, (0, 0.0))
        expected[c] = (k + 1, s + ms)
        first.setdefault((t, c), (i, ms if i % 5 else 0.0))
    found = {r.connection_name: (r.tables_imported, r.total_import_time_ms) for r in measures.import_metrics(loads).collect()}
    assert found == {c: (k, math.floor(s * 100 + 0.5) / 100) for c, (k, s) in expected.items()}
    wide = {r.table_name: r for r in compare.pivot_loads(loads, names).collect()}
    for t, row in wide.items():
        assert {c: row[c] for c in names} == {c: first.get((t, c), (0, 0.0))[1] for c in names}
