"""Loads, trials, copies, DDL and the sorted layout."""

from __future__ import annotations

import math
import os
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceline.schemas import LOAD
from paceline.sources import (
    append,
    apply_ddl,
    drop_table,
    load_refused,
    load_table,
    load_to_threshold,
    read_csv,
    scale_to_threshold,
    tables,
    trial_load,
    trial_summary,
    write_sorted,
)
from tests.conftest import as_list, as_set

COLUMNS = "id int, name string"


@pytest.fixture
def small(rows):
    return rows([(i, f"n{i}") for i in range(25)], COLUMNS)


def test_load_reports_rows(spark, small, tmp_path):
    target = str(tmp_path / "t")
    load = load_table(spark, lambda: small, target, "t", "t.csv", connection="c", position=3)
    assert load.schema == LOAD
    row = load.first()
    assert (row.connection_name, row.position, row.table_name, row.csv_file_name) == ("c", 3, "t", "t.csv")
    assert (row.rows_loaded, row.success, row.error_message) == (25, True, None)
    assert row.load_time_ms > 0
    assert spark.read.parquet(target).count() == 25
    load_table(spark, lambda: small, target, "t")
    assert spark.read.parquet(target).count() == 50


def test_failed_load_is_a_row_and_writes_nothing(spark, tmp_path):
    source = tmp_path / "bad.csv"
    source.write_text("id,name\n" + "\n".join(f"{i},a" for i in range(1000)) + "\nx,b\n")
    target = str(tmp_path / "t")
    row = load_table(spark, lambda: read_csv(spark, str(source), COLUMNS), target, "t").first()
    assert (row.rows_loaded, row.load_time_ms, row.success) == (0, 0.0, False)
    assert 'For input string: "x"' in row.error_message
    assert not [f for f in os.listdir(target) if f.endswith(".parquet")] if os.path.isdir(target) else True
    row = load_table(spark, lambda: read_csv(spark, str(tmp_path / "none.csv"), COLUMNS), target, "t").first()
    assert not row.success and "PATH_NOT_FOUND" in row.error_message


def test_empty_load_succeeds(spark, small, tmp_path):
    row = load_table(spark, lambda: small.where("id < 0"), str(tmp_path / "t"), "t").first()
    assert (row.rows_loaded, row.success) == (0, True)
    row = load_table(spark, lambda: small.limit(0), str(tmp_path / "u"), "u").first()
    assert (row.rows_loaded, row.success) == (0, True)


def test_catalog_table_checks_lengths(spark, rows):
    apply_ddl(spark, ["CREATE TABLE short_names (id INT, name VARCHAR(3)) USING parquet"])
    try:
        good = load_table(spark, lambda: rows([(1, "abc")], COLUMNS), "short_names", "short_names").first()
        bad = load_table(spark, lambda: rows([(2, "abcd")], COLUMNS), "short_names", "short_names").first()
        assert (good.rows_loaded, good.success) == (1, True)
        assert not bad.success and "EXCEED_LIMIT_LENGTH" in bad.error_message
        assert as_list(spark.table("short_names")) == [(1, "abc")]
    finally:
        drop_table(spark, "short_names")


def test_refused_load(spark):
    row = load_refused(spark, "t", "t.csv", "not supported", "ora").first()
    assert (row.connection_name, row.rows_loaded, row.success, row.error_message) == ("ora", 0, False, "not supported")


def test_trials_replace_rows_and_keep_the_last_outcome(spark, small, tmp_path):
    target, made = str(tmp_path / "t"), []
    row = trial_load(spark, lambda: small, target, "t", trials=3, prepare=lambda: made.append(1)).first()
    assert len(made) == 3
    assert (row.rows_loaded, row.success) == (25, True) and row.load_time_ms > 0
    assert spark.read.parquet(target).count() == 25

    def fails_last():
        if len(made) == 6:
            raise RuntimeError("disk full\nsecond line")
        return small

    row = trial_load(spark, fails_last, target, "t", trials=3, prepare=lambda: made.append(1)).first()
    assert (row.rows_loaded, row.success, row.error_message) == (0, False, "disk full")


def test_trial_mean_counts_failures_as_zero(rows):
    trials = rows(
        [
            ("c", "t", 0, 10, 30.0, True, None),
            ("c", "t", 1, 0, 99.0, False, "early"),
            ("c", "t", 2, 12, 15.0, True, None),
            ("c", "u", 0, 5, 10.0, True, None),
            ("c", "u", 1, 0, 0.0, False, "late"),
        ],
        "c string, t string, trial_no int, rows_loaded long, load_time_ms double, success boolean, error_message string",
    )
    assert as_set(trial_summary(trials, ["c", "t"])) == {("c", "t", 12, 15.0, True, None), ("c", "u", 0, 5.0, False, "late")}


@pytest.mark.parametrize("threshold,copies", [(-5, 1), (0, 1), (1, 1), (25, 1), (26, 2), (1000, 40), (1010, 41)])
def test_whole_copies(small, threshold, copies):
    counts = scale_to_threshold(small, threshold).groupBy("id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("copy_no"), F.max("copy_no"), F.count_distinct("copy_no")
    )
    assert as_set(counts) == {(i, f"n{i}", copies, 0, copies - 1, copies) for i in range(25)}


@pytest.mark.parametrize("rows_per_task", [1, 7, 50, 400])
@pytest.mark.parametrize("n,threshold", [(1, 1), (1, 333), (3, 1000), (25, 999), (200, 5000)])
def test_spread_copies_are_whole(spark, monkeypatch, rows_per_task, n, threshold):
    # A number is estimated at eight bytes.
    monkeypatch.setattr(tables, "BYTES_PER_TASK", 8 * max(rows_per_task, -(-threshold // 60)))
    copies = max(1, math.ceil(threshold / n))
    found = scale_to_threshold(spark.range(n).coalesce(1), threshold).collect()
    assert sorted(tuple(r) for r in found) == [(i, c) for i in range(n) for c in range(copies)]


def test_copies_shuffle_only_where_tasks_are_missing(spark, monkeypatch):
    plan = lambda df: scale_to_threshold(df, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(spark.range(0, 100, 1, 4))
    monkeypatch.setattr(tables, "BYTES_PER_TASK", 8 * 2500)
    assert "Exchange" not in plan(spark.range(0, 100, 1, 4))
    assert "Exchange RoundRobinPartitioning(4)" in plan(spark.range(0, 100, 1, 3))


def test_counting_is_not_part_of_the_load_time(spark, tmp_path):
    reads = []

    def read():
        reads.append(1)
        if len(reads) == 1:
            time.sleep(2)
        return spark.range(10)

    row = load_to_threshold(spark, read, str(tmp_path / "t"), "t", 20).first()
    assert row.rows_loaded == 20 and len(reads) == 2 and row.load_time_ms < 2000


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 40), threshold=st.integers(-10, 3000))
def test_number_of_copied_rows(spark, n, threshold):
    assert scale_to_threshold(spark.range(n), threshold, rows=n).count() == n * max(1, math.ceil(threshold / n))


def test_threshold_load(spark, small, tmp_path):
    row = load_to_threshold(spark, lambda: small, str(tmp_path / "t"), "t", 1010, keep_copy_no=True).first()
    assert (row.rows_loaded, row.success) == (1025, True)
    assert spark.read.parquet(str(tmp_path / "t")).select("id", "copy_no").distinct().count() == 1025


def test_threshold_of_an_empty_or_broken_input_ends(spark, small, tmp_path):
    row = load_to_threshold(spark, lambda: small.where("id < 0"), str(tmp_path / "t"), "t", 10).first()
    assert not row.success and "no rows" in row.error_message
    row = load_to_threshold(spark, lambda: spark.read.parquet("/nowhere"), str(tmp_path / "t"), "t", 10).first()
    assert not row.success and "PATH_NOT_FOUND" in row.error_message


def test_ddl_skips_empty_statements(spark):
    assert apply_ddl(spark, [None, "", "  ", "CREATE TABLE made (id INT) USING parquet"]) == 1
    assert spark.catalog.tableExists("made")
    drop_table(spark, "made")
    drop_table(spark, "made")
    assert not spark.catalog.tableExists("made")


def test_append_by_position_and_overwrite(spark, small):
    apply_ddl(spark, ["CREATE TABLE filled (a INT, b STRING) USING orc"])
    try:
        append(small, "filled")
        append(small, "filled")
        assert spark.table("filled").count() == 50
        append(small, "filled", overwrite=True)
        assert as_set(spark.table("filled")) == as_set(small)
    finally:
        drop_table(spark, "filled")


def test_sorted_layout_spreads_a_hot_key(spark, tmp_path):
    # A third of all rows share one key.
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("k"), "id")
    path = str(tmp_path / "sorted")
    write_sorted(df, path, ["k"], files=9)
    back = spark.read.parquet(path)
    assert as_set(back) == as_set(df)
    files = back.groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")
    )
    parts = sorted((r.lo, r.hi, r.n) for r in files.collect())
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert max(n for _, _, n in parts) < 20_000
    for name in (f for f in os.listdir(path) if f.endswith(".parquet")):
        keys = [r.k for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert keys == sorted(keys)


def test_sorted_layout_spreads_copies_of_one_row(spark, tmp_path):
    df = spark.range(60_000, numPartitions=12).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"))
    path = str(tmp_path / "sorted")
    write_sorted(df, path, ["k"], files=6)
    back = spark.read.parquet(path)
    assert back.groupBy("k").count().exceptAll(df.groupBy("k").count()).isEmpty() and back.count() == 60_000
    sizes = back.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 20_000


def test_sorted_layout_of_a_map_column(spark, tmp_path):
    df = spark.range(50).select((50 - F.col("id")).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    write_sorted(df, str(tmp_path / "sorted"), ["k"], files=2)
    assert [r.k for r in spark.read.parquet(str(tmp_path / "sorted")).orderBy("k").collect()] == list(range(1, 51))
