"""Line breaks in CSV read by several tasks, how files lie along their keys, and counts from footers."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from paceline.operators.queries import q_count
from paceline.operators.storage import footers, table_stats
from paceline.sources import csv_records, file_ranges, files_holding, layout_report, overlap_depth, read_csv, write_sorted
from tests.conftest import as_list, as_set

WORDS = ["", "a", "b,c", 'say "hi"', "two\nlines", "\n", '"', "x\n\n\ny", "tab\t", " blank ", "long" * 50]
SCHEMA = "id long, t string, u string"


def write(path, rows, header=("id", "t", "u"), end="\n"):
    with open(path, "w", newline="") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture
def small_splits(spark):
    """Splits of 200 bytes, so that most records of a file begin in one split and end in another."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, "200")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def some_rows(count, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(WORDS[1:]), rng.choice(WORDS[1:])) for i in range(count)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_across_splits(spark, small_splits, tmp_path, end):
    rows = some_rows(300, 1)
    write(tmp_path / "a.csv", rows, end=end)
    write(tmp_path / "b.csv", rows[:3], end=end)
    lines = spark.read.text(str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() > 10
    found = read_csv(spark, str(tmp_path), SCHEMA, multiline=True, split=True)
    assert sorted(as_list(found)) == sorted(rows + rows[:3])
    assert sorted(as_list(found)) == sorted(as_list(read_csv(spark, str(tmp_path), SCHEMA, multiline=True)))


def test_one_record_over_many_splits(spark, small_splits, tmp_path):
    rows = [(0, "a", "b"), (1, "line\n" * 500, "z"), (2, "c", "d")]
    write(tmp_path / "a.csv", rows)
    assert sorted(as_list(read_csv(spark, str(tmp_path), SCHEMA, multiline=True, split=True))) == rows


def test_empty_fields_blank_lines_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\n1,,""\n\n2,"x\n\ny",\n')
    (tmp_path / "b.csv").write_text("id,t,u\n")
    (tmp_path / "c.csv").write_text("")
    found = as_set(read_csv(spark, str(tmp_path), SCHEMA, multiline=True, split=True))
    assert found == {(1, None, ""), (2, "x\n\ny", None)}
    assert found == as_set(read_csv(spark, str(tmp_path), SCHEMA, multiline=True))


def test_a_field_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\nno number,"a\nb",c\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(tmp_path), SCHEMA, multiline=True, split=True).collect()


def test_named_columns_in_any_order(spark, tmp_path):
    write(tmp_path / "a.csv", [("x\ny", "7", "dropped")], header=("u", "id", "other"))
    found = read_csv(spark, str(tmp_path), "id long, u string", "named", multiline=True, split=True)
    assert as_list(found) == [(7, "x\ny")]
    with pytest.raises(ValueError, match="absent"):
        read_csv(spark, str(tmp_path), "absent long", "named", multiline=True, split=True)
    write(tmp_path / "b.csv", [("1", "2")], header=("id", "u"))
    with pytest.raises(ValueError, match="headers"):
        read_csv(spark, str(tmp_path), "id long", "named", multiline=True, split=True)


def test_records_are_numbered_per_file(spark, small_splits, tmp_path):
    write(tmp_path / "a.csv", some_rows(100, 2))
    found = csv_records(spark, str(tmp_path)).select("record").orderBy("record")
    assert [r[0] for r in found.collect()] == list(range(1, 102))


def files_of(spark, path, parts):
    """Files with just these keys, in this order."""
    for i, keys in enumerate(parts):
        rows = [(k, str(n)) for n, k in enumerate(keys)]
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return f"{path}/*"


@pytest.mark.parametrize("block", [2, 1000])
def test_ranges_and_order_of_files(spark, tmp_path, block):
    path = files_of(spark, str(tmp_path), [[1, 2, 2, 5], [5, 6, 4], [None, 9], [9, None], [3, 3, 3, 3, 2]])
    found = file_ranges(spark, path, ["k"], block).select("least.k", F.col("most.k").alias("m"), "rows", "ordered")
    assert as_set(found) == {(1, 5, 4, True), (4, 6, 3, False), (None, 9, 2, True), (None, 9, 2, False), (2, 3, 5, False)}
    report = layout_report(spark, path, ["k"], block).first().asDict()
    # NULL sorts first, so two files hold all keys up to 9.
    assert report == {"files": 5, "rows": 16, "ordered_files": 2, "depth": 4}


@pytest.mark.parametrize("spans", [[], [(1, 1)], [(1, 3), (3, 5)], [(1, 3), (4, 5)], [(0, 100), *[(i, i + 5) for i in range(90)]]])
def test_overlap_depth(spark, spans):
    rows = spark.createDataFrame(spans, "a long, b long").select(F.struct("a").alias("least"), F.struct(F.col("b").alias("a")).alias("most"))
    expected = max((sum(a <= x <= b for a, b in spans) for span in spans for x in span), default=0)
    assert overlap_depth(rows).first()["depth"] == expected


def test_sorted_files_hold_a_key_once(spark, tmp_path):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"), F.lit("x").alias("v"))
    write_sorted(rows, str(tmp_path / "sorted"), ["k"], files=6)
    rows.repartition(6).write.parquet(str(tmp_path / "loose"))
    tidy, loose = (layout_report(spark, str(tmp_path / name), ["k"]).first() for name in ("sorted", "loose"))
    assert (tidy.rows, tidy.ordered_files, tidy.depth) == (10_000, tidy.files, 1)
    assert (loose.ordered_files, loose.depth) == (0, 6)
    ranges = file_ranges(spark, str(tmp_path / "sorted"), ["k"])
    assert files_holding(ranges, F.lit(5000)).count() == 1
    assert files_holding(ranges, F.lit(-1)).count() == 0
    # The reader skips by the same ranges: a filter reaches the scan.
    plan = spark.read.parquet(str(tmp_path / "sorted")).where("k = 5000")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,5000)" in plan


def test_counts_from_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    df = footers(spark, str(tmp_path / "t"))
    counted = q_count(df)
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.first()[0] == 1000
    least = df.agg(F.min("id"), F.max("id"))
    assert "PushedAggregation: [MIN(id), MAX(id)]" in least._jdf.queryExecution().executedPlan().toString()
    assert tuple(least.first()) == (0, 999)
    assert "PushedAggregation" not in q_count(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()


def test_table_stats_from_footers(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    spark.range(0).write.parquet(str(tmp_path / "b"))
    tables = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    quick = table_stats(spark, tables, from_footers=True)
    assert as_set(quick) == as_set(table_stats(spark, tables))
    assert "PushedAggregation: [COUNT(*)]" in quick._jdf.queryExecution().executedPlan().toString()
