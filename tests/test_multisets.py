"""Multiset comparison, keys by hash, exact quantiles, totals and sketches against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceline.operators.constraints import pk_violations
from paceline.operators.multisets import row_differences, same_rows
from paceline.operators.quantiles import exact_quantiles
from paceline.operators.totals import import_totals, level_sums, levels_of, merge_sketches, sketch_report, sketch_runs
from paceline.plans.runner import compare_texts
from tests.conftest import as_list, as_set

QUIET = [HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
SCHEMA = "a long, b string, c double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def hot(count, seed):
    """A third of the rows are one and the same."""
    rng = random.Random(seed)
    return [(1, "same", 0.5) if i % 3 == 0 else (rng.randrange(20), rng.choice([None, "x", "y"]), rng.choice([None, 1.0, 2.5])) for i in range(count)]


def test_row_differences(spark):
    left, right = hot(300, 1), hot(280, 2)
    a, b = Counter(left), Counter(right)
    expected = {(*row, a[row], b[row]) for row in a.keys() | b.keys() if a[row] != b[row]}
    for buckets in (1, 16, 1 << 16):
        assert as_set(row_differences(frame(spark, left).repartition(4), frame(spark, right), buckets)) == expected
        assert as_list(same_rows(frame(spark, left), frame(spark, right), buckets)) == [(300, 280, False)]


def test_equal_results_in_any_order(spark):
    rows = hot(200, 3)
    left, right = frame(spark, rows).repartition(5), frame(spark, rows[::-1]).toDF("x", "y", "z")
    assert as_list(same_rows(left, right)) == [(200, 200, True)]
    assert row_differences(left, right).count() == 0


@pytest.mark.parametrize(
    "left,right",
    [
        ([(None, "1", None)], [(1, None, None)]),
        ([(1, "a", 1.0), (2, "b", 2.0)], [(1, "b", 1.0), (2, "a", 2.0)]),
        ([(1, "a", 1.0)] * 2, [(1, "a", 1.0)]),
        ([(1, "", None)], [(1, None, None)]),
    ],
)
def test_small_differences_are_seen(spark, left, right):
    assert not same_rows(frame(spark, left), frame(spark, right)).first()["equal"]
    assert row_differences(frame(spark, left), frame(spark, right)).count() > 0


def test_nothing_on_either_side(spark):
    none = frame(spark, [])
    assert as_list(same_rows(none, none)) == [(0, 0, True)]
    assert as_list(same_rows(none, frame(spark, [(1, "a", 0.0)]))) == [(0, 1, False)]
    assert as_list(row_differences(none, frame(spark, [(1, "a", 0.0)]))) == [(1, "a", 0.0, 0, 1)]


def test_negative_zero_is_zero_as_for_spark(spark):
    left, right = frame(spark, [(1, "a", 0.0)]), frame(spark, [(1, "a", -0.0)])
    assert row_differences(left, right).count() == 0


def test_other_types_are_refused(spark):
    with pytest.raises(ValueError, match="types"):
        same_rows(frame(spark, []), frame(spark, []).select("b", "a", "c"))
    with pytest.raises(ValueError, match="maps"):
        same_rows(spark.sql("select map(1, 2) m"), spark.sql("select map(1, 2) m"))
    with pytest.raises(ValueError, match="n_left"):
        row_differences(spark.sql("select 1 n_left"), spark.sql("select 1 n_left"))


def test_compare_texts(spark):
    queries = [
        (0, "equal", "Q", {"a": "SELECT id FROM range(5)", "B": "SELECT id FROM range(5) ORDER BY id DESC"}),
        (1, "fewer", "Q", {"a": "SELECT id FROM range(5)", "b": "SELECT id FROM range(4)"}),
        (2, "broken", "Q", {"a": "SELECT id FROM range(5)", "b": "SELECT nothing"}),
        (3, "lacking", "Q", {"a": "SELECT 1"}),
        (4, "typed", "Q", {"a": "SELECT 1", "b": "SELECT 'x'"}),
        (5, "bound", "Q", {"a": "SELECT id FROM range(9) WHERE id > :n", "b": "SELECT id FROM range(:n + 1, 9)"}),
    ]
    texts = spark.createDataFrame(queries, "position int, name string, category string, queries_by_db map<string,string>")
    found = {r.query_name: r for r in compare_texts(spark, texts, "a", "b", {"n": 3}).collect()}
    assert [found[n].equal for n in ("equal", "fewer", "bound")] == [True, False, True]
    assert (found["fewer"].rows_left, found["fewer"].rows_right) == (5, 4)
    assert "nothing" in found["broken"].error_message and found["broken"].equal is None
    assert "b" in found["lacking"].error_message
    assert "types" in found["typed"].error_message


def test_keys_by_hash(spark):
    rows = hot(300, 5)
    df = frame(spark, rows)
    for key in (["a", "b"], ["b"], ["a", "b", "c"]):
        plain = pk_violations(df, key)
        assert Counter(as_list(pk_violations(df, key, by_hash=True))) == Counter(as_list(plain))
    assert pk_violations(df.limit(0), ["a"], by_hash=True).count() == 0


def test_keys_by_hash_shuffle_hashes_alone(spark, sf_lines):
    plan = pk_violations(sf_lines, ["l_orderkey", "l_linenumber"], by_hash=True)._jdf.queryExecution().executedPlan().toString()
    # The table is filtered by the hashes found before its keys are counted, and these are broadcast.
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


@pytest.fixture
def sf_lines(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


def plain_quantile(values, share):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(round(share * len(ordered), 9))) - 1]


def plain_quantiles(rows, shares):
    groups = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    return {(k, len(vs), *[plain_quantile(vs, s) for s in shares]) for k, vs in groups.items()}


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_exact_quantiles(spark, bins):
    rng = random.Random(bins)
    rows = [("hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c"]), rng.choice([rng.gauss(0, 1e6), 1.0, -0.5, None, math.nan])) for i in range(900)]
    rows += [("one", 4.0), ("same", 2.0), ("same", 2.0), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 3.0), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"least": 0.0, "quarter": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}
    found = exact_quantiles(df, ["k"], "v", shares, bins)
    assert found.columns == ["k", "n", *shares]
    assert as_set(found) == plain_quantiles(rows, shares.values())


def test_exact_quantiles_of_shares_that_end_on_a_rank(spark):
    df = spark.range(1, 21).select(F.col("id").cast("double").alias("v"))
    assert as_list(exact_quantiles(df, [], "v", {"a": 0.95, "b": 0.05, "c": 0.051})) == [(20, 19.0, 1.0, 2.0)]
    assert exact_quantiles(df.limit(0), [], "v", {"a": 0.5}).count() == 0
    with pytest.raises(ValueError, match="a"):
        exact_quantiles(df, [], "v", {"a": 1.5})


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=30))
@settings(max_examples=10, deadline=None, suppress_health_check=QUIET)
def test_exact_quantiles_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_quantiles(df, [], "v", {"a": 0.5}).first()["a"] == plain_quantile(values, 0.5)


def plain_levels(rows, keys, levels):
    out = Counter()
    for row in rows:
        for level in levels:
            at = tuple(row[k] if k in level else None for k in range(keys))
            bits = sum(1 << (keys - 1 - k) for k in range(keys) if k not in level)
            out[(*at, bits)] += row[keys]
    return {(*k, n) for k, n in out.items()}


def test_levels(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), "hot" if i % 3 == 0 else str(rng.randrange(4)), rng.randrange(100)) for i in range(200)]
    df = spark.createDataFrame(rows, "x string, y long, z string, n long")
    keys = ["x", "y", "z"]
    cube = [[k for k, on in enumerate(bits) if on] for bits in product([0, 1], repeat=3)]
    cases = {"cube": cube, "rollup": [[0, 1, 2], [0, 1], [0], []]}
    for kind, levels in cases.items():
        assert as_set(level_sums(df, keys, {"total": F.col("n")}, kind)) == plain_levels(rows, 3, levels)
    found = level_sums(df, keys, {"total": F.col("n")}, [["z", "x"], ["y"], ["x", "z"]])
    assert as_set(found) == plain_levels(rows, 3, [[0, 2], [1]])
    assert len(as_list(found)) == len(as_set(found))
    assert as_list(level_sums(df, keys, {"total": F.col("n")}, [[]])) == [(None, None, None, 7, sum(r[3] for r in rows))]
    assert level_sums(df.limit(0), keys, {"total": F.col("n")}).where("level < 7").count() == 0


def test_levels_that_do_not_exist():
    assert levels_of(["a", "b"], "cube") == [["a", "b"], ["a"], ["b"], []]
    for kind in ("cubes", [["c"]]):
        with pytest.raises(ValueError):
            levels_of(["a"], kind)


def test_levels_read_the_input_once(spark):
    loads = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderpriority c", "o_orderstatus s", "o_totalprice load_time_ms", "1 rows_loaded")
    plan = import_totals(loads, ["c", "s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # Rows are multiplied after they are added up.
    lines = plan.splitlines()
    expand = next(i for i, x in enumerate(lines) if "Expand" in x)
    assert expand < max(i for i, x in enumerate(lines) if "Exchange hashpartitioning(c" in x)


def test_merged_sketches_say_what_one_pass_says(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else rng.choice("ab"), i % 9, rng.randrange(3000), rng.gauss(100, 20)) for i in range(9000)] + [("none", 0, None, None)]
    df = spark.createDataFrame(rows, "c string, day long, q long, ms double")
    shares = {"median": 0.5, "p95": 0.95}
    daily = sketch_runs(df, ["c", "day"], "q", "ms")
    merged = {r.c: r for r in sketch_report(merge_sketches(daily, ["c"]), ["c"], shares).collect()}
    once = {r.c: r for r in sketch_report(sketch_runs(df, ["c"], "q", "ms"), ["c"], shares).collect()}
    assert merged.keys() == once.keys() == {"hot", "a", "b", "none"}
    for c in ("hot", "a", "b"):
        mine = [r for r in rows if r[0] == c]
        distinct = len({r[2] for r in mine})
        for told in (merged[c], once[c]):
            assert told.n == len(mine)
            assert abs(told.n_distinct - distinct) < 0.08 * distinct
            for name, share in shares.items():
                rank = sum(r[3] <= told[name] for r in mine) / len(mine)
                assert abs(rank - share) < 0.02
    assert (merged["none"].n, merged["none"].n_distinct, merged["none"].median) == (1, 0, None)
