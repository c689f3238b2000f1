"""Constraint checks against brute force."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceline.operators.constraints import (
    cascade_delete,
    fk_orphans,
    null_violations,
    pk_violations,
    type_violations,
    with_default,
)
from tests.conftest import as_list, as_set

KEYS = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=30)
FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(keys=KEYS)
def test_pk(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "id int")
    expected = {(k, keys.count(k)) for k in keys if k is None or keys.count(k) > 1}
    assert as_set(pk_violations(df, ["id"])) == expected


def test_pk_of_two_columns(rows):
    df = rows([(1, 1), (1, 1), (1, 2), (2, None)], "a int, b int")
    assert as_set(pk_violations(df, ["a", "b"])) == {(1, 1, 2), (2, None, 1)}


def test_nulls(rows):
    df = rows([(1, None), (None, None), (3, "c")], "a int, b string")
    assert as_set(null_violations(df, ["a", "b"])) == {("a", 1), ("b", 2)}
    assert as_set(null_violations(df.limit(0), ["a", "b"])) == {("a", 0), ("b", 0)}


@FEW
@given(parents=st.lists(st.integers(0, 6), max_size=8), children=KEYS, gone=st.sets(st.integers(0, 6)))
def test_cascade_leaves_no_orphans(spark, parents, children, gone):
    parent = spark.createDataFrame([(p,) for p in sorted(set(parents))], "id int")
    child = spark.createDataFrame(list(enumerate(children)), "n int, parent_id int")
    lost = {(n, c) for n, c in enumerate(children) if c is not None and c not in parents}
    assert as_set(fk_orphans(child, parent, "parent_id", "id")) == lost
    assert as_set(fk_orphans(child, parent, "parent_id", "id", staged=True)) == lost
    known = child.join(parent, child.parent_id == parent.id, "left_semi").union(child.where("parent_id is null"))
    left = cascade_delete(parent, known, F.col("id").isin([*gone, -1]), "id", "parent_id")
    assert as_set(left.parent) == {(p,) for p in set(parents) - gone}
    assert fk_orphans(left.child, left.parent, "parent_id", "id").count() == 0
    kept = {(n, c) for n, c in enumerate(children) if c is None or c in set(parents) - gone}
    assert as_set(left.child) == kept
    staged = cascade_delete(parent, known, F.col("id").isin([*gone, -1]), "id", "parent_id", staged=True)
    assert as_set(staged.child) == kept


def test_delete_condition_that_is_null_keeps_the_row(rows):
    parent = rows([(1, None), (2, 5)], "id int, x int")
    child = rows([(1,), (2,)], "parent_id int")
    left = cascade_delete(parent, child, F.col("x") > 1, "id", "parent_id")
    assert as_set(left.parent) == {(1, None)} and as_set(left.child) == {(1,)}


def test_columns_of_one_name(rows):
    df = rows([(1,), (2,)], "id int")
    other = rows([(2,)], "id int")
    assert as_set(fk_orphans(df, other, "id", "id")) == {(1,)}
    assert as_set(fk_orphans(df, other, "id", "id", staged=True)) == {(1,)}


def test_staged_checks_do_not_shuffle_child_rows(spark, tmp_path):
    spark.range(200_000).select("id", F.lit("x" * 50).alias("wide")).write.parquet(str(tmp_path / "child"))
    spark.range(150_000).write.parquet(str(tmp_path / "parent"))
    child, parent = (spark.read.parquet(str(tmp_path / name)) for name in ("child", "parent"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400KB")
    try:
        plain = fk_orphans(child, parent, "id", "id")
        staged = fk_orphans(child, parent, "id", "id", staged=True)
        assert "SortMergeJoin" in plain._jdf.queryExecution().executedPlan().toString()
        plan = staged._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert staged.count() == plain.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_type_limits(rows):
    texts = ["abc", "abcd", None, "1.5", " 12 ", "99999999.99", "99999999.995", "99999999.994", "1e5", "1e8", "-1e400", ".5", "5."]
    df = rows([(i, t, t) for i, t in enumerate(texts)], "id int, name string, amount string")
    found = {r.name: r.violations for r in type_violations(df, {"name": "varchar(12)", "amount": "decimal(10,2)"}).collect()}
    assert found == {
        "abc": "amount",
        "abcd": "amount",
        "99999999.995": "amount",
        "1e8": "amount",
        "-1e400": "amount",
    }
    assert as_list(type_violations(df, {"name": "VARCHAR2(3)"}).where("id = 1").select("violations")) == [("name",)]


def test_decimal_limit_of_doubles_equals_the_cast(spark):
    values = [0.0, -0.0, 1e8, -1e8, 99999999.99, 99999999.994, 99999999.995, 99999999.996, 1e300, 99.0e6, 101.0e6, 98999999.5]
    values += [float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    broken = {str(r.x) for r in type_violations(df, {"x": "decimal(10,2)"}).collect()}
    cast = df.where(F.col("x").try_cast("decimal(10,2)").isNull())
    assert broken == {str(r.x) for r in cast.collect()}


def test_other_types_are_cast(rows):
    df = rows([("2024-01-01",), ("soon",), (None,)], "day string")
    assert as_set(type_violations(df, {"day": "date"})) == {("soon", "day")}


def test_defaults(rows):
    df = rows([(1, None), (2, "x")], "id int, a string")
    assert as_list(with_default(df, "a", F.lit("d")).orderBy("id")) == [(1, "d"), (2, "x")]
    stamped = with_default(df, "created_at")
    assert dict(stamped.dtypes)["created_at"] == "timestamp"
    assert stamped.where("created_at is null").count() == 0
