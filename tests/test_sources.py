"""Generators, CSV dialects, workload files and JDBC options."""

from __future__ import annotations

import datetime as dt
import json
import os
from decimal import Decimal
from types import SimpleNamespace

import pytest

from paceline.errors import error_text
from paceline.operators.queries import q_aggregate, q_join
from paceline.session import scratch_path
from paceline.sources import (
    JDBC_DRIVERS,
    csv_dialect_of,
    gen_orders,
    gen_users,
    missing_files,
    read_config,
    read_csv,
    read_jdbc,
    resolve_text,
    write_jdbc,
)
from paceline.sources.config import pick
from paceline.sources.jdbc import jdbc_options
from tests.conftest import as_list, as_set

DAY = dt.date(2024, 1, 1)
SCHEMA = "id int, name string, n int"


@pytest.fixture
def csv_file(tmp_path):
    def write(text, name="in.csv"):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_generated_values(spark):
    users = {row["id"]: row for row in gen_users(spark, 1000).collect()}
    assert len(users) == 1000
    assert users[1]["name"] == "BenchUser_01"
    assert users[13]["name"] == "BenchUser_121"
    assert users[1000]["name"] == "BenchUser_9991"
    assert users[7]["email"] == "user_7@benchmark.com"
    orders = {row["id"]: row for row in gen_orders(spark, 1000, DAY).collect()}
    assert orders[1]["amount"] == Decimal("10.00")
    assert orders[1000]["amount"] == Decimal("1009.00")
    assert all(row["user_id"] == i and row["order_date"] == DAY for i, row in orders.items())


@pytest.mark.parametrize("n", [0, 1, 41, 42, 60, 1000])
def test_query_counts_on_generated_data(spark, n):
    users, orders = gen_users(spark, n), gen_orders(spark, n, DAY)
    matches = max(0, n - 41)
    assert q_join(users, orders, 50.0, limit=None).count() == matches
    assert q_join(users, orders, 50.0).count() == min(100, matches)
    assert q_aggregate(users, orders, 10.0).count() == max(0, n - 1)


def test_generated_amounts_must_fit(spark):
    with pytest.raises(Exception, match="OUT_OF_RANGE|overflow|cannot be represented"):
        gen_orders(spark, 200_000_000, DAY).selectExpr("max(amount)").collect()


def test_quoted_csv(spark, csv_file):
    path = csv_file('id,name,n\n1,"a,b",2\n2,,3\n3,"",4\n4,"say ""hi"" \\ x",5\n5, pad ,\n')
    assert as_list(read_csv(spark, path, SCHEMA)) == [
        (1, "a,b", 2),
        (2, None, 3),
        (3, "", 4),
        (4, 'say "hi" \\ x', 5),
        (5, " pad ", None),
    ]


def test_quoted_csv_is_read_by_position(spark, csv_file):
    path = csv_file("n,name,id\n1,a,2\n")
    assert as_list(read_csv(spark, path, SCHEMA)) == [(1, "a", 2)]


def test_quoted_csv_fails_on_a_bad_number(spark, csv_file):
    with pytest.raises(Exception) as failure:
        read_csv(spark, csv_file("id,name,n\nx,a,2\n"), SCHEMA).collect()
    assert 'For input string: "x"' in error_text(failure.value)


def test_line_break_in_a_field(spark, csv_file):
    path = csv_file('id,name,n\n1,"two\nlines",2\n')
    assert as_list(read_csv(spark, path, SCHEMA, multiline=True)) == [(1, "two\nlines", 2)]


def test_raw_csv(spark, csv_file):
    path = csv_file('id,name,n\n1,"a,b",2\n2,x\n3,"y",7\n4,"open,8\n5,z,bad\n')
    assert as_list(read_csv(spark, path, SCHEMA, "raw")) == [
        (1, '"a', None),
        (2, "x", None),
        (3, '"y"', 7),
        (4, '"open', 8),
        (5, "z", None),
    ]


def test_named_csv_finds_columns_by_header(spark, csv_file):
    path = csv_file('n,extra,name,id\n2,?,"a,b",1\n')
    assert as_list(read_csv(spark, path, SCHEMA, "named")) == [(1, "a,b", 2)]


def test_named_csv_with_another_header_in_one_file_fails(spark, csv_file, tmp_path):
    csv_file("id,name,n\n1,a,2\n", "a.csv")
    csv_file("n,name,id\n2,a,1\n", "b.csv")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path), SCHEMA, "named").collect()


@pytest.mark.parametrize("dialect", ["quoted", "raw", "named"])
def test_header_only_and_missing_files(spark, csv_file, dialect):
    assert as_list(read_csv(spark, csv_file("id,name,n\n"), SCHEMA, dialect)) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, "/nowhere/at/all.csv", SCHEMA, dialect).collect()


def test_csv_dialect_of_a_database():
    assert [csv_dialect_of(d) for d in ["MySQL", "mariadb", "postgresql", "duckdb", "clickhouse", "parquet"]] == [
        "raw",
        "raw",
        "quoted",
        "quoted",
        "named",
        "quoted",
    ]
    with pytest.raises(ValueError, match="not supported"):
        csv_dialect_of("oraclesql")


CONFIG = {
    "connectionDetails": [
        {"name": "a", "dbType": "parquet", "url": "file:/x/db", "username": "root", "password": "pwd"},
        {"name": "b", "dbType": "orc", "url": "file:/y/db"},
    ],
    "tables": [{"tableName": "employee", "csvFileName": "employee.csv", "schemas": {"parquet": "CREATE TABLE e"}}],
    "queries": [{"name": "high", "category": "SELECT", "queriesByDb": {"parquet": "SELECT 1"}}],
}


def test_config_without_credentials(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    config = read_config(spark, str(path))
    assert as_list(config.connections) == [(0, "a", "parquet", "file:/x/db"), (1, "b", "orc", "file:/y/db")]
    assert not {"username", "password"} & set(config.connections.columns)
    assert as_list(config.tables) == [(0, "employee", "employee.csv", {"parquet": "CREATE TABLE e"})]
    assert as_list(config.queries) == [(0, "high", "SELECT", {"parquet": "SELECT 1"})]


def test_broken_config_fails(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"connectionDetails": [')
    with pytest.raises(Exception):
        read_config(spark, str(path)).connections.collect()


def test_missing_files(rows):
    tables = rows([("t", "t.csv"), ("u", "u.csv"), ("v", "t.csv")], "table_name string, csv_file_name string")
    files = rows([("t.csv",), ("other.csv",)], "csv_file_name string")
    assert as_set(missing_files(tables, files)) == {("u", "u.csv", "u.csv not uploaded")}
    assert as_set(missing_files(tables, files.union(rows([("u.csv",)], "f string")))) == set()


def test_dialect_is_compared_in_lower_case(rows):
    queries = rows(
        [(0, "q", "SELECT", {"orc": "SELECT 1"}), (1, "r", None, {"parquet": "SELECT 2"})],
        "position int, name string, category string, queries_by_db map<string,string>",
    )
    error = "No queries configuration found for database type: ORC"
    assert as_list(resolve_text(queries, "ORC")) == [
        (0, "q", "SELECT", "SELECT 1", None),
        (1, "r", None, None, error),
    ]


def test_keys_in_any_case(rows):
    queries = rows(
        [
            (0, "exact", None, {"orc": "low", "ORC": "high", "Orc": "mixed"}),
            (1, "alike", None, {"orc": "low", "Orc": "mixed"}),
            (2, "none", None, {"parquet": "other"}),
        ],
        "position int, name string, category string, queries_by_db map<string,string>",
    )
    assert [r.sql_text for r in resolve_text(queries, "ORC").collect()] == ["high", "mixed", None]
    assert pick({"orc": 1, "ORC": 2}, "ORC") == 2 and pick({"orc": 1, "Orc": 2}, "ORC") == 2
    assert pick({}, "x") is None and pick(None, "x") is None


def test_jdbc_options():
    assert jdbc_options("PostgreSQL", "jdbc:postgresql://h/db", "me", "pw") == {
        "url": "jdbc:postgresql://h/db",
        "driver": JDBC_DRIVERS["postgresql"],
        "user": "me",
        "password": "pw",
    }
    assert "user" not in jdbc_options("duckdb", "jdbc:duckdb:x.db")
    with pytest.raises(ValueError, match="Unsupported database type: db2"):
        jdbc_options("db2", "jdbc:db2:x")


def test_jdbc_needs_a_table_or_a_query_and_a_driver(spark):
    connection = jdbc_options("mysql", "jdbc:mysql://h/db")
    with pytest.raises(ValueError):
        read_jdbc(spark, connection)
    with pytest.raises(ValueError):
        read_jdbc(spark, connection, table="t", query="SELECT 1")
    with pytest.raises(Exception) as failure:
        read_jdbc(spark, connection, table="t")
    assert "com.mysql.cj.jdbc.Driver" in error_text(failure.value)


class Recorder:
    """Stands for a DataFrame writer or reader and keeps what it was told."""

    def __init__(self, ends=None):
        self.told, self.ends, self.loads = {}, ends, 0

    write = read = property(lambda self: self)

    def format(self, name):
        return self.option("format", name)

    def mode(self, name):
        return self.option("mode", name)

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **values):
        self.told.update(values)
        return self

    def save(self):
        self.told["saved"] = True

    def load(self):
        self.loads += 1
        return self

    def first(self):
        return self.ends


def test_jdbc_write_is_batched_and_bounds_its_connections():
    frame = Recorder()
    write_jdbc(frame, jdbc_options("mariadb", "jdbc:mariadb://h/db"), "t", batch_size=500, max_connections=9)
    assert frame.told == {
        "format": "jdbc",
        "mode": "append",
        "url": "jdbc:mariadb://h/db",
        "driver": "org.mariadb.jdbc.Driver",
        "dbtable": "t",
        "batchsize": 500,
        "numPartitions": 9,
        "saved": True,
    }


def test_jdbc_read_is_partitioned_by_looked_up_bounds():
    connection = jdbc_options("duckdb", "jdbc:duckdb:x")
    session = Recorder(ends=(3, 90))
    read_jdbc(session, connection, query="SELECT * FROM t", partition_column="id", partitions=4)
    told = session.told
    assert session.loads == 2 and told["dbtable"] == "(SELECT * FROM t) q"
    assert (told["partitionColumn"], told["lowerBound"], told["upperBound"], told["numPartitions"]) == ("id", "3", "90", 4)
    empty = Recorder(ends=(None, None))
    read_jdbc(empty, connection, table="t", partition_column="id", partitions=4)
    assert "lowerBound" not in empty.told and empty.told["dbtable"] == "t"
    given = Recorder()
    read_jdbc(given, connection, table="t", partition_column="id", bounds=(0, 10), partitions=2)
    assert given.loads == 1 and given.told["upperBound"] == "10"


class FakeSession:
    """A session without a scratch folder setting."""

    def __init__(self, master, root=None):
        values = {"spark.checkpoint.dir": root}
        self.conf = SimpleNamespace(get=values.get)
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1")


def test_scratch_folder():
    first, second = (scratch_path(FakeSession("yarn", "hdfs://shared/tmp/"), "x") for _ in range(2))
    assert first.startswith("hdfs://shared/tmp/paceline-") and first.endswith("/x") and first != second
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(FakeSession("yarn"), "x")
    local = [scratch_path(FakeSession("local[2]"), "x").split("/paceline-")[0] for _ in range(2)]
    assert local[0] == local[1] and os.path.isdir(local[0])
