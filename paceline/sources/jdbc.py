"""Tables and queries of outside databases, read and written by Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paceline.values import JDBC_DRIVERS, UNSUPPORTED


def jdbc_options(db_type: str, url: str, username: str | None = None, password: str | None = None) -> dict:
    """Options of a connection. The driver jar must be on the class path of the session."""
    driver = JDBC_DRIVERS.get(db_type.lower())
    if driver is None:
        raise ValueError(UNSUPPORTED + db_type)
    options = {"url": url, "driver": driver}
    if username is not None:
        options["user"] = username
    if password is not None:
        options["password"] = password
    return options


def read_jdbc(
    spark: SparkSession,
    connection: dict,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Read a table or the result of a query through a connection.

    The query text goes to the database unchanged. Without a ``partition_column`` one task reads
    everything, so give one for a large table: ``partitions`` tasks then read a range each. Missing
    ``bounds`` are looked up with one small query; rows outside them are still read.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    source = {"dbtable": table if table else f"({query}) q"}
    reader = spark.read.format("jdbc").options(**connection).option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.options(**source).load()
    if bounds is None:
        ends = f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {source['dbtable']}) b"
        row = reader.option("dbtable", ends).load().first()
        if row[0] is None:
            return reader.options(**source).load()
        bounds = (row[0], row[1])
    return reader.options(
        **source,
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=partitions or spark.sparkContext.defaultParallelism,
    ).load()


def write_jdbc(
    df: DataFrame,
    connection: dict,
    table: str,
    mode: str = "append",
    batch_size: int = 10_000,
    max_connections: int = 64,
) -> None:
    """Insert rows in batches. Each task uses one connection and one transaction.

    ``max_connections`` bounds the open connections: Spark merges partitions beyond it before writing.
    A task that fails is rolled back and repeated. One that is lost between its commit and its report is
    repeated too, so give the table a primary key where executors can be lost: the repeat then fails
    instead of adding its rows twice.
    """
    df.write.format("jdbc").mode(mode).options(
        **connection, dbtable=table, batchsize=batch_size, numPartitions=max_connections
    ).save()
