"""Schemas of the data and measurement tables.

Ids are bigint: a 32-bit id would overflow beyond 2.1 billion rows. ``position`` is the place of a row
in its report; DataFrames have no row order, so every "first row wins" rule reads this column.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from paceline.values import METRIC_COLUMNS


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


USERS = _struct(id=LongType(), name=StringType(), email=StringType(), created_at=TimestampType())

ORDERS = _struct(id=LongType(), user_id=LongType(), amount=DecimalType(10, 2), order_date=DateType())

METRIC = _struct(
    connection_name=StringType(),
    db_type=StringType(),
    position=IntegerType(),
    success=BooleanType(),
    **{name: DoubleType() for name in METRIC_COLUMNS},
    error=StringType(),
)

TABLE_STATS = _struct(
    connection_name=StringType(),
    position=IntegerType(),
    table_name=StringType(),
    row_count=LongType(),
    data_size_bytes=LongType(),
    total_size_bytes=LongType(),
    total_size_mb=DoubleType(),
    bytes_per_row=DoubleType(),
)

LOAD = _struct(
    connection_name=StringType(),
    position=IntegerType(),
    table_name=StringType(),
    csv_file_name=StringType(),
    rows_loaded=LongType(),
    load_time_ms=DoubleType(),
    success=BooleanType(),
    error_message=StringType(),
)

QUERY_TIMING = _struct(
    connection_name=StringType(),
    position=IntegerType(),
    query_name=StringType(),
    category=StringType(),
    execution_time_ms=DoubleType(),
    success=BooleanType(),
    error_message=StringType(),
)

COMPARED_TEXTS = _struct(
    position=IntegerType(),
    query_name=StringType(),
    rows_left=LongType(),
    rows_right=LongType(),
    equal=BooleanType(),
    error_message=StringType(),
)

RESULT = _struct(
    connection_name=StringType(),
    db_type=StringType(),
    position=IntegerType(),
    success=BooleanType(),
    error=StringType(),
)

# Shape of a workload file. The field names are fixed by the file format.
CONFIG = _struct(
    connectionDetails=ArrayType(
        _struct(
            name=StringType(),
            dbType=StringType(),
            url=StringType(),
            username=StringType(),
            password=StringType(),
        )
    ),
    tables=ArrayType(
        _struct(
            tableName=StringType(),
            csvFileName=StringType(),
            schemas=MapType(StringType(), StringType()),
        )
    ),
    queries=ArrayType(
        _struct(
            name=StringType(),
            category=StringType(),
            queriesByDb=MapType(StringType(), StringType()),
        )
    ),
)
