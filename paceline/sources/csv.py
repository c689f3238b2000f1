"""Typed CSV input in the three ways the supported databases read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paceline.sources.records import read_records
from paceline.values import CSV_DIALECTS

# A text no file holds, so that only a truly empty field (,,) is NULL and "" stays an empty string.
NO_TEXT = "\x01"


def csv_dialect_of(db_type: str) -> str:
    """CSV dialect of a database type; types not listed (file formats of Spark) read quoted CSV."""
    dialect = CSV_DIALECTS.get(db_type.lower(), "quoted")
    if dialect is None:
        raise ValueError(f"CSV import is not supported for database type: {db_type}")
    return dialect


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    dialect: str = "quoted",
    multiline: bool = False,
    split: bool = False,
) -> DataFrame:
    """Read comma-separated files with a header line into typed columns.

    - ``quoted``: columns by position, double quotes around fields, ``""`` for a quote inside one.
      An empty field is NULL, a quoted empty field an empty string. A field that does not fit its type
      fails the read.
    - ``raw``: columns by position, split at every comma, lines end at ``\\n``, quotes are plain
      characters. A field that does not fit its type is NULL, missing fields are NULL, extra ones are dropped.
    - ``named``: quoted, but columns are found by their header name, in any order.

    Set ``multiline`` when quoted fields hold line breaks. Spark cannot split such a file, so one task reads each; with
    ``split`` its lines are read in splits, and records put together from them (see ``records``).
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("sep", ",")
    if dialect == "raw":
        return reader.schema(schema).csv(path, quote="", lineSep="\n", mode="PERMISSIVE")
    options = {"quote": '"', "escape": '"', "nullValue": NO_TEXT, "mode": "FAILFAST"}
    if multiline and split and dialect in ("quoted", "named"):
        return read_records(spark, path, schema, dialect == "named", {**options, "sep": ","})
    quoted = reader.options(**options, multiLine=multiline)
    if dialect == "quoted":
        return quoted.schema(schema).csv(path)
    if dialect == "named":
        # Without a schema the names come from the first file; every other file must have the same
        # header or the read fails, so no column is ever taken for another.
        text = quoted.option("enforceSchema", False).csv(path)
        return text.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in schema])
    raise ValueError(f"unknown CSV dialect: {dialect}")
