"""Quoted CSV whose fields hold line breaks, read by many tasks per file.

Spark reads such a file in one task, as a split cannot tell whether it begins inside a field. Here the file is read as lines,
in splits. A line begins inside a field if and only if the file has an odd number of quotes in front of it, so it is enough to
know the number of quotes of each split, modulo 2, added up over the splits before it. Lines that are records by themselves stay
where they are; the others, pieces of a record that goes over several lines, are joined by the number of their record.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paceline.sources.tables import stage

QUOTE = '"'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as text: file, record (its number in the file, from 1, blank lines and all), text.

    Quotes must stand around whole fields, doubled inside them. A file whose last field is never closed ends with one record
    to the file's end.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.text(path, lineSep="\n").select(*meta, F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit(QUOTE), F.lit("")))
    lines = lines.withColumn("odd", (quotes % 2).cast("bigint"))

    def before(value: Column, split_rows: DataFrame) -> DataFrame:
        """The sum of a split's value over the splits in front of it: a row per split, a window per file."""
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        return split_rows.select("file", "split", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("before"))

    parity = before(F.col("odd"), lines.groupBy("file", "split").agg(F.sum("odd").alias("odd")))
    own = Window.partitionBy("file", "split").orderBy("line")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("before") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2 == 1
    marked = lines.join(parity, ["file", "split"]).withColumn("begins", ~inside).drop("before")
    through = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("record", F.sum(F.col("begins").cast("bigint")).over(through))
    # A line ends a record if it began in one state and has the quotes to end outside of a field.
    marked = marked.withColumn("ends", F.col("begins") == (F.col("odd") == 0)).drop("odd")
    marked = stage(marked, "lines")
    starts = before(F.col("begun"), marked.groupBy("file", "split").agg(F.count_if("begins").alias("begun")))
    numbered = marked.join(starts, ["file", "split"]).withColumn("record", F.col("record") + F.col("before"))
    alone = F.col("begins") & F.col("ends")
    pieces = F.sort_array(F.collect_list(F.struct("split", "line", "text")))
    joined = numbered.where(~alone).groupBy("file", "record").agg(pieces.alias("pieces"))
    joined = joined.select("file", "record", F.array_join(F.col("pieces.text"), "\n").alias("text"))
    return numbered.where(alone).select("file", "record", "text").unionByName(joined)


def _parsed(records: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    text = F.regexp_replace("text", "\r$", "")
    fields = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
    parsed = records.where((text != "") & (F.col("record") > 1)).select(F.from_csv(text, fields.toDDL(), options).alias("_row"))
    return parsed.select(*[F.col(f"_row.c{i}").alias(f.name) for i, f in enumerate(schema)])


def read_records(spark: SparkSession, path: str, schema: StructType, named: bool, options: dict[str, str]) -> DataFrame:
    """Typed rows of quoted CSV files with a header each; by position, or by the ``named`` columns of the header."""
    records = csv_records(spark, path)
    if not named:
        return _parsed(records, schema, options)
    headers = [r["text"].rstrip("\r") for r in records.where("record = 1").select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    names = next(csv.reader(headers), [])
    if missing := [f.name for f in schema if f.name not in names]:
        raise ValueError(f"no such columns in the header: {', '.join(missing)}")
    # Columns that nobody asked for are read as text, and may be called like one another.
    kinds = {f.name: f.dataType for f in schema}
    every = StructType([StructField(n if n in kinds else f"_c{i}", StringType()) for i, n in enumerate(names)])
    text = _parsed(records, every, options)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
