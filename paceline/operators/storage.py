"""Storage footprint of tables: measured on files, or computed from catalog listings.

A catalog listing has a row per segment, part or block; collected over many servers it is a large table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import bytes_per_row, size_mb
from paceline.session import report_rows


def table_location(spark: SparkSession, table: str) -> tuple[str, str]:
    """Folder and file format of a catalog table."""
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(F.col("col_name").isin("Location", "Provider"))
    found = {row["col_name"]: row["data_type"] for row in detail.collect()}
    return found["Location"], found["Provider"]


def _folder_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes of a folder (or file) without and with hidden files, from the file system's own summary."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    total = fs.getContentSummary(where).getLength()
    hidden = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "[_.]*")) or []
    return total - sum(fs.getContentSummary(f.getPath()).getLength() for f in hidden), total


# What makes the reader of Parquet files count rows by their footers.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts, and least and greatest values, come from the files' footers without reading a row.

    That reader has to be chosen by settings, so the table is that of a session of its own; the caller's keeps its settings.
    Filters on columns that are no partitions need rows, and are read as usual.
    """
    own = spark.newSession()
    for name, value in FOOTER_SETTINGS.items():
        own.conf.set(name, value)
    return own.read.parquet(path)


SIZED = "position int, table_name string, data_size_bytes bigint, total_size_bytes bigint"


def table_stats(spark: SparkSession, tables: dict[str, str], fmt: str = "parquet", from_footers: bool = False) -> DataFrame:
    """Rows and bytes of tables, given as name and path (or name of a catalog table).

    Rows are counted without reading a column, one count per table; with ``from_footers``, those of Parquet folders by their
    footers alone. Sizes are file system metadata: one summary per
    table's folder. Total bytes are those of all files; data bytes leave out hidden files, and are 0 for a table
    without rows. No tables: no rows.
    """
    counts, sizes = [], []
    for position, (name, source) in enumerate(tables.items()):
        path, source_fmt = (source, fmt) if "/" in source else table_location(spark, source)
        if from_footers and "/" in source and source_fmt == "parquet":
            scan = footers(spark, path)
        else:
            scan = spark.read.format(source_fmt).load(path) if "/" in source else spark.table(source)
        counts.append(scan.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count"))
        sizes.append((position, name, *_folder_bytes(spark, path)))
    sized = report_rows(spark, sizes, SIZED)
    labels = ["position", "table_name"]
    if not counts:
        return _statistics(sized.withColumn("row_count", F.lit(0).cast("bigint")), labels)
    joined = sized.join(reduce(DataFrame.unionByName, counts), "table_name", "left")
    data = F.when(F.col("row_count") > 0, F.col("data_size_bytes")).otherwise(F.lit(0).cast("bigint"))
    return _statistics(joined.withColumn("data_size_bytes", data), labels)


def _statistics(joined: DataFrame, labels: list[str]) -> DataFrame:
    rows = F.coalesce(F.col("row_count"), F.lit(0).cast("bigint"))
    return joined.select(
        *labels,
        rows.alias("row_count"),
        "data_size_bytes",
        "total_size_bytes",
        size_mb("total_size_bytes").alias("total_size_mb"),
        F.when(F.col("data_size_bytes").isNotNull(), bytes_per_row("data_size_bytes", rows)).alias("bytes_per_row"),
    )


def footprint(tables: DataFrame, counts: DataFrame, sizes: DataFrame, key: str | list[str] = "table_name") -> DataFrame:
    """Statistics rows for every listed table from its row count and its sizes.

    A table without a count has 0 rows. One the catalog does not list keeps its name, with NULL sizes.
    """
    return _statistics(tables.join(counts, key, "left").join(sizes, key, "left"), tables.columns)


def sum_segments(catalog: DataFrame, schema: str | None = None, table: str | None = None) -> DataFrame:
    """Data, index and total bytes of each listed table, optionally of one schema or one table."""
    if schema is not None:
        catalog = catalog.where(F.col("table_schema") == schema)
    if table is not None:
        catalog = catalog.where(F.col("table_name") == table)
    return catalog.select(
        "table_schema",
        "table_name",
        F.col("data_length").alias("data_size_bytes"),
        F.col("index_length").alias("index_size_bytes"),
        (F.col("data_length") + F.col("index_length")).alias("total_size_bytes"),
    )


def active_parts_size(parts: DataFrame) -> DataFrame:
    """Bytes on disk of each table's active parts; data and total are the same there.

    A table whose parts are all inactive stays, with 0 bytes.
    """
    size = F.coalesce(F.sum(F.when(F.col("active"), F.col("bytes_on_disk"))), F.lit(0).cast("bigint"))
    return parts.groupBy("database", "table").agg(size.alias("data_size_bytes"), size.alias("total_size_bytes"))


def segment_sizes(segments: DataFrame, indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """Bytes of each table's own segment, and of that and its indexes together.

    Table names are compared in upper case. Segments are added up by name first, so what is joined has one row per
    segment name, however many extents were listed; the list of indexes may repeat itself. One join finds the
    tables that a segment counts for, and one aggregate adds them up.
    """
    by_name = segments.groupBy("segment_name").agg(
        F.sum(F.when(F.col("segment_type") == "TABLE", F.col("bytes"))).alias("_table_bytes"),
        F.sum("bytes").alias("_bytes"),
    )
    own = tables.select(F.upper("table_name").alias("segment_name"), F.upper("table_name").alias("_upper"))
    of_index = indexes.select(F.col("index_name").alias("segment_name"), F.col("table_name").alias("_upper"))
    owners = own.union(of_index).distinct()
    sizes = (
        owners.join(by_name, "segment_name")
        .groupBy("_upper")
        .agg(
            F.sum(F.when(F.col("segment_name") == F.col("_upper"), F.col("_table_bytes"))).alias("_data"),
            F.sum("_bytes").alias("_total"),
        )
    )
    zero = F.lit(0).cast("bigint")
    named = tables.select("table_name").distinct().withColumn("_upper", F.upper("table_name"))
    return named.join(sizes, "_upper", "left").select(
        "table_name",
        F.coalesce("_data", zero).alias("data_size_bytes"),
        F.coalesce("_total", zero).alias("total_size_bytes"),
    )


def block_sizes(blocks: DataFrame, block_size: int) -> DataFrame:
    """Distinct stored blocks of each table times the block size; rows without a block do not count.

    Spark removes repeated blocks inside the tasks and spreads one table's blocks over all partitions
    before it counts them, so a table with a third of the blocks is no hot spot.
    """
    size = F.count_distinct("block_id") * F.lit(block_size).cast("bigint")
    sizes = blocks.groupBy("table_name").agg(size.alias("size_bytes"))
    return sizes.withColumn("size_mb", size_mb("size_bytes"))
