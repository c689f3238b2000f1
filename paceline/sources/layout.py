"""How a table's files lie along its keys: their ranges, their order inside, and how many overlap.

A filter on the leading keys skips a file whose range does not hold the value, so what matters is how many files hold any one
value at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.sources.tables import stage

# Rows of a file that one window looks through.
BLOCK = 1_000_000


def file_ranges(spark: SparkSession, path: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """A row per Parquet file with rows: file, rows, least and most (structs of the keys), ordered.

    ``ordered`` tells whether the file's rows are sorted by the keys, NULLs first. Rows are compared with the one in front
    of them inside blocks, and blocks with the one in front by their ends, so a large file is many windows.
    """
    key = F.struct(*keys).alias("key")
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = spark.read.parquet(path).select(*meta, key)
    rows = rows.withColumn("block", F.call_function("div", F.col("at"), F.lit(block).cast("bigint")))
    own = Window.partitionBy("file", "block").orderBy("at")
    # A lag of NULL is none at all, as a key is a struct.
    falls = F.coalesce(F.lag("key").over(own) > F.col("key"), F.lit(False))
    blocks = rows.withColumn("falls", falls).groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("key").alias("least"),
        F.max("key").alias("most"),
        F.bool_or("falls").alias("falls"),
        F.min_by("key", "at").alias("first"),
        F.max_by("key", "at").alias("last"),
    )
    along = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("falls", F.col("falls") | F.coalesce(F.lag("last").over(along) > F.col("first"), F.lit(False)))
    return blocks.groupBy("file").agg(
        F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"), (~F.bool_or("falls")).alias("ordered")
    )


def overlap_depth(ranges: DataFrame) -> DataFrame:
    """One row: the largest number of ranges (``least`` to ``most``, ends included) that hold one value; 0 without any.

    A sweep over the ends: a range counts from its least value on and until after its greatest. Ends are dealt out by
    value ranges; what is open at the start of each part is the sum of the parts before.
    """
    ends = F.array(F.struct(F.col("least").alias("at"), F.lit(-1).alias("side")), F.struct(F.col("most").alias("at"), F.lit(1).alias("side")))
    events = ranges.select(F.explode(ends).alias("e")).select("e.at", "e.side", (-F.col("e.side")).cast("bigint").alias("change"))
    # Of ends at one value those that open come first.
    dealt = stage(events.repartitionByRange("at", "side").withColumn("part", F.spark_partition_id()), "ends")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("change").alias("change"))
    parts = parts.select("part", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("open"))
    inside = Window.partitionBy("part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth: Column = F.col("open") + F.sum("change").over(inside)
    return dealt.join(parts, "part").select(depth.alias("depth")).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def files_holding(ranges: DataFrame, value: Column) -> DataFrame:
    """The files a filter for one value of the leading key has to read."""
    leading = ranges.schema["least"].dataType.names[0]
    return ranges.where(value.between(F.col(f"least.{leading}"), F.col(f"most.{leading}")))


def layout_report(spark: SparkSession, path: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """One row: files, rows, ordered_files, and depth, the largest number of files that hold one key."""
    ranges = stage(file_ranges(spark, path, keys, block), "ranges")
    totals = ranges.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if("ordered").alias("ordered_files"))
    deepest = overlap_depth(ranges).first()["depth"]
    return totals.withColumn("depth", F.lit(deepest))
