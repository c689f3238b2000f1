"""Whether two results hold the same rows, each as often, and where they do not.

Rows are dealt into buckets by a hash and each bucket is summed up in a few numbers that do not depend on the order of its
rows: their number, and sums of two independent hashes. Buckets of equal sums hold the same rows, but for a chance below
2^-60 for a bucket that differs. Only rows of other buckets are compared one by one, so two large results that agree cost
one aggregate over each, and no shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.sources.tables import stage

BUCKETS = 1 << 16
# Rows of sums on either side are few; a sum of 32-bit halves holds for 2^31 rows a bucket.
_HALF = 0xFFFFFFFF


def _check(left: DataFrame, right: DataFrame) -> None:
    kinds = [[f.dataType for f in df.schema] for df in (left, right)]
    if [k.simpleString() for k in kinds[0]] != [k.simpleString() for k in kinds[1]]:
        raise ValueError("the results have other column types")
    for df in (left, right):
        if "map<" in df.schema.simpleString():
            raise ValueError("columns with maps cannot be compared")


def _hash(columns: list[str], seed: int) -> Column:
    """A hash of a row that tells a NULL from a missing neighbour: Spark's skips NULLs."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(_hash(df.columns, 0), F.lit(buckets)).cast("int"))


def _sums(df: DataFrame, buckets: int, suffix: str) -> DataFrame:
    """A row per bucket: rows, and the sums of both halves of a hash."""
    columns = df.columns
    hashed = _bucketed(df, buckets).select("_bucket", _hash(columns, 1).alias("h"))
    return hashed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias(f"rows_{suffix}"),
        F.sum(F.col("h").bitwiseAND(_HALF)).alias(f"low_{suffix}"),
        F.sum(F.shiftrightunsigned("h", 32)).alias(f"high_{suffix}"),
    )


def compare_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each bucket that some row falls into: _bucket, rows_left, rows_right, same."""
    _check(left, right)
    right = right.toDF(*left.columns)
    sums = _sums(left, buckets, "left").join(_sums(right, buckets, "right"), "_bucket", "full")
    same = F.lit(True)
    for name in ("rows", "low", "high"):
        same = same & F.col(f"{name}_left").eqNullSafe(F.col(f"{name}_right"))
    rows = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_left", "rows_right")]
    return sums.select("_bucket", *rows, same.alias("same"))


def same_rows(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: rows_left, rows_right, and whether both hold the same rows equally often.

    Columns are compared by position; types must be the same, names need not be. NULL equals NULL. Two empty results are equal.
    """
    found = compare_buckets(left, right, buckets)
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_left", "rows_right")]
    return found.agg(*total, F.coalesce(F.bool_and("same"), F.lit(True)).alias("equal"))


def row_differences(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that one result holds more often than the other, with how often each has them: n_left, n_right.

    EXCEPT ALL in both directions at once, over the buckets that differ: these are found and written first, so that the rows
    of all others are left out where they are read. A row with many copies is counted in the tasks before it is shuffled.
    """
    if clash := sorted({"n_left", "n_right", "_bucket"} & set(left.columns)):
        raise ValueError(f"columns named {', '.join(clash)}")
    differ = stage(compare_buckets(left, right, buckets).where(~F.col("same")).select("_bucket"), "buckets")
    sides = []
    for df, (n_left, n_right) in ((left, (1, 0)), (right.toDF(*left.columns), (0, 1))):
        rows = _bucketed(df, buckets).join(differ, "_bucket", "left_semi").drop("_bucket")
        sides.append(rows.withColumns({"n_left": F.lit(n_left).cast("bigint"), "n_right": F.lit(n_right).cast("bigint")}))
    counts = sides[0].unionByName(sides[1]).groupBy(*[f"`{c}`" for c in left.columns])
    summed = counts.agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return summed.where("n_left <> n_right")
