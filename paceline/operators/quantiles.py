"""Exact quantiles of very large groups, without sorting or listing a group.

A quantile is a value of the group: the smallest one such that at least its share of the rows do not exceed it. It is found
by narrowing a range of values. Each round counts the rows of a group's range in equal bins, by an aggregate that reduces inside
the tasks, finds the bin that holds the wanted rank, and goes on between the smallest and the largest value met in
it. Rounds end when these are one value. After each round the rows inside the ranges that are left are written to the
scratch folder, so the whole table is read for the first round alone.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.sources.tables import stage

BINS = 256
_MOST = 1.7976931348623157e308


def _narrow(rows: DataFrame, ranges: DataFrame, of: list[str], bins: int) -> DataFrame:
    """Each range cut down to the bin that holds its rank."""
    spans = ranges.select(*of, "low", "high").distinct()
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(spans[k]) for k in of], F.col("v").between(F.col("low"), F.col("high")))
    met = rows.join(spans, same).select(*[rows[k] for k in of], "low", "high", "v")
    # Halves, as the distance between two values may be too large for a double.
    part = (F.col("v") / 2 - F.col("low") / 2) / F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))
    inner = F.least(F.coalesce(F.floor(part * bins), F.lit(0)), F.lit(bins - 1))
    bin_ = F.when(F.col("v") <= F.col("low"), 0).when(F.col("v") >= F.col("high"), bins - 1).otherwise(inner)
    counts = met.groupBy(*of, "low", "high", bin_.alias("bin")).agg(
        F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    # A window has a row per bin.
    before = Window.partitionBy(*of, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    named = ranges.select(*[F.col(k).alias(f"of{k}") for k in of], "q", "rank", "n_all", F.col("low").alias("a"), F.col("high").alias("b"))
    own = [F.col(k).eqNullSafe(F.col(f"of{k}")) for k in of] + [F.col("low") == F.col("a"), F.col("high") == F.col("b")]
    holds = (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))
    found = counts.join(named, reduce(lambda a, b: a & b, own)).where(holds)
    return found.select(
        *of, "q", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("low"), F.col("most").alias("high"), "n_all"
    )


def _inside(rows: DataFrame, ranges: DataFrame, of: list[str]) -> DataFrame:
    same = [rows[k].eqNullSafe(ranges[k]) for k in of]
    return rows.join(ranges, reduce(lambda a, b: a & b, same, F.col("v").between(F.col("low"), F.col("high"))), "left_semi")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """For each key: ``n`` rows with a value, and a column per share, e.g. ``{"median_ms": 0.5, "p95_ms": 0.95}``.

    The value of rank ceil(share * n), at least 1, as ``percentile_disc`` gives it. NULL and NaN are no values; a key without
    values has no row, and an empty table none at all. NULL keys are a key. Infinite values count as the largest finite ones.
    """
    if wrong := [name for name, share in shares.items() if not 0 <= share <= 1]:
        raise ValueError(f"not a share: {', '.join(wrong)}")
    of = [f"_k{i}" for i in range(len(keys))]
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(_MOST)), F.lit(-_MOST))
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = usable.select(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], v.alias("v"))
    sizes = rows.groupBy(*of).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # Shares as decimals: 0.95 * 20 rows is rank 19, not a hair above it.
    exact = F.col("n").cast("decimal(20,0)")
    wanted = [
        F.struct(F.lit(i).alias("q"), F.greatest(F.ceil(exact * F.lit(Decimal(str(float(s))))).cast("bigint"), F.lit(1)).alias("rank"))
        for i, s in enumerate(shares.values())
    ]
    ranges = sizes.withColumn("wanted", F.explode(F.array(*wanted)))
    ranges = stage(ranges.select(*of, "wanted.q", "wanted.rank", "low", "high", F.col("n").alias("n_all")), "ranges")
    found = ranges.where("low = high")
    left = ranges.where("low < high")
    while not left.isEmpty():
        ranges = stage(_narrow(rows, left, of, bins), "ranges")
        found, left = found.unionByName(ranges.where("low = high")), ranges.where("low < high")
        rows = stage(_inside(rows, left, of), "rows")
    each = [F.max(F.when(F.col("q") == i, F.col("low"))).alias(name) for i, name in enumerate(shares)]
    result = found.groupBy(*of).agg(F.max("n_all").alias("n"), *each)
    # Without keys there is a row of no values at all.
    result = result.where("n > 0")
    return result.select(*[F.col(o).alias(k) for k, o in zip(keys, of, strict=True)], "n", *shares)
