"""Totals on several levels at once, and sketches of measurements that are kept and merged.

Levels (CUBE, ROLLUP, or a list of them) are added up from the sums of the finest one, so the input is read and reduced once,
and what is multiplied per level is a row per finest group, not a row per measurement. Sketches work alike: a small binary
summary per group and day is stored, and any longer time is answered from the summaries alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import rate, round2
from paceline.functions.measures import NANOS_PER_MS

# Rows of a sketch of distinct values: 2^12 registers, a standard error of 1.6 %.
HLL_LOG_K = 12
HLL_ERROR = 1.04 / 2 ** (HLL_LOG_K / 2)
# Accuracy of a quantile sketch, and the error of a rank that its 99 % bound allows.
KLL_K = 400
KLL_ERROR = 0.0067


def levels_of(keys: list[str], kind: str | list[list[str]]) -> list[list[str]]:
    """The key sets of a ``cube`` or a ``rollup``, or a list of key sets as it is; repeated sets count once."""
    if kind == "cube":
        return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]
    if kind == "rollup":
        return [keys[:n] for n in range(len(keys), -1, -1)]
    if isinstance(kind, str):
        raise ValueError(f"unknown kind of levels: {kind}")
    if unknown := sorted({k for level in kind for k in level} - set(keys)):
        raise ValueError(f"not among the keys: {', '.join(unknown)}")
    wanted = [[k for k in keys if k in level] for level in kind]
    return [level for i, level in enumerate(wanted) if level not in wanted[:i]]


def level_sums(df: DataFrame, keys: list[str], sums: dict[str, Column], kind: str | list[list[str]] = "cube") -> DataFrame:
    """``sums`` of each level's groups: the keys (NULL where a level leaves one out), ``level``, the sums.

    ``sums`` are expressions to be added up (bigint or decimal, so that they add up exactly), e.g. ``F.lit(1)`` to count.
    ``level`` has a bit per key, the last key's the lowest, set where the key is left out, as GROUPING_ID does; it tells a
    NULL of the data from one of a level. The level without keys has one row, of an empty input too if it is asked for alone.
    """
    if clash := sorted({"level", *sums} & set(keys)):
        raise ValueError(f"columns named {', '.join(clash)}")
    wanted = levels_of(keys, kind)
    if not keys or wanted == [[]]:
        nothing = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        totals = df.agg(*[F.sum(s).alias(name) for name, s in sums.items()])
        return totals.select(*nothing, F.lit(2 ** len(keys) - 1).cast("bigint").alias("level"), *sums)
    finest = df.groupBy(*keys).agg(*[F.sum(s).alias(name) for name, s in sums.items()])
    sets = [[F.col(k) for k in level] for level in wanted]
    grouped = finest.groupingSets(sets, *[F.col(k) for k in keys])
    summed = grouped.agg(F.grouping_id().cast("bigint").alias("level"), *[F.sum(name).alias(name) for name in sums])
    return summed.select(*keys, "level", *sums)


def import_totals(loads: DataFrame, keys: list[str], kind: str | list[list[str]] = "cube") -> DataFrame:
    """Import metrics of every level of the keys: tables, rows, total ms, mean ms per table and rows per second.

    As in ``import_metrics``, failed loads count as tables with 0 rows and 0 ms, and the mean and the rate use the unrounded total.
    """
    nanos = F.floor(F.coalesce(F.col("load_time_ms"), F.lit(0.0)) * NANOS_PER_MS + 0.5)
    sums = {
        "tables_imported": F.lit(1).cast("bigint"),
        "total_rows_loaded": F.coalesce(F.col("rows_loaded"), F.lit(0)).cast("bigint"),
        "_whole": F.call_function("div", nanos, F.lit(NANOS_PER_MS)),
        "_rest": nanos % NANOS_PER_MS,
    }
    totals = level_sums(loads, keys, sums, kind).withColumn("_ms", F.col("_whole") + F.col("_rest") / NANOS_PER_MS)
    return totals.select(
        *keys,
        "level",
        "tables_imported",
        "total_rows_loaded",
        round2("_ms").alias("total_import_time_ms"),
        round2(F.col("_ms") / F.col("tables_imported")).alias("average_table_import_time_ms"),
        round2(rate("total_rows_loaded", "_ms")).alias("csv_import_rate"),
    )


def sketch_runs(runs: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """A row per key: ``n`` runs, a sketch of the distinct values of one column and one of another's quantiles.

    The sketches are binary columns to be stored (about 6 KB a row at most). NULLs are in neither; ``n`` counts all rows.
    """
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, HLL_LOG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches of finer keys merged to coarser ones; the runs are not read again."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def sketch_report(sketches: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """What sketches say: n, n_distinct, and a column per share with that quantile (NULL without values)."""
    has = F.kll_sketch_get_n_double("value_sketch") > 0
    quantiles = [F.when(has, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(s)))).alias(name) for name, s in shares.items()]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *quantiles)
