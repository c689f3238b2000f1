"""Declared constraints as checks.

Spark's file tables accept rows that break a primary key, a NOT NULL, a reference or a length limit, so
each constraint is an operator that finds those rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paceline.sources.tables import stage


def pk_violations(df: DataFrame, key: list[str], by_hash: bool = False) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with their number of rows ``n``.

    Rows of one key are counted before the shuffle, so a key that fills a third of the table costs one
    row per task.

    Nearly all keys of a good table occur once, and all of them are shuffled to learn that. With wide keys, such as texts or
    many columns, ``by_hash`` shuffles 64-bit hashes of the keys first. Only keys of a hash that occurs more than once are
    shuffled as they are and counted exactly, which also parts keys that share a hash. The table is read twice.
    """
    has_null = F.lit(False)
    for column in key:
        has_null = has_null | F.col(column).isNull()
    if not by_hash:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | has_null)
    rows = df.select(*key)
    whole = rows.where(~has_null).withColumn("_hash", F.xxhash64(*key))
    hashes = whole.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    # Few, if the table is nearly good: their true number decides whether they are broadcast.
    suspects = whole.join(stage(hashes, "hashes"), "_hash", "left_semi").drop("_hash")
    counted = suspects.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.unionByName(rows.where(has_null).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs in each column, one row per column, from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "null_rows")


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, staged: bool = False) -> DataFrame:
    """Child rows whose parent does not exist. A NULL reference is no orphan.

    NULL references leave before the join, so they never meet in one partition. A small parent is
    broadcast and nothing is shuffled. With a large one, whole child rows would be: ``staged`` then looks
    for the orphans among the distinct references first, which reads and shuffles one column, and writes
    the keys it finds to the scratch folder. Orphans being few, the child meets them in a broadcast.
    """
    child = child.where(F.col(fk).isNotNull())
    keys = parent.select(F.col(pk).alias("_pk"))
    if not staged:
        return child.join(keys, F.col(fk) == F.col("_pk"), "left_anti")
    found = child.select(F.col(fk).alias("_fk")).distinct()
    orphans = stage(found.join(keys, F.col("_fk") == F.col("_pk"), "left_anti"), "orphan_keys")
    return child.join(orphans, F.col(fk) == F.col("_fk"), "left_semi")


class Cascade(NamedTuple):
    """What is left after a delete."""

    parent: DataFrame
    child: DataFrame


def cascade_delete(
    parent: DataFrame, child: DataFrame, where: Column, pk: str, fk: str, staged: bool = False
) -> Cascade:
    """Delete parent rows that match ``where`` and the child rows that refer to them.

    How many parents match is not known when the join is planned, so with a large parent both sides would
    be shuffled. ``staged`` writes the deleted keys to the scratch folder first; if they are few, the child
    is only scanned.
    """
    hit = F.coalesce(where, F.lit(False))
    gone = parent.where(hit).select(F.col(pk).alias("_pk"))
    if staged:
        gone = stage(gone, "deleted_keys")
    return Cascade(parent.where(~hit), child.join(gone, F.col(fk) == F.col("_pk"), "left_anti"))


# Text that can be a number: sign, digits with at most one point, exponent, blanks around it.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _misfit(df: DataFrame, column: str, kind: str) -> Column:
    """Whether a value has no place in a type.

    A failing cast raises and catches an error inside Spark, which is slow for many bad rows. So decimals
    are first compared with the type's limit as doubles, and only values near the limit are cast.
    """
    kind, c = kind.strip().lower(), F.col(column)
    if length := re.fullmatch(r"varchar2?\((\d+)\)", kind):
        return F.length(c) > int(length[1])
    digits = re.fullmatch(r"(?:decimal|numeric|number)\((\d+),\s*(\d+)\)", kind)
    if not digits:
        return c.isNotNull() & c.try_cast(kind).isNull()
    precision, scale = int(digits[1]), int(digits[2])
    is_text = isinstance(df.schema[column].dataType, StringType)
    size = F.abs(F.when(c.rlike(NUMBER), c.cast("double")) if is_text else c.cast("double"))
    limit = 10.0 ** (precision - scale)
    return c.isNotNull() & (
        F.when(size.isNull() | (size > limit * 1.01), True)
        .when(size < limit * 0.99, False)
        .otherwise(c.try_cast(f"decimal({precision},{scale})").isNull())
    )


def type_violations(df: DataFrame, limits: dict[str, str]) -> DataFrame:
    """Rows with a value that does not fit, e.g. ``{"name": "varchar(100)", "amount": "decimal(10,2)"}``.

    The column ``violations`` names them, separated by commas. Text does not fit a varchar it is too long
    for; a number does not fit a decimal with too few digits before the point, nor does text that is no
    number. Digits beyond the scale are rounded and fit. Other types are tested by casting.
    """
    broken = [F.when(_misfit(df, column, kind), F.lit(column)) for column, kind in limits.items()]
    return df.withColumn("violations", F.concat_ws(",", *broken)).where(F.col("violations") != "")


def with_default(df: DataFrame, column: str, default: Column | None = None) -> DataFrame:
    """Fill a column's NULLs, or add the column, with its default: the current time if none is given."""
    default = F.current_timestamp() if default is None else default
    return df.withColumn(column, F.coalesce(F.col(column), default) if column in df.columns else default)
