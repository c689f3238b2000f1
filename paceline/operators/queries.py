"""The fixed query shapes: scan, join, aggregate, count and filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q_read(df: DataFrame) -> DataFrame:
    """Every row and column."""
    return df.select("*")


def q_join(
    users: DataFrame, orders: DataFrame, min_amount, limit: int | None = 100, order_by: list[str] | None = None
) -> DataFrame:
    """Name, amount and date of orders above ``min_amount``.

    With a limit but no order any rows may come, as in the query this stands for. ``order_by`` names order
    columns and makes it a top-k, which each task cuts to ``limit`` rows before anything is collected.
    The bound is compared with ``amount`` as it is stored, so the filter reaches the file scan.
    """
    matched = orders.where(F.col("amount") > F.lit(min_amount)).join(
        users.select(F.col("id").alias("_user"), "name"), F.col("user_id") == F.col("_user")
    )
    if order_by:
        matched = matched.orderBy(*[F.col(c) for c in order_by])
    if limit is not None:
        matched = matched.limit(limit)
    return matched.select("name", "amount", "order_date")


def q_aggregate(users: DataFrame, orders: DataFrame, min_total) -> DataFrame:
    """Total and number of orders of each user whose total is above ``min_total``.

    Users are told apart by id, which is not shown: equal names stay separate rows. Orders are summed per
    user before the join, so a user with a third of all orders reaches the join as one row, and the
    groups after it need no second shuffle.
    """
    per_user = orders.groupBy("user_id").agg(F.sum("amount").alias("_sum"), F.count("id").alias("_count"))
    return (
        per_user.join(users.select(F.col("id").alias("_user"), "name"), F.col("user_id") == F.col("_user"))
        .groupBy("user_id", "name")
        .agg(F.sum("_sum").alias("total_spent"), F.sum("_count").alias("order_count"))
        .where(F.col("total_spent") > F.lit(min_total))
        .select("name", "total_spent", "order_count")
    )


def q_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def q_filter(df: DataFrame, column: str, bound) -> DataFrame:
    """Rows whose column is above the bound."""
    return df.where(F.col(column) > F.lit(bound))
