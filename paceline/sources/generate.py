"""Generated users and orders, one order per user.

Both are ranges with computed columns: no shuffle, and every task makes its own slice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.values import EMAIL_END, EMAIL_START, FIRST_AMOUNT, USER_NAME_END, USER_NAME_START

ROWS_PER_TASK = 5_000_000


def _range(spark: SparkSession, n: int) -> DataFrame:
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return spark.range(0, max(n, 0), 1, tasks)


def gen_users(spark: SparkSession, n: int) -> DataFrame:
    """``n`` users with ids 1..n.

    The name is the text ``BenchUser_``, the zero-based row number and a ``1`` side by side, so the first
    is ``BenchUser_01`` and the thirteenth ``BenchUser_121``.
    """
    i = F.col("id").cast("string")
    return _range(spark, n).select(
        (F.col("id") + 1).alias("id"),
        F.concat(F.lit(USER_NAME_START), i, F.lit(USER_NAME_END)).alias("name"),
        F.concat(F.lit(EMAIL_START), (F.col("id") + 1).cast("string"), F.lit(EMAIL_END)).alias("email"),
    )


def gen_orders(
    spark: SparkSession, n: int, order_date: dt.date, amount_type: str = "decimal(10,2)"
) -> DataFrame:
    """One order for each of ``n`` users; amounts start at 10.00 and go up by one.

    Amounts pass the limit of decimal(10,2) near 10^8 orders and the cast then fails; give a wider
    ``amount_type`` for more.
    """
    return _range(spark, n).select(
        (F.col("id") + 1).alias("id"),
        (F.col("id") + 1).alias("user_id"),
        (F.col("id") + FIRST_AMOUNT).cast(amount_type).alias("amount"),
        F.lit(order_date).cast("date").alias("order_date"),
    )
