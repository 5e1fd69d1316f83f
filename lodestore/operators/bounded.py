"""The first rows of each group, kept down before they are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark limits a group before its exchange up to so many rows (spark.sql.optimizer.windowGroupLimitThreshold).
MOST = 1000


def firsts(rows: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The n first rows of each group by order, n from 1 to 1000; equal rows in any order, nulls are a group.

    A task sends n rows of a group at most, so a group of any size reaches its task as n rows
    times the number of tasks that hold it.
    """
    if not 1 <= n <= MOST:
        raise ValueError(f"n must be from 1 to {MOST}")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def firsts_different(rows: DataFrame, by: list[str], key: str, order: list[str | Column], n: int) -> DataFrame:
    """Of each group the first row of every key, and of those the n first."""
    return firsts(firsts(rows, [*by, key], order, 1), by, order, n)
