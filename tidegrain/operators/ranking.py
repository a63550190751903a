"""Rows by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= n).drop("rank_")


def average_rank(keys: list[str], value: str) -> Column:
    """Ranks from 1 in which equal values share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2
