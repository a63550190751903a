"""Exact ranks and order statistics of tables of any size: no task sorts a whole group.

Equal values are counted first, so a value that fills a third of the rows is one row. The counts are dealt by range of (keys, value) and
written, which fixes the ranges; a range's offset is the sum of those before it, one row a key and range, and ranks inside a range come
from a window over that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.sources.keep import keep


def value_ranks(df: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """keys, value, n (rows of the value), below (rows of the key with a lesser value), place (lesser distinct values), total (rows of the key).

    Rows of a null value are left out; keys must not be null. ``count`` names how many rows a row stands for. An empty table gives an
    empty table.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("n"))
    fixed = keep(counts.repartitionByRange(*keys, value)).withColumn("range_", F.spark_partition_id())
    ranges = fixed.groupBy(*keys, "range_").agg(F.sum("n").alias("n_"), F.count("*").alias("v_"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = key.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = ranges.select(*keys, "range_", F.coalesce(F.sum("n_").over(before), none).alias("rows_"), F.coalesce(F.sum("v_").over(before), none).alias("values_"), F.sum("n_").over(key).alias("total"))
    inside = Window.partitionBy(*keys, "range_").orderBy(value)
    ranked = fixed.withColumn("to_", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row_", F.row_number().over(inside))
    met = ranked.join(offsets, [*keys, "range_"])
    return met.select(*keys, value, "n", (F.col("rows_") + F.col("to_") - F.col("n")).alias("below"), (F.col("values_") + F.col("row_") - 1).alias("place"), "total")


def at_rank(rank: Column, value: str) -> Column:
    """Aggregate over rows of ``value_ranks`` by key: the value of the row of a rank (from 1); null beyond the rows."""
    return F.max(F.when((F.col("below") < rank) & (rank <= F.col("below") + F.col("n")), F.col(value)))


def at_share(share: float, value: str) -> Column:
    """Aggregate over rows of ``value_ranks`` by key: the quantile of a share, interpolated between the two rows around it."""
    at = (F.col("total") - 1) * F.lit(float(share))
    low, high = at_rank(F.floor(at) + 1, value), at_rank(F.ceil(at) + 1, value)
    return low + (high - low) * F.max(at - F.floor(at))


def codes(df: DataFrame, value: str) -> DataFrame:
    """value, code: the distinct values in order, from 0."""
    return value_ranks(df, [], value).select(value, F.col("place").cast("int").alias("code"))
