"""Declared operations on columns, applied in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.functions import text as T


def apply_operations(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Steps: (trim, col), (cast, col, type), (parse_number, col), (parse_date, col, locale), (lookup, col, codes), (convert, col, unit col, from, to, factor).

    A lookup keeps rows whose code is known; ``codes`` has the columns code and meaning. A conversion rewrites the unit column too and
    leaves rows of other units alone.
    """
    for name, column, *rest in steps:
        c = F.col(column)
        if name == "trim":
            df = df.withColumn(column, T.clean(c))
        elif name == "cast":
            df = df.withColumn(column, c.try_cast(rest[0]))
        elif name == "parse_number":
            df = df.withColumn(column, T.parse_number(c))
        elif name == "parse_date":
            df = df.withColumn(column, T.parse_date(c, *rest))
        elif name == "lookup":
            kept = [F.col("meaning").alias(column) if k == column else F.col(k) for k in df.columns]
            df = df.join(rest[0], c == F.col("code")).select(*kept)
        elif name == "convert":
            unit, old, new, factor = rest
            df = df.withColumn(column, F.when(F.col(unit) == old, c * F.lit(factor)).otherwise(c)).withColumn(unit, F.when(F.col(unit) == old, new).otherwise(F.col(unit)))
        else:
            raise ValueError(f"unknown operation {name}")
    return df
