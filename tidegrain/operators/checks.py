"""Checks that either stop a job or turn into issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataRefused(ValueError):
    """Rows break a rule that the next step relies on."""


def guard(bad: DataFrame, code: str) -> None:
    """Stop if ``bad`` has a row; reads no further than the first."""
    first = bad.take(1)
    if first:
        raise DataRefused(f"{code}: {first[0].asDict()}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def failed(rules: dict[str, Column]) -> Column:
    """Codes of the rules a row breaks, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]), lambda x: x.isNotNull())


def counts_of(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule."""
    return df.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(code) for code, broken in rules.items()])


def issue_rows(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per broken rule: the columns ``keep`` and ``issue``."""
    return df.select(*keep, F.explode(failed(rules)).alias("issue"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
