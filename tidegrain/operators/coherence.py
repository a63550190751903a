"""Coherence of artifacts: declared relations between tables, checked by one full outer join for each pair, as issue rows.

A pair names two tables and the keys on which their rows belong together; its checks look at a row of the join. So a dozen checks of two
tables cost one shuffle. Pairs without keys compare each row of the left table with the one row of the right (a request, a window).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import DataRefused, union_all


class Side:
    """A table's columns in a join: ``side("name")``, and ``side.here``, whether the row has this side."""

    def __init__(self, prefix: str):
        self.prefix, self.here = prefix, F.coalesce(F.col(f"{prefix}here"), F.lit(False))

    def __call__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")


class Check(NamedTuple):
    code: str
    broken: Callable[[Side, Side], Column]
    severity: str = "ERROR"
    blocking: bool = True


class Pair(NamedTuple):
    left: str
    right: str
    keys: list[str]
    checks: list[Check]


def only_left(code: str, **kind) -> Check:
    return Check(code, lambda a, b: a.here & ~b.here, **kind)


def only_right(code: str, **kind) -> Check:
    return Check(code, lambda a, b: b.here & ~a.here, **kind)


def differs(code: str, left: str, right: str | None = None, tolerance: float | None = None, **kind) -> Check:
    """Both sides are there and their values are not the same, or not within ``tolerance`` (absolute, and relative to the greater)."""

    def broken(a: Side, b: Side) -> Column:
        x, y = a(left), b(right or left)
        if tolerance is None:
            return a.here & b.here & ~x.eqNullSafe(y)
        near = F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        return a.here & b.here & ~F.coalesce(near, x.isNull() & y.isNull())

    return Check(code, broken, **kind)


def outside(code: str, value: str, low: str, high: str, **kind) -> Check:
    """The left value is not between two values of the right; a missing value is outside."""
    return Check(code, lambda a, b: a.here & b.here & ~F.coalesce(a(value).between(b(low), b(high)), F.lit(False)), **kind)


def holds(code: str, test: Callable[[Side, Side], Column], **kind) -> Check:
    """``test`` must be true wherever both sides are; null counts as false."""
    return Check(code, lambda a, b: a.here & b.here & ~F.coalesce(test(a, b), F.lit(False)), **kind)


def _rows(joined: DataFrame, pair: Pair, key: Column) -> DataFrame:
    a, b = Side("a_"), Side("b_")
    found = F.array(*[F.when(F.coalesce(c.broken(a, b), F.lit(False)), F.struct(F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"), F.lit(c.blocking).alias("blocking"))) for c in pair.checks])
    rows = joined.select(key.alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.code", "x.severity", "x.blocking", F.array(F.lit(pair.left), F.lit(pair.right)).alias("paths"), "key")


def check_pairs(tables: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """code, severity, blocking, paths (the tables), key (the row's keys as JSON; of the left row where a pair has none): an issue for each row that breaks a check."""
    out = []
    for pair in pairs:
        unknown = {pair.left, pair.right} - set(tables)
        if unknown:
            raise DataRefused(f"UNKNOWN_ARTIFACT: {sorted(unknown)}")
        a, b = tables[pair.left], tables[pair.right]
        left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.lit(True).alias("a_here"))
        right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.lit(True).alias("b_here"))
        if pair.keys:
            same = F.lit(True)
            for k in pair.keys:
                same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
            key = F.to_json(F.struct(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in pair.keys]))
            out.append(_rows(left.join(right, same, "full"), pair, key))
        else:
            one = right.limit(2)
            if len(one.take(2)) != 1:
                raise DataRefused(f"NOT_ONE_ROW: {pair.right}")
            out.append(_rows(left.join(F.broadcast(one), F.lit(True)), pair, F.to_json(F.struct(*[F.col(f"a_{c}").alias(c) for c in a.columns]))))
    return union_all(out)


def repeated(table: DataFrame, name: str, keys: list[str], code: str, severity: str = "ERROR", blocking: bool = True) -> DataFrame:
    """An issue for each key that several rows have."""
    again = table.groupBy(*keys).agg(F.count("*").alias("n_")).where("n_ > 1")
    return again.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(blocking).alias("blocking"), F.array(F.lit(name)).alias("paths"), F.to_json(F.struct(*keys)).alias("key"))


def wrong_total(table: DataFrame, name: str, keys: list[str], value: str, total: float, code: str, tolerance: float = 1e-6, severity: str = "ERROR", blocking: bool = True) -> DataFrame:
    """An issue for each group of ``keys`` whose values do not add up to ``total``, or are missing in part."""
    sums = table.groupBy(*keys).agg(F.sum(value).alias("s_"), F.count_if(F.col(value).isNull()).alias("m_"))
    bad = sums.where(~F.coalesce(F.abs(F.col("s_") - F.lit(float(total))) <= tolerance, F.lit(False)) | (F.col("m_") > 0))
    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    return bad.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(blocking).alias("blocking"), F.array(F.lit(name)).alias("paths"), key.alias("key"))


def report(issues: DataFrame) -> DataFrame:
    """One row a code: n, severity and blocking at their gravest, the tables named, the least key."""
    named = issues.groupBy("code").agg(F.count("*").alias("n"), F.max(F.struct(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0).alias("g"), "severity"))["severity"].alias("severity"), F.bool_or("blocking").alias("blocking"), F.array_sort(F.flatten(F.collect_set("paths"))).alias("paths"), F.min("key").alias("first_key"))
    return named.withColumn("paths", F.array_distinct("paths"))
