"""Revisions of a stored table by an incoming one, each by keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import guard


def conflicts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that share a key with an existing row but differ in a value."""
    values = [c for c in incoming.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values])
    differs = reduce(lambda a, c: a | ~F.col(c).eqNullSafe(F.col(f"old_{c}")), values, F.lit(False))
    return incoming.join(old, keys).where(differs).select(*incoming.columns)


def append(existing: DataFrame, incoming: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Adds rows of new keys; equal rows are skipped; conflicting ones stop the job (``strict``) or are left out."""
    if strict:
        guard(conflicts(existing, incoming, keys), "CONFLICTING_APPEND")
    return existing.unionByName(incoming.join(existing, keys, "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(incoming, keys, "left_anti").unionByName(incoming)


def replace_scope(existing: DataFrame, incoming: DataFrame, scope: Column) -> DataFrame:
    """Rows of ``existing`` outside the scope, and ``incoming``, which must lie inside it."""
    guard(incoming.where(~F.coalesce(scope, F.lit(False))), "OUTSIDE_SCOPE")
    return existing.where(~F.coalesce(scope, F.lit(False))).unionByName(incoming)


def import_once(batches: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Batches that were not imported before, each once."""
    return batches.join(seen, keys, "left_anti").dropDuplicates(keys)
