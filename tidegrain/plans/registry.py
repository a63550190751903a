"""Where queries and their SQL twins are kept; SQL twins share common table expressions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = {}  # name -> SQL of a common table expression, in the order in which they may refer to each other


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def with_parts(names: str, body: str) -> str:
    """``body`` with the named expressions and all those before them that they mention."""
    wanted = set(names.split())
    for name in reversed(list(PARTS)):
        if name in wanted:
            wanted |= {other for other in PARTS if other != name and f"@{other}" in PARTS[name]}
    listed = [f"{name} AS ({PARTS[name].replace('@', '')})" for name in PARTS if name in wanted]
    return ("WITH RECURSIVE " + ",\n".join(listed) + (body if body.startswith(",") else "\n" + body)) if listed else body


def query(name: str, parts: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_parts(parts, sql)
        return f

    return add
