"""Imports as a stream of files: rows that break a rule go to quarantine, the others replace rows of the same keys.

A micro-batch writes what it changes and nothing else: its good rows, the last of each key, under ``changes``, and every bad row under
``quarantine``. A batch that is run again after a failure overwrites its own folders from the same rows, so imports are idempotent. The
table is read as the last change of each key; ``compact`` folds the changes so far into one base, which readers then start from.

Rules are applied before rows of one key are compared, so a bad row never hides a good one. A row without a key goes to quarantine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrain.operators.checks import DataRefused, union_all
from tidegrain.operators.clean import quarantine

BATCH = "import_batch_"
NO_KEY = "KEY_MISSING"


def last_of_batch(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Of rows of equal keys the one that is greatest by ``order``, then by its other columns in turn."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    first = [c for c in (order or []) if c in rest]
    by = F.struct(*[F.col(c) for c in first + [c for c in rest if c not in first]])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r_")).select(*keys, "r_.*").select(*rows.columns)


def import_stream(source: DataFrame, path: str, keys: list[str], rules: dict[str, Column], checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Start the import of a streaming DataFrame; it stops when what is there has been read."""
    missing = {NO_KEY: ~F.lit(True)}
    for k in keys:
        missing = {NO_KEY: missing[NO_KEY] | F.col(k).isNull()}

    def one(rows: DataFrame, batch: int) -> None:
        good, away = quarantine(rows, {**missing, **rules})
        away.write.mode("overwrite").parquet(f"{path}/quarantine/{BATCH}={batch}")
        last_of_batch(good, keys, order).write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are written whole under ``folder``, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{BATCH}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(re.search(rf"{BATCH}=(\d+)", s.getPath().toString())[1]) for s in found or [])


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table after the last finished batch: the base of the last compaction with the last change of each key since."""
    bases = finished(spark, f"{path}/base")
    since = [b for b in finished(spark, f"{path}/changes") if not bases or b > bases[-1]]
    read = lambda folder, b: spark.read.parquet(f"{path}/{folder}/{BATCH}={b}").withColumn(BATCH, F.lit(b).cast("long"))
    parts = [read("base", b) for b in bases[-1:]] + [read("changes", b) for b in since]
    if not parts:
        raise DataRefused(f"NOTHING_IMPORTED: {path}")
    if len(parts) == 1:
        return parts[0].drop(BATCH)
    rows = union_all(parts)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    if not rest:
        return rows.drop(BATCH).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("r_")).select(*keys, "r_.*")


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Write the table so far as a base; returns the batch it holds up to. Changes stay, for readers of what a batch did."""
    last = finished(spark, f"{path}/changes")[-1:]
    if not last:
        raise DataRefused(f"NOTHING_IMPORTED: {path}")
    if last[0] not in finished(spark, f"{path}/base"):
        current(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base/{BATCH}={last[0]}")
    return last[0]
