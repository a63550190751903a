"""Shared plumbing: Arrow batches in bounded slices, and checkpoints that other executors can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of one slice is about ``limit`` bytes; a single longer text stays whole."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            pa.default_memory_pool().release_unused()
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null reads as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, work: Callable[[pa.Array, list[str]], pa.RecordBatch], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run ``work(ids, texts)`` over slices of (id, text). Only those two columns (and ``extra``) are read."""
    chosen = df.select(df[id_col], df[text_col].cast("string"), *[df[c] for c in extra])

    def run(batches):
        for part in slices(batches):
            yield work(part, texts_of(part.column(1)))

    return chosen.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir; where it is unset (tests), a temporary one is set for the session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through files that every executor can read, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for readers of a part of its columns or rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_by_hash(ids: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` ids of least hash of a one-column table (all, if fewer; nulls left out).

    A first cut by the hash leaves about 8 ``k`` rows, so that the final ordering gathers no more, however large the table is.
    """
    n = ids.count()
    found = ids.where(F.col(id_col).isNotNull()).withColumn("h_", F.xxhash64(id_col))
    if n > 16 * k:
        found = found.where(F.col("h_") < -(1 << 63) + int((1 << 64) * (8 * k / n)))
    return found.distinct().orderBy("h_", id_col).limit(k).select(id_col)


def crc_bucket(id_col: str = "doc_id", buckets: int = 5):
    """crc32 of the id as text, modulo ``buckets``; a null id counts as bucket 1 (never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(buckets)), F.lit(1))
