"""Tables that a plan reads several times, written once where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir (a temporary folder where that is unset, as in tests), its lineage cut."""
    _folder(df)
    return df.checkpoint()


def keep_table(df: DataFrame) -> DataFrame:
    """``df`` as ``keep`` has it, but in Parquet: many rows that are read more than once, each time some of their columns."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
