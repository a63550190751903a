"""Corpus pipeline: quality, near duplicates, secrets, mixture, tokens. Each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``:

- quality: documents that the classifier (learned from ``labels``) rejects go.
- near_duplicates: one document of each group of near duplicates (5-word shingles, similarity 0.8) stays, the one of least id.
- secrets: secrets in the texts are replaced by a mark; no document goes.
- mixture: sources are drawn to their target weights; a document appears 0, 1 or 2 times, always whole.
- tokens: ids of every text and what they decode to, as digests (doc_id, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrain.llm.batches import cut, table
from tidegrain.llm.bpe import round_trip
from tidegrain.llm.minhash import keep_one
from tidegrain.llm.mixing import mixed_documents
from tidegrain.llm.quality import keep_good
from tidegrain.llm.secret_scan import redact

#: No SQL twin: a trained classifier and byte-pair merges are not SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what a stage returns is written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
