"""Delimited text files of unknown encoding and delimiter, each file judged by itself.

``describe`` reads the bytes of every file once, where they lie, and tells the first encoding of the list in which they are valid, whether
another would read them otherwise, and the delimiter. ``read_rows`` then reads the files of one encoding and delimiter together with
Spark's CSV reader, quoted line ends kept, so that there are as many readers as there are pairs, not files. One-byte encodings are read
byte by byte and then mapped by an expression.
"""

from __future__ import annotations

import csv
import io
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.operators.checks import DataRefused, union_all

# Encodings in the order in which they are tried, and delimiters: fixed values.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "cp1252")
DELIMITERS = (",", ";", "\t", "|")
SAMPLE = 65_536  # characters that the delimiter is judged by
BOM = b"\xef\xbb\xbf"
FOUND = "path string, encoding string, ambiguous boolean, delimiter string, n_columns int, n_bytes long"


def encoding_of(raw: bytes) -> tuple[str | None, str, bool]:
    """Encoding (null: none fits), text, and whether another encoding that fits reads other text (never for UTF-8).

    utf-8-sig is told from utf-8 by the mark at its start.
    """
    fits: list[tuple[str, str]] = []
    for name in ENCODINGS:
        if name == "utf-8-sig" and not raw.startswith(BOM):
            continue
        try:
            fits.append((name, raw.decode(name)))
        except UnicodeDecodeError:
            continue
        if name.startswith("utf-8"):
            return name, fits[0][1], False
    if not fits:
        return None, "", False
    return fits[0][0], fits[0][1], any(text != fits[0][1] for _, text in fits[1:])


def delimiter_of(text: str, path: str) -> tuple[str, int]:
    """Delimiter and columns: the one that parts most records of the sample into the same number of fields, at least 2; then the one that
    gives more fields; then the first of the list. Where none parts them, a tab for .tsv and a comma otherwise."""
    sample = text[:SAMPLE]
    best = None
    for place, delimiter in enumerate(DELIMITERS):
        rows = [row for row in csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter) if row]
        if len(text) > SAMPLE and len(rows) > 1:
            rows.pop()  # cut short
        counts = Counter(len(row) for row in rows if len(row) > 1)
        if counts:
            width, n = max(counts.items(), key=lambda c: (c[1], c[0]))
            best = max(best or (0, 0, 0, ""), (n, width, -place, delimiter))
    if best:
        return best[3], best[1]
    return ("\t" if path.lower().endswith(".tsv") else ","), 1


def describe(spark: SparkSession, folder: str, glob: str = "*.{csv,tsv,txt}") -> DataFrame:
    """path, encoding (null: undetermined), ambiguous, delimiter, n_columns (greatest of any record), n_bytes of each file that is not empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = raw.as_py() or b""
                encoding, text, ambiguous = encoding_of(content)
                delimiter, width = delimiter_of(text, path)
                width = max((len(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)), default=width)
                rows.append({"path": path, "encoding": encoding, "ambiguous": ambiguous, "delimiter": delimiter, "n_columns": width, "n_bytes": len(content)})
            kinds = [("path", pa.string()), ("encoding", pa.string()), ("ambiguous", pa.bool_()), ("delimiter", pa.string()), ("n_columns", pa.int32()), ("n_bytes", pa.int64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return files.mapInArrow(run, FOUND)


def meant(column: Column, encoding: str) -> Column:
    """Text of a one-byte encoding that was read byte by byte (ISO-8859-1)."""
    high = range(0x80, 0x100)
    pairs = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in high]
    pairs = [(a, b) for a, b in pairs if a != b and b != "\ufffd"]
    return F.translate(column, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def read_rows(spark: SparkSession, found: DataFrame, most_columns: int = 10_000) -> DataFrame:
    """path, row (of the file's records, from 1), fields (array of text, null where empty), encoding, ambiguous, delimiter.

    found: as ``describe`` gives it; files without an encoding are refused, and so are those with more columns than ``most_columns``.
    """
    if found.where("encoding is null").take(1):
        raise DataRefused(f"ENCODING_UNDETERMINED: {found.where('encoding is null').first()['path']}")
    wide = found.where(F.col("n_columns") > most_columns).take(1)
    if wide:
        raise DataRefused(f"TOO_MANY_COLUMNS: {wide[0]['path']}: {wide[0]['n_columns']} > {most_columns}")
    out = []
    kinds = found.groupBy("encoding", "delimiter").agg(F.max("n_columns").alias("n"), F.collect_list("path").alias("paths")).collect()  # names of files, as a reader needs them
    for kind in kinds:
        unicode = kind["encoding"].startswith("utf-8")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(1, kind["n"]))])
        reader = spark.read.schema(schema).option("sep", kind["delimiter"]).option("encoding", "UTF-8" if unicode else "ISO-8859-1").option("multiLine", "true").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        rows = reader.csv(list(kind["paths"])).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at_"), *schema.names)
        if not unicode:
            rows = rows.withColumns({c: meant(F.col(c), kind["encoding"]) for c in schema.names})
        row = F.row_number().over(Window.partitionBy("path").orderBy("at_"))  # a file is read by one task anyway
        first = F.regexp_replace("c0", "^﻿", "")
        rows = rows.withColumn("row", row).withColumn("c0", F.when(F.col("row") == 1, F.nullif(first, F.lit(""))).otherwise(F.col("c0")))
        out.append(rows.select("path", "row", F.array(*schema.names).alias("fields")))
    if not out:
        return spark.createDataFrame([], "path string, row int, fields array<string>, encoding string, ambiguous boolean, delimiter string")
    return union_all(out).join(found.select("path", "encoding", "ambiguous", "delimiter", F.greatest("n_columns", F.lit(1)).alias("n_")), "path").withColumn("fields", F.slice("fields", 1, F.col("n_"))).drop("n_")
