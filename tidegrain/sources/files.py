"""Files in and out: inventories, text tables, JSON, Parquet, manifests."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidegrain.functions.text import guard_formula
from tidegrain.operators.checks import DataRefused, guard, repeated_keys

SUFFIXES = "*.{csv,tsv,txt,json,jsonl,parquet}"


def inventory(spark: SparkSession, folder: str, glob: str = SUFFIXES) -> DataFrame:
    """path, length, sha256, is_duplicate of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    files = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return files.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)


def delimiter_of(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The candidate that the first lines hold most often."""
    candidates = [",", ";", "\t", "|"]
    head = spark.read.text(path).limit(lines)
    counts = head.agg(*[F.coalesce(F.sum(F.length("value") - F.length(F.translate("value", c, ""))), F.lit(0)).alias(str(i)) for i, c in enumerate(candidates)]).first()
    return candidates[max(range(len(candidates)), key=lambda i: (counts[i], -i))]


def read_delimited(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Every field as text."""
    return spark.read.csv(path, sep=delimiter_of(spark, path), header=True, inferSchema=False, encoding=encoding)


def read_parquet(spark: SparkSession, path: str, most_rows: int, most_columns: int) -> DataFrame:
    """A Parquet table, refused where it has more rows or columns than its budget. Both come from the files' footers, no data is read."""
    df = spark.read.parquet(path)
    if len(df.columns) > most_columns:
        raise DataRefused(f"TOO_MANY_COLUMNS: {len(df.columns)} > {most_columns}")
    n = df.count()
    if n > most_rows:
        raise DataRefused(f"TOO_MANY_ROWS: {n} > {most_rows}")
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns named a.b; arrays and maps as JSON text."""

    def leaves(kind: S.StructType, column: Column | None, name: str) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            c = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
            full = f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, S.StructType):
                out += leaves(f.dataType, c, full)
            else:
                out.append((F.to_json(c) if isinstance(f.dataType, S.ArrayType | S.MapType) else c).alias(full))
        return out

    return df.select(*leaves(df.schema, None, ""))


def read_canonical(spark: SparkSession, path: str, schema: S.StructType, grain: list[str]) -> DataFrame:
    """Typed table from a text CSV; refuses values that do not cast, nulls in required columns and repeated grains."""
    raw = spark.read.schema(S.StructType([S.StructField(f.name, S.StringType()) for f in schema.fields])).csv(path, header=True)
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], *[F.col(f.name).alias(f"raw_{f.name}") for f in schema.fields])
    lost = [F.col(f"raw_{f.name}").isNotNull() & F.col(f.name).isNull() for f in schema.fields]
    empty = [F.col(f.name).isNull() for f in schema.fields if not f.nullable]
    guard(typed.where(F.array_contains(F.array(*lost, *empty), True)), "INVALID_VALUE")
    out = typed.select(*schema.fieldNames())
    if grain:
        guard(repeated_keys(out, grain), "REPEATED_GRAIN")
    return out


def write_canonical(df: DataFrame, path: str) -> None:
    """ISO dates, true and false, nothing for null."""
    df.select(*[F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_export(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: formulas disarmed, nested values as JSON."""
    nested = (S.ArrayType, S.MapType, S.StructType)
    cells = [guard_formula(F.col(f.name)) if isinstance(f.dataType, S.StringType) else F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*[c.alias(f.name) for c, f in zip(cells, df.schema.fields, strict=True)]).write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("horizon").parquet(path)


def write_checkpoint(df: DataFrame, path: str, keys: list[str], quantities: list[str], ascending: list[str] = ()) -> None:
    """A stage's table as Parquet, refused as a whole if a key repeats, a quantity is negative or not finite, or ``ascending`` columns cross."""
    guard(repeated_keys(df, keys), "REPEATED_KEY")
    bad = [F.col(q).isNull() | F.isnan(q) | (F.abs(F.col(q)) == float("inf")) | (F.col(q) < 0) for q in quantities]
    if bad:
        guard(df.where(reduce(lambda a, b: a | b, bad)).select(*keys, *quantities), "BAD_QUANTITY")
    crossing = [F.col(a) > F.col(b) for a, b in pairwise(ascending)]
    if crossing:
        guard(df.where(reduce(lambda a, b: a | b, crossing)).select(*keys, *ascending), "CROSSING")
    df.write.mode("overwrite").parquet(path)


def manifest(files: DataFrame, role: str) -> DataFrame:
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.lit(role).alias("role"), "length", "sha256")


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, new or changed."""
    a, b = recorded.select("name", F.col("sha256").alias("old")), found.select("name", F.col("sha256").alias("new"))
    state = F.when(F.col("new").isNull(), "MISSING").when(F.col("old").isNull(), "UNEXPECTED").when(F.col("old") != F.col("new"), "CHANGED")
    return a.join(b, "name", "full").select("name", state.alias("state")).where("state IS NOT NULL")
