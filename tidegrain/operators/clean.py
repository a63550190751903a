"""From raw rows to canonical tables: coercion, row rules, quarantine, duplicates, profiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as T

from .checks import failed, repeated_keys


def adapt_sales(raw: DataFrame, default_store: str = "ALL", columns: tuple[str, ...] | None = None, hashed: bool = True) -> DataFrame:
    """Typed sales from text columns, with the store defaulted and the product id hashed where it is missing.

    The typed columns come out of a generator, so that a filter on them does not read the texts again; a generator makes all its columns,
    so ``columns`` names those that are read (default: all). Without ``hashed``, product_key is the name itself, for what asks only
    whether there is one.
    """
    product = T.clean(F.col("product_text"))
    typed = [
        T.parse_date(F.col("date_text")).alias("date"),
        F.coalesce(T.clean(F.col("store_text")), F.lit(default_store)).alias("store_key"),
        (F.when(product.isNotNull(), T.stable_id("PRODUCT", F.col("product_text"))) if hashed else product).alias("product_key"),
        T.parse_number(F.col("quantity_text")).alias("quantity_sold"),
        F.col("revenue").alias("revenue"),
        T.parse_boolean(F.col("stockout_text")).alias("is_stockout"),
        T.normalize_unit(F.col("unit_text"), T.IMPORT_UNITS).alias("unit"),
    ]
    names = ("date", "store_key", "product_key", "quantity_sold", "revenue", "is_stockout", "unit")
    chosen = [c for name, c in zip(names, typed, strict=True) if columns is None or name in columns]
    return raw.select("row_id", F.inline(F.array(F.struct(*chosen))))


def fatal_rules() -> dict[str, Column]:
    return {"null_date": F.col("date").isNull(), "null_product": F.col("product_key").isNull(), "null_quantity": F.col("quantity_sold").isNull(), "negative_quantity": F.col("quantity_sold") < 0}


def valid_sales(df: DataFrame) -> DataFrame:
    """Rows that break none of the fatal rules; plain conditions, so that a parsed column is read once for each and no list is made."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for broken in fatal_rules().values()]))


def daily(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """Repeated daily rows as one: quantities summed, the first text by ``order``, stockout if any row says so."""
    return df.groupBy(*keys).agg(
        F.sum("quantity_sold").alias("quantity_sold"),
        F.sum("revenue").alias("revenue"),
        F.bool_or("is_stockout").alias("is_stockout"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col(order))).alias("unit"),
        F.count("*").alias("n_rows"),
    )


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with the codes that send them away."""
    marked = df.withColumn("issues", failed(rules))
    return marked.where(F.size("issues") == 0).drop("issues"), marked.where(F.size("issues") > 0)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, least and greatest as text. One pass over the unpivoted columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.countDistinct("value").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("greatest")
    )


def table_quality(df: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """Rows, rows that share a key, and the range of dates."""
    size = Window.partitionBy(*keys)
    return df.withColumn("same", F.count("*").over(size)).agg(F.count("*").alias("n_rows"), F.count_if(F.col("same") > 1).alias("n_duplicate_rows"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def drop_totals(df: DataFrame, column: str, markers: tuple[str, ...] = ("total", "subtotal", "grand total", "tổng", "tổng cộng", "cộng")) -> DataFrame:
    return df.where(~F.coalesce(F.lower(F.trim(F.col(column))).isin(*markers), F.lit(False)))


def repeats_header(columns: list[str], share: float = 0.7) -> Column:
    """Whether at least ``share`` of the cells equal the header of their column."""
    equal = sum(((F.lower(F.trim(F.col(c))) == c.lower()).cast("int") for c in columns), F.lit(0))
    return F.coalesce(equal, F.lit(0)) >= math.ceil(share * len(columns))


def conflicting_entities(df: DataFrame, name: str, identifier: str) -> DataFrame:
    """Names that stand for several ids."""
    ids = df.groupBy(F.col(name).alias("entity")).agg(F.array_sort(F.collect_set(identifier)).alias("ids"))
    return ids.where(F.size("ids") > 1).select("entity", F.array_join("ids", ",").alias("ids"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of the rows that does not depend on their order: sums of the parts of row hashes, and their number."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    piece = lambda k: F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[piece(k) for k in range(4)]), 256).alias("fingerprint"))


def readiness(issues: DataFrame) -> DataFrame:
    """Per capability: blocked by an error, degraded by a warning, else ready. issues: capability, severity."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return issues.groupBy("capability").agg(worst.alias("w"), F.count_if(F.col("severity") == "error").alias("n_errors")).select(
        "capability", F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "degraded").otherwise("ready").alias("status"), "n_errors"
    )


def same_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    return repeated_keys(df, keys)
