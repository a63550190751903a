"""Planning tables derived from the star schema, for the queries; each has its SQL twin under the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", F.to_date("l_shipdate").alias("date"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    item = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return (
        li.join(supplier, li["l_suppkey"] == supplier["s_suppkey"])
        .join(nation, F.col("s_nationkey") == nation["n_nationkey"])
        .join(item, li["l_partkey"] == item["p_partkey"])
        .withColumn("store_key", F.concat(F.lit("S"), F.col("n_regionkey").cast("string")))
        .withColumnRenamed("p_type", "product_key")
    )


part(
    "sales_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate::DATE AS date, 'S' || n_regionkey AS store_key, p_type AS product_key, p_brand, p_size
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """date, store_key, product_key, quantity_sold, revenue, is_stockout (three-valued), unit."""
    return sales_lines(spark, sf).groupBy("date", "store_key", "product_key").agg(
        F.sum("l_quantity").alias("quantity_sold"),
        F.sum("l_extendedprice").alias("revenue"),
        F.when(F.dayofmonth("date") % 11 != 0, F.bool_and(F.col("l_returnflag") == "R")).alias("is_stockout"),
        F.when(F.dayofmonth("date") % 7 != 0, F.lit("kg")).alias("unit"),
    )


part(
    "sales",
    """SELECT date, store_key, product_key, sum(l_quantity) AS quantity_sold, sum(l_extendedprice) AS revenue,
  CASE WHEN day(date) % 11 <> 0 THEN bool_and(l_returnflag = 'R') END AS is_stockout, CASE WHEN day(date) % 7 <> 0 THEN 'kg' END AS unit FROM @sales_lines GROUP BY date, store_key, product_key""",
)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day of the sales: holiday, closure, weather and when the weather was known."""
    ends = table(spark, sf, "lineitem").agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("b"))
    day = F.dayofmonth("date")
    return (
        ends.select(F.explode(F.sequence("a", "b")).alias("date"))
        .withColumn("is_holiday", day == 1)
        .withColumn("is_store_closed", (F.month("date") == 12) & (day == 25))
        .withColumn("temperature", (F.dayofyear("date") % 15 + 15).cast("double"))
        .withColumn("rainfall", (F.dayofyear("date") % 4).cast("double"))
        .withColumn("weather_kind", F.when(day % 3 == 0, "realized").otherwise("forecast"))
        .withColumn("weather_issued_at", F.date_sub("date", day % 5 + 1))
        .withColumn("weather_available_at", F.date_add("weather_issued_at", day % 2))
    )


part(
    "calendar",
    """SELECT date, day(date) = 1 AS is_holiday, month(date) = 12 AND day(date) = 25 AS is_store_closed, (dayofyear(date) % 15 + 15)::DOUBLE AS temperature,
  (dayofyear(date) % 4)::DOUBLE AS rainfall, CASE WHEN day(date) % 3 = 0 THEN 'realized' ELSE 'forecast' END AS weather_kind,
  date - (day(date) % 5 + 1)::INT AS weather_issued_at, date - (day(date) % 5 + 1)::INT + (day(date) % 2)::INT AS weather_available_at
  FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM (SELECT min(l_shipdate::DATE) AS a, max(l_shipdate::DATE) AS b FROM lineitem))""",
)


def raw_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales lines as a messy export would hold them: text dates, numbers with separators, blanks and repeats."""
    x = sales_lines(spark, sf)
    n = F.col("l_orderkey") + F.col("l_linenumber")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(n % 97 != 0, F.date_format("date", "yyyy-MM-dd")).alias("date_text"),
        F.concat(F.lit(" "), "store_key", F.lit(" ")).alias("store_text"),
        F.when(n % 89 == 0, "").otherwise(F.col("product_key")).alias("product_text"),
        F.when(n % 83 == 0, "1,234").when(n % 79 == 0, "bad").when(n % 73 == 0, F.concat(F.lit("-"), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5"))).alias("quantity_text"),
        F.col("l_extendedprice").alias("revenue"),
        F.when(F.col("l_returnflag") == "R", "có").when(F.col("l_returnflag") == "A", "no").otherwise("?").alias("stockout_text"),
        F.when(n % 5 == 0, "Grams").when(n % 5 == 1, " KG ").when(n % 5 == 2, "lít").when(n % 5 == 3, "Thùng").otherwise("each").alias("unit_text"),
    )


part(
    "raw_sales",
    """SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN n % 97 <> 0 THEN strftime(date, '%Y-%m-%d') END AS date_text, ' ' || store_key || ' ' AS store_text,
  CASE WHEN n % 89 = 0 THEN '' ELSE product_key END AS product_text,
  CASE WHEN n % 83 = 0 THEN '1,234' WHEN n % 79 = 0 THEN 'bad' WHEN n % 73 = 0 THEN '-' || l_quantity::INT ELSE l_quantity::INT || ',5' END AS quantity_text, l_extendedprice AS revenue,
  CASE l_returnflag WHEN 'R' THEN 'có' WHEN 'A' THEN 'no' ELSE '?' END AS stockout_text,
  CASE n % 5 WHEN 0 THEN 'Grams' WHEN 1 THEN ' KG ' WHEN 2 THEN 'lít' WHEN 3 THEN 'Thùng' ELSE 'each' END AS unit_text
  FROM (SELECT *, l_orderkey + l_linenumber AS n FROM @sales_lines)""",
)
