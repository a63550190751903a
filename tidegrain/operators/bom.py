"""Units, recipes and the way from product demand to ingredient demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimension and factor to the base unit of each unit.
UNITS = (("g", "mass", 0.001), ("kg", "mass", 1.0), ("ml", "volume", 0.001), ("liter", "volume", 1.0), ("unit", "count", 1.0))


def builtin_factor(old: Column, new: Column) -> Column:
    """Factor within a dimension; null across dimensions or for unknown units."""

    def look(c: Column, i: int) -> Column:
        return reduce(lambda out, u: out.when(c == u[0], u[i]), UNITS[1:], F.when(c == UNITS[0][0], UNITS[0][i]))

    return F.when(old == new, 1.0).when(look(old, 1) == look(new, 1), look(old, 2) / look(new, 2))


def unit_closure(rules: DataFrame, depth: int = 4) -> DataFrame:
    """ingredient_id, from_unit, to_unit, factor, hops: shortest chains of rules and their inverses, up to ``depth``; ties to the least path."""
    one = rules.select("ingredient_id", "from_unit", "to_unit", "factor").unionByName(rules.select("ingredient_id", F.col("to_unit").alias("from_unit"), F.col("from_unit").alias("to_unit"), (1 / F.col("factor")).alias("factor"))).distinct()
    step = one.select("ingredient_id", F.col("from_unit").alias("mid"), F.col("to_unit").alias("next"), F.col("factor").alias("more"))
    paths = [one.withColumn("path", F.concat_ws(">", "from_unit", "to_unit")).withColumn("hops", F.lit(1))]
    for n in range(2, depth + 1):
        last = paths[-1].withColumnRenamed("to_unit", "mid")
        longer = last.join(step, ["ingredient_id", "mid"]).where(~F.array_contains(F.split("path", ">"), F.col("next")))
        paths.append(longer.select("ingredient_id", "from_unit", F.col("next").alias("to_unit"), (F.col("factor") * F.col("more")).alias("factor"), F.concat_ws(">", "path", "next").alias("path"), F.lit(n).alias("hops")))
    every = reduce(DataFrame.unionByName, paths)
    return every.groupBy("ingredient_id", "from_unit", "to_unit").agg(F.min_by(F.struct("factor", "hops"), F.struct("hops", "path")).alias("b"), (F.max("factor") / F.min("factor") - 1 > 1e-9).alias("conflicting")).select("ingredient_id", "from_unit", "to_unit", "b.factor", "b.hops", "conflicting")


def active_recipes(rows: DataFrame, recipes: DataFrame, date: str) -> DataFrame:
    """Rows with the recipe lines effective on ``date``."""
    on = (rows["product_key"] == recipes["product_id"]) & (recipes["effective_from"] <= rows[date]) & (rows[date] <= F.coalesce(recipes["effective_to"], F.lit("9999-12-31").cast("date")))
    return rows.join(recipes, on)


def missing_recipes(rows: DataFrame, recipes: DataFrame, date: str) -> DataFrame:
    on = (rows["product_key"] == recipes["product_id"]) & (recipes["effective_from"] <= rows[date]) & (rows[date] <= F.coalesce(recipes["effective_to"], F.lit("9999-12-31").cast("date")))
    return rows.join(recipes, on, "left_anti")


def explode_demand(rows: DataFrame, recipes: DataFrame, date: str, quantity: str, keys: list[str], to_unit: dict[str, str] | None = None) -> DataFrame:
    """Ingredient demand by ``keys``, ingredient, date and base unit: quantity / yield * line, with loss and waste."""
    lines = active_recipes(rows, recipes, date)
    base = F.when(F.col("ingredient_unit").isin("g", "kg"), "kg").when(F.col("ingredient_unit").isin("ml", "liter"), "liter").otherwise(F.col("ingredient_unit"))
    need = F.col(quantity) / F.col("yield_quantity") * F.col("ingredient_quantity") * (1 + F.col("process_loss_rate")) * (1 + F.col("waste_allowance_rate")) * builtin_factor(F.col("ingredient_unit"), base)
    return lines.withColumn("need_", need).withColumn("unit_", base).groupBy(*keys, "ingredient_id", date, F.col("unit_").alias("base_unit")).agg(F.sum("need_").alias("quantity"), F.count("*").alias("n_lines"))


def usage_multipliers(usage: DataFrame, theory: DataFrame, least: int = 5) -> DataFrame:
    """store_key, ingredient_id (null: all), multiplier, n: median of actual over theoretical use at four levels."""
    pairs = usage.join(theory, ["date", "store_key", "ingredient_id"]).where("theoretical > 0").withColumn("r", F.col("actual") / F.col("theoretical"))
    sets = [["store_key", "ingredient_id"], ["ingredient_id"], ["store_key"], []]
    g = pairs.groupingSets([[F.col(c) for c in s] for s in sets], F.col("store_key"), F.col("ingredient_id"))
    return g.agg(F.percentile("r", F.lit(0.5)).alias("multiplier"), F.count("*").alias("n"), F.grouping_id().alias("level")).where(F.col("n") >= least)
