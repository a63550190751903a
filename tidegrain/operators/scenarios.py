"""Demand scenarios from residual history; draws come from hashes of the keys, so they do not depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["store_key", "product_key"]


def uniform(*keys) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal_cdf(x: Column) -> Column:
    """Rational approximation with an error below 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def gauss(*keys) -> Column:
    """Standard normal from two uniform hashes."""
    return F.sqrt(-2 * F.ln(uniform(*keys, F.lit(1)))) * F.cos(2 * math.pi * uniform(*keys, F.lit(2)))


def bootstrap(forecast: DataFrame, history: DataFrame, n: int, seed: int) -> DataFrame:
    """Per scenario and store one historical origin; its scaled residual of the product and horizon, else a draw of the product, else 0."""
    blocks = history.select("store_key", "forecast_origin").distinct()
    w = Window.partitionBy("store_key")
    blocks = blocks.withColumn("i", F.row_number().over(w.orderBy("forecast_origin")) - 1).withColumn("n_blocks", F.count("*").over(w))
    stores = blocks.groupBy("store_key").agg(F.max("n_blocks").alias("n_blocks"))
    drawn = stores.withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "scenario_id", "store_key"), F.col("n_blocks"))).drop("n_blocks")
    drawn = drawn.join(blocks.drop("n_blocks"), ["store_key", "i"]).select("scenario_id", "store_key", "forecast_origin")
    own = history.select(*SERIES, "forecast_origin", "horizon", F.col("scaled_residual").alias("z"))
    pools = history.groupBy(*SERIES).agg(F.percentile("scaled_residual", F.array(*[F.lit(k / 20) for k in range(21)])).alias("pool"))
    rows = forecast.join(drawn, "store_key").join(own, [*SERIES, "forecast_origin", "horizon"], "left").join(pools, SERIES, "left")
    pick = F.element_at("pool", (uniform(F.lit(seed), "scenario_id", *SERIES, "horizon") * 21).cast("int") + 1)
    z = F.coalesce("z", pick, F.lit(0.0))
    raw = F.col("p50") + z * F.greatest(F.col("p75") - F.col("p25"), F.lit(1e-6))
    return rows.select("scenario_id", *SERIES, "target_date", "horizon", F.greatest(F.lit(0.0), raw).alias("quantity"), (raw < 0).alias("clipped"), F.when(F.col("z").isNotNull(), "block").when(F.col("pool").isNotNull(), "pool").otherwise("none").alias("source"))


def copula(forecast: DataFrame, history: DataFrame, n: int, seed: int, shrink: float = 0.05) -> DataFrame:
    """Gaussian copula over the history's ranks: normal scores mixed by common random weights of the origins, so that their correlation,
    shrunk by ``shrink``, is that of the history; the marginals are its empirical quantiles."""
    key = [*SERIES, "horizon"]
    w = Window.partitionBy(*key)
    score = (F.rank().over(w.orderBy("scaled_residual")) - 0.5) / F.count("*").over(w)
    ranked = history.select(*key, "forecast_origin", score.alias("u"))
    z = F.sqrt(-2 * F.ln(F.least("u", 1 - F.col("u"))))  # a published rational approximation of the normal quantile
    inverse = z - (2.515517 + 0.802853 * z + 0.010328 * z * z) / (1 + 1.432788 * z + 0.189269 * z * z + 0.001308 * z * z * z)
    ranked = ranked.withColumn("z", F.when(F.col("u") < 0.5, -inverse).otherwise(inverse))
    ranked = ranked.withColumn("z", (F.col("z") - F.avg("z").over(w)) / F.greatest(F.stddev_pop("z").over(w), F.lit(1e-9))).withColumn("t", F.count("*").over(w))
    scenarios = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mixed = ranked.withColumn("scenario_id", scenarios).withColumn("g", gauss(F.lit(seed), "scenario_id", "forecast_origin"))
    mixed = mixed.groupBy("scenario_id", *key).agg((F.sum(F.col("g") * F.col("z")) / F.sqrt(F.first("t"))).alias("x"))
    mixed = mixed.withColumn("u", normal_cdf(math.sqrt(1 - shrink) * F.col("x") + math.sqrt(shrink) * gauss(F.lit(seed + 1), "scenario_id", *key)))
    grid = [k / 50 for k in range(51)]
    pools = history.groupBy(*key).agg(F.percentile("scaled_residual", F.array(*[F.lit(g) for g in grid])).alias("pool"))
    place = F.least(F.floor(F.col("u") * 50).cast("int"), F.lit(49))
    low, high = F.element_at("pool", place + 1), F.element_at("pool", place + 2)
    value = low + (high - low) * (F.col("u") * 50 - place)
    rows = forecast.join(mixed.join(pools, key).withColumn("zz", value).select("scenario_id", *key, "zz"), key)
    return rows.select("scenario_id", *SERIES, "target_date", "horizon", F.greatest(F.lit(0.0), F.col("p50") + F.col("zz") * F.greatest(F.col("p75") - F.col("p25"), F.lit(1e-6))).alias("quantity"))


def copula_or_bootstrap(forecast: DataFrame, history: DataFrame, n: int, seed: int, least: int = 20) -> DataFrame:
    """The copula where a series and horizon has ``least`` residuals, else the bootstrap; p50 in stores without any residual."""
    key = [*SERIES, "horizon"]
    enough = history.groupBy(*key).agg(F.count("scaled_residual").alias("n_")).where(F.col("n_") >= least).drop("n_")
    made = copula(forecast, history.join(enough, key), n, seed)
    sparse = forecast.join(enough, key, "left_anti")
    drawn = bootstrap(sparse, history, n, seed).select(*made.columns)
    bare = sparse.join(history.select("store_key").distinct(), "store_key", "left_anti").withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return made.unionByName(drawn).unionByName(bare.withColumn("quantity", F.greatest(F.lit(0.0), F.col("p50"))).select(*made.columns))


def declared_levels(rows: DataFrame, levels: list[tuple[float, float]], n: int, seed: int) -> DataFrame:
    """One weighted level per scenario for all rows: quantity = level * p50."""
    edges, total = [], 0.0
    for level, weight in levels:
        total += weight
        edges.append((level, total))
    u = uniform(F.lit(seed), "scenario_id") * total
    pick = F.when(u <= edges[0][1], edges[0][0])
    for level, edge in edges[1:]:
        pick = pick.when(u <= edge, level)
    made = rows.withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return made.withColumn("quantity", F.col("p50") * pick.otherwise(edges[-1][0]))


def sample_worlds(worlds: DataFrame, n: int, seed: int) -> DataFrame:
    """n scenarios without replacement, weights summing to 1 again."""
    kept = worlds.orderBy(F.xxhash64(F.lit(seed), "scenario_id"), "scenario_id").limit(n)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
