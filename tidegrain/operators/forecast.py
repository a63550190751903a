"""Baselines, quantile forecasts and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import at_rank, value_ranks
from .panel import SERIES


def _labelled(steps: list[tuple[str, str]], last: str) -> tuple[Column, Column]:
    value = F.greatest(F.lit(0.0), F.coalesce(*[F.col(c) for c, _ in steps], F.lit(0.0)))
    label = F.when(F.col(steps[0][0]).isNotNull(), steps[0][1])
    for column, name in steps[1:]:
        label = label.when(F.col(column).isNotNull(), name)
    return value, label.otherwise(last)


def seasonal_naive() -> tuple[Column, Column]:
    """Prediction and label of the fallback used."""
    return _labelled([("seasonal_lag_7_target", ""), ("rolling_median_7", "FALLBACK_ROLLING_MEDIAN_7"), ("rolling_median_28", "FALLBACK_ROLLING_MEDIAN_28"), ("last_observed_demand", "FALLBACK_LAST_OBSERVED_DEMAND")], "FALLBACK_ZERO_NO_HISTORY")


def moving_average(window: int) -> tuple[Column, Column]:
    return _labelled([(f"rolling_mean_{window}", ""), ("last_observed_demand", "FALLBACK_LAST_OBSERVED_DEMAND")], "FALLBACK_ZERO_NO_HISTORY")


def repair(p25: str = "p25", p50: str = "p50", p75: str = "p75") -> list[Column]:
    """The three quantiles sorted and not below 0, and whether they crossed."""
    s = F.array_sort(F.array(p25, p50, p75))
    crossed = (F.col(p25) > F.col(p50)) | (F.col(p50) > F.col(p75))
    return [F.greatest(F.lit(0.0), s[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))] + [crossed.alias("crossed")]


def fit_point(df: DataFrame, least_tasks: int = 30, least_dates: int = 7, strength: float = 20.0) -> DataFrame:
    """horizon (null: all), offset, n, n_dates: median residual, a horizon's shrunk to the global one."""
    r = F.col("target") - F.col("p50")
    stats = [F.percentile(r, F.lit(0.5)).alias("m"), F.count("*").alias("n"), F.countDistinct("target_date").alias("n_dates")]
    every = df.agg(*stats).withColumn("horizon", F.lit(None).cast("int"))
    each = df.groupBy("horizon").agg(*stats).where((F.col("n") >= least_tasks) & (F.col("n_dates") >= least_dates))
    w = F.col("n") / (F.col("n") + strength)
    shrunk = each.crossJoin(F.broadcast(every.select(F.col("m").alias("g")))).select("horizon", (w * F.col("m") + (1 - w) * F.col("g")).alias("offset"), "n", "n_dates")
    return shrunk.unionByName(every.select("horizon", F.col("m").alias("offset"), "n", "n_dates"))


def score() -> Column:
    """How far the actual lies outside the interval; negative inside."""
    return F.greatest(F.col("p25") - F.col("target"), F.col("target") - F.col("p75"))


def fit_cqr(df: DataFrame, coverage: float = 0.5, least: int = 30) -> DataFrame:
    """horizon (null: all), correction, n, level: the k-th smallest score, k = ceil((n + 1) * coverage). A k beyond n gives null."""
    every = -(1 << 31)  # stands for all horizons among the keys
    scores = df.select(F.coalesce("horizon", F.lit(every)).alias("horizon"), score().alias("s")).where("s is not null")
    both = scores.select(F.explode(F.array(F.col("horizon"), F.lit(every))).alias("horizon"), "s")
    rank = F.ceil((F.col("total") + 1) * F.lit(coverage))
    fitted = value_ranks(both, ["horizon"], "s").groupBy("horizon", F.col("total").alias("n")).agg(at_rank(rank, "s").alias("correction"), F.max(rank / F.col("total")).alias("level"))
    return fitted.withColumn("horizon", F.when(F.col("horizon") != every, F.col("horizon"))).where(F.col("horizon").isNull() | (F.col("n") >= least)).select("horizon", "correction", "n", "level")


def by_horizon(df: DataFrame, fitted: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` of the row's horizon, else the global one, and the source. ``fitted`` has a row per horizon and one of null."""
    own = fitted.where("horizon IS NOT NULL").select("horizon", F.col(value).alias("own_"))
    every = fitted.where("horizon IS NULL").select(F.col(value).alias("all_"))
    met = df.join(own, "horizon", "left").crossJoin(F.broadcast(every))  # one row
    return met.withColumn(value, F.coalesce("own_", "all_")).withColumn(f"{value}_source", F.when(F.col("own_").isNotNull(), F.concat(F.lit("horizon_"), F.col("horizon"))).otherwise("global")).drop("own_", "all_")


def widen() -> list[Column]:
    """Interval from the quantiles and the correction: not below 0, and holding the median."""
    low = F.least(F.greatest(F.lit(0.0), F.col("p25") - F.col("correction")), F.col("p50"))
    high = F.greatest(F.col("p75") + F.col("correction"), F.col("p50"))
    return [low.alias("interval_lower"), high.alias("interval_upper")]


def residual_quantiles(train: DataFrame, rows: DataFrame, least: int = 20) -> DataFrame:
    """p25, p50, p75: the anchor plus quantiles of residuals on ``train`` of the series and horizon, else of the horizon, else of all."""
    q = F.percentile(F.col("target") - F.col("anchor"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    levels = [[*SERIES, "horizon"], ["horizon"], []]
    out = rows
    for i, keys in enumerate(levels):
        pool = train.groupBy(*keys).agg(q.alias(f"q{i}"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
        out = out.join(pool, keys, "left") if keys else out.join(F.broadcast(pool), F.lit(True), "left")  # one row
    best = F.coalesce("q0", "q1", "q2")
    level = F.when(F.col("q0").isNotNull(), "series").when(F.col("q1").isNotNull(), "horizon").when(F.col("q2").isNotNull(), "all").otherwise("none")
    return out.select("*", level.alias("level"), *[F.greatest(F.lit(0.0), F.col("anchor") + F.coalesce(best[i], F.lit(0.0))).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]).drop("q0", "q1", "q2")


#: Smoothing of level, trend and season.
GRID = ((0.20, 0.05, 0.10), (0.40, 0.10, 0.20), (0.60, 0.10, 0.20), (0.80, 0.20, 0.10))


def holt_winters(history: DataFrame, horizon: int = 7, season: int = 7) -> DataFrame:
    """Additive Holt-Winters per series over the grid; the path of least squared error. ``history``: series, date, y, without gaps.
    Series of less than two seasons get the seasonal naive: the value a season before, the median of all where there is none.

    Start values: level and season from the first two weeks, trend from the difference of their means.
    """
    lists = history.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "y"))), lambda s: s["y"]).alias("y"))
    short, lists = lists.where(F.size("y") < 2 * season), lists.where(F.size("y") >= 2 * season)
    mean = lambda a, b: F.aggregate(F.slice("y", a, b), F.lit(0.0), lambda x, v: x + v) / b
    lists = lists.withColumn("m1", mean(1, season)).withColumn("m2", mean(season + 1, season))
    lists = lists.withColumn("s0", F.transform(F.slice("y", 1, season), lambda v: v - F.col("m1")))
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a, b, g in GRID]))
    lists = lists.withColumn("w", grid)
    start = F.struct(F.col("m1").alias("level"), ((F.col("m2") - F.col("m1")) / season).alias("trend"), F.col("s0").alias("season"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        old = s["season"][0]
        error = y - (s["level"] + s["trend"] + old)
        level = F.col("w.a") * (y - old) + (1 - F.col("w.a")) * (s["level"] + s["trend"])
        trend = F.col("w.b") * (level - s["level"]) + (1 - F.col("w.b")) * s["trend"]
        fresh = F.col("w.g") * (y - level) + (1 - F.col("w.g")) * old
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(F.slice(s["season"], 2, season - 1), F.array(fresh)).alias("season"), (s["sse"] + error * error).alias("sse"))

    run = lists.withColumn("state", F.aggregate("y", start, step))
    path = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(F.lit(0.0), F.col("state.level") + h * F.col("state.trend") + F.element_at(F.col("state.season"), ((h - 1) % season) + 1)))
    ordered, n = F.array_sort("y"), F.size("y")
    median = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2
    before = lambda h: n - season + (h - 1) % season + 1
    naive = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(F.lit(0.0), F.when(before(h) >= 1, F.element_at("y", F.greatest(F.lit(1), before(h)))).otherwise(median)))
    paths = run.withColumn("path", path).groupBy(*SERIES).agg(F.min_by("path", F.struct("state.sse", "w")).alias("path")).unionByName(short.select(*SERIES, naive.alias("path")))
    return paths.select(*SERIES, F.posexplode("path").alias("h", "prediction")).select(*SERIES, (F.col("h") + 1).alias("horizon"), "prediction")
