"""Gap-free daily panels and what is built on them: censored demand, history features, rows per origin and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import codes

SERIES = ["store_key", "product_key"]
HORIZONS = tuple(range(1, 8))


def series_units(sales: DataFrame) -> DataFrame:
    """One row per series with its first non-blank unit."""
    unit = F.nullif(F.trim("unit"), F.lit(""))
    return sales.groupBy(*SERIES).agg(F.min_by(unit, F.when(unit.isNotNull(), F.col("date"))).alias("unit"))


def daily_panel(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every day of every series between the first and the last sale, with what was observed and the calendar."""
    span = sales.agg(F.min("date").alias("a"), F.max("date").alias("b"))  # one row
    spine = series_units(sales).crossJoin(F.broadcast(span)).select(*SERIES, "unit", F.explode(F.sequence("a", "b")).alias("date"))
    seen = sales.select("date", *SERIES, "quantity_sold", "revenue", "is_stockout")
    days = calendar.select("date", "is_holiday", "is_store_closed")
    rows = spine.join(seen, ["date", *SERIES], "left").join(days, "date", "left").withColumn("row_observed", F.col("quantity_sold").isNotNull())
    rows = rows.withColumn("store_open", ~F.coalesce("is_store_closed", F.lit(False))).withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
    reason = F.when(~F.col("row_observed"), F.when(F.col("store_open"), "MISSING_OPEN_DAY_RECORD").otherwise("STORE_CLOSED"))
    return rows.withColumn("sales_missing_reason", reason).withColumn("quantity_sold", F.when(F.col("store_open"), F.col("quantity_sold"))).drop("is_store_closed")


def reconstruct(panel: DataFrame, minimum: int = 3, lookback: int = 84) -> DataFrame:
    """Demand on stockout days from the median of earlier uncensored days, same weekday first; what is kept depends on confidence."""
    day = F.unix_date("date")
    p = panel.withColumn("target_is_censored", F.col("store_open") & F.coalesce("is_stockout", F.lit(False)))
    valid = F.col("store_open") & F.col("row_observed") & F.col("quantity_sold").isNotNull() & (F.col("is_stockout") == F.lit(False))
    p = p.withColumn("ref_", F.when(valid, F.col("quantity_sold"))).withColumn("weekday_", F.weekday("date"))
    any_day = Window.partitionBy(*SERIES).orderBy(day).rangeBetween(-lookback, -1)
    same = Window.partitionBy(*SERIES, "weekday_").orderBy(day).rangeBetween(-lookback, -1)

    def pool(w, name: str) -> list[Column]:
        return [F.count("ref_").over(w).alias(f"{name}n"), F.percentile("ref_", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w).alias(f"{name}q"), F.max(F.when(F.col("ref_").isNotNull(), F.col("date"))).over(w).alias(f"{name}d")]

    p = p.select("*", *pool(any_day, "a_"), *pool(same, "s_"))
    weekday, enough = F.col("s_n") >= minimum, F.col("a_n") >= minimum
    pick = lambda k: F.when(weekday, F.col(f"s_{k}")).otherwise(F.col(f"a_{k}"))
    p = p.select("*", pick("n").alias("n_"), pick("q").alias("q_"), pick("d").alias("d_"))
    spread = (F.col("q_")[2] - F.col("q_")[0]) / F.greatest(F.abs(F.col("q_")[1]), F.lit(1.0))
    recency = F.datediff("date", "d_")
    censored, found = F.col("target_is_censored"), weekday | enough
    confidence = (
        F.when(~censored, "not_applicable").when(~found, "low")
        .when(weekday & (F.col("n_") >= 6) & (recency <= 14) & (spread <= 0.25), "high")
        .when((recency <= 28) & (spread <= 0.5), "medium").otherwise("low")
    )
    reasons = F.when(censored & ~found, F.array(F.lit("RECONSTRUCTION_INSUFFICIENT_SUPPORT"))).when(
        censored & (confidence == "low"),
        F.filter(F.array(F.when(recency > 28, F.lit("RECONSTRUCTION_STALE_HISTORY")), F.when(spread > 0.5, F.lit("RECONSTRUCTION_HIGH_DISPERSION"))), lambda x: x.isNotNull()),
    )
    method = F.when(~censored, "not_censored").when(weekday, "same_store_product_weekday_median").when(enough, "same_store_product_recent_median").otherwise("insufficient_history")
    p = p.withColumn("reconstruction_method", method).withColumn("reconstruction_confidence", confidence).withColumn("reconstruction_reasons", F.coalesce(reasons, F.array().cast("array<string>")))
    applied = F.col("reconstruction_confidence").isin("high", "medium")
    p = p.withColumn("reconstruction_applied", applied)
    p = p.withColumn("demand_proxy", F.when(applied, F.greatest("quantity_sold", F.col("q_")[1])).otherwise(F.col("quantity_sold")))
    p = p.withColumn("feature_demand", F.when(censored & ~applied, None).otherwise(F.col("demand_proxy")))
    p = p.withColumn("train_eligible", F.col("store_open") & F.col("demand_proxy").isNotNull() & (~censored | applied))
    # The last rule of the ladder wins, so it stands first.
    quality = (
        F.when(F.col("store_open") & F.col("row_observed") & F.col("is_stockout").isNull(), "stockout_unknown").when(F.col("store_open") & ~F.col("row_observed"), "missing_open_day")
        .when(censored & applied, "stockout_reconstructed").when(censored, "stockout_censored").when(~F.col("store_open"), "store_closed").otherwise("observed")
    )
    return p.withColumn("target_quality", quality).drop("ref_", "weekday_", "a_n", "a_q", "a_d", "s_n", "s_q", "s_d", "n_", "q_", "d_")


def rolling(column: str, window: int, statistic: str, least: int) -> Column:
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-(window - 1), 0)
    f = {"mean": F.avg(column), "median": F.percentile(column, F.lit(0.5)), "std": F.stddev_samp(column), "sum": F.sum(column), "count": F.count(column)}[statistic]
    return F.when(F.count(column).over(w) >= least, f.over(w))


def add_history(panel: DataFrame, column: str = "feature_demand") -> DataFrame:
    """Last known value, counts, lags, rolling statistics and stockout rates, all known at the end of the row's day."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    p = panel.withColumn("stockout_", F.col("is_stockout").cast("double"))
    extra = [F.last(column, True).over(so_far).alias("last_observed_demand"), F.count(column).over(so_far).alias("history_observation_count")]
    extra += [F.lag(column, n).over(w).alias(f"cutoff_lag_{n}") for n in (1, 2, 7, 14, 28)]
    for n in (7, 14, 28):
        extra += [rolling(column, n, s, least).alias(f"rolling_{s}_{n}") for s, least in (("mean", max(2, n // 2)), ("median", max(2, n // 2)), ("std", max(3, n // 2)), ("count", 1))]
    before = w.rowsBetween(-13, -7)
    extra.append((rolling(column, 7, "mean", 3) - F.when(F.count(column).over(before) >= 4, F.avg(column).over(before))).alias("mean_last_7_minus_previous_7"))
    for n in (7, 28):
        extra += [rolling("stockout_", n, "sum", 1).alias(f"stockout_count_{n}"), rolling("stockout_", n, "mean", 1).alias(f"stockout_rate_{n}")]
    return p.select("*", *extra).drop("stockout_")


def date_features(d: Column) -> dict[str, Column]:
    return {
        "day_of_week": F.weekday(d), "is_weekend": (F.weekday(d) >= 5).cast("int"), "month": F.month(d), "day_of_month": F.dayofmonth(d),
        "week_of_month": F.floor((F.dayofmonth(d) - 1) / 7).cast("int") + 1, "week_of_year": F.weekofyear(d),
    }


def training_rows(features: DataFrame, horizons: tuple[int, ...] = HORIZONS, lags: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """Origin features with the target ``horizon`` days later and the demand ``lag`` days before that target.

    The panel has no gaps, so days later are rows later: everything comes from the windows that the features already sort for. A target
    past the end of the panel is null; a seasonal lag is null where its day lies after the origin.
    """
    w = Window.partitionBy(*SERIES).orderBy("date")

    def ahead(h: int) -> Column:
        known = [(F.lag("feature_demand", n - h).over(w) if n > h else F.col("feature_demand") if n == h else F.lit(None).cast("double")).alias(f"seasonal_lag_{n}_target") for n in lags]
        goal = [F.lead("demand_proxy", h).over(w).alias("target"), F.coalesce(F.lead("train_eligible", h).over(w), F.lit(False)).alias("target_train_eligible")]
        return F.struct(F.lit(h).alias("horizon"), F.date_add("date", h).alias("target_date"), *goal, *known)

    rows = features.withColumn("ahead_", F.array(*[ahead(h) for h in horizons])).withColumnRenamed("date", "cutoff_date")
    kept = [c for c in rows.columns if c not in ("ahead_", "demand_proxy", "train_eligible", "target_quality")]
    return rows.select(*kept, F.inline("ahead_"))


def weather_safe(origin: str = "cutoff_date") -> Column:
    """Whether the weather of the target day was forecast, issued and available by the origin."""
    return F.coalesce((F.lower("weather_kind") == "forecast") & (F.col("weather_issued_at") <= F.col(origin)) & (F.col("weather_available_at") <= F.col(origin)), F.lit(False))


def add_target_calendar(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    days = calendar.withColumnRenamed("date", "target_date")
    met = rows.join(days, "target_date", "left").withColumn("safe_", weather_safe())
    out = met.withColumn("target_temperature", F.when(F.col("safe_"), F.col("temperature"))).withColumn("target_rainfall", F.when(F.col("safe_"), F.col("rainfall")))
    out = out.withColumn("calendar_available", (F.col("is_holiday").isNotNull() | F.col("is_store_closed").isNotNull() | F.col("target_temperature").isNotNull()).cast("int"))
    out = out.withColumn("target_is_holiday", F.coalesce("is_holiday", F.lit(False)).cast("int")).withColumn("target_store_closed", F.coalesce("is_store_closed", F.lit(False)).cast("int"))
    return out.drop(*[c for c in calendar.columns if c != "date"], "safe_")


def latest_full_suffix(panel: DataFrame, column: str, least: int = 28) -> DataFrame:
    """Per series, the rows after its last gap; series with fewer than ``least`` of them are left out."""
    gap = Window.partitionBy(*SERIES)
    rows = panel.withColumn("gap_", F.max(F.when(F.col(column).isNull(), F.col("date"))).over(gap)).where(F.col("gap_").isNull() | (F.col("date") > F.col("gap_")))
    return rows.withColumn("n_", F.count("*").over(gap)).where(F.col("n_") >= least).drop("gap_", "n_")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: sorted distinct values from 0; a null is the value __MISSING__."""
    return codes(df.select(F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__")).alias("value")), "value")


def encode(df: DataFrame, column: str, codes: DataFrame, to: str) -> DataFrame:
    """Adds the code of a value, -1 where the book does not know it."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__"))
    return df.join(codes.withColumnRenamed("code", "code_"), key == F.col("value"), "left").withColumn(to, F.coalesce("code_", F.lit(-1))).drop("value", "code_")
