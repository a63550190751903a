"""Queries on panels, features, forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.operators import evaluate as E
from tidegrain.operators import forecast as FC
from tidegrain.operators import panel as P
from tidegrain.operators.ranking import average_rank
from tidegrain.sources.keep import keep

from .inputs import calendar, sales, table
from .registry import part, query

KEYS = "store_key, product_key"
SW = f"PARTITION BY {KEYS} ORDER BY date"


def panel(spark, sf):
    return P.daily_panel(sales(spark, sf), calendar(spark, sf))


part(
    "panel",
    """SELECT u.store_key, u.product_key, u.unit, d.date, CASE WHEN c.is_store_closed THEN NULL ELSE s.quantity_sold END AS quantity_sold, s.revenue, s.is_stockout, s.quantity_sold IS NOT NULL AS row_observed,
  NOT coalesce(c.is_store_closed, false) AS store_open, coalesce(c.is_holiday, false) AS is_holiday,
  CASE WHEN s.quantity_sold IS NULL THEN CASE WHEN coalesce(c.is_store_closed, false) THEN 'STORE_CLOSED' ELSE 'MISSING_OPEN_DAY_RECORD' END END AS sales_missing_reason
  FROM (SELECT store_key, product_key, arg_min(unit, date) FILTER (unit IS NOT NULL) AS unit FROM @sales GROUP BY 1, 2) u
  CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM @sales) d
  LEFT JOIN @sales s ON s.date = d.date AND s.store_key = u.store_key AND s.product_key = u.product_key LEFT JOIN @calendar c ON c.date = d.date""",
)


@query("daily_panel", "panel", "SELECT store_key, product_key, date, quantity_sold, row_observed, store_open, is_holiday, sales_missing_reason FROM panel")
def daily_panel(spark, sf):
    return panel(spark, sf).select("store_key", "product_key", "date", "quantity_sold", "row_observed", "store_open", "is_holiday", "sales_missing_reason")


@query("series_unit", "sales", "SELECT store_key, product_key, arg_min(unit, date) FILTER (unit IS NOT NULL) AS unit FROM sales GROUP BY 1, 2")
def series_unit(spark, sf):
    return P.series_units(sales(spark, sf))


part(
    "recon",
    f"""SELECT *, store_open AND row_observed AND is_stockout IS NULL AS unknown_, CASE WHEN conf IN ('high', 'medium') THEN greatest(quantity_sold, qm) ELSE quantity_sold END AS demand_proxy,
  CASE WHEN cens AND conf NOT IN ('high', 'medium') THEN NULL WHEN conf IN ('high', 'medium') THEN greatest(quantity_sold, qm) ELSE quantity_sold END AS feature_demand FROM (
  SELECT *, CASE WHEN NOT cens THEN 'not_applicable' WHEN sn < 3 AND an < 3 THEN 'low' WHEN sn >= 6 AND rec <= 14 AND spread <= 0.25 THEN 'high' WHEN rec <= 28 AND spread <= 0.5 THEN 'medium' ELSE 'low' END AS conf FROM (
  SELECT *, CASE WHEN sn >= 3 THEN s50 ELSE a50 END AS qm, CASE WHEN sn >= 3 THEN (s75 - s25) / greatest(abs(s50), 1.0) ELSE (a75 - a25) / greatest(abs(a50), 1.0) END AS spread, date - CASE WHEN sn >= 3 THEN sd ELSE ad END AS rec FROM (
  SELECT *, count(ref) OVER a AS an, quantile_cont(ref, 0.25) OVER a AS a25, quantile_cont(ref, 0.5) OVER a AS a50, quantile_cont(ref, 0.75) OVER a AS a75, max(CASE WHEN ref IS NOT NULL THEN date END) OVER a AS ad,
  count(ref) OVER s AS sn, quantile_cont(ref, 0.25) OVER s AS s25, quantile_cont(ref, 0.5) OVER s AS s50, quantile_cont(ref, 0.75) OVER s AS s75, max(CASE WHEN ref IS NOT NULL THEN date END) OVER s AS sd FROM (
  SELECT *, store_open AND coalesce(is_stockout, false) AS cens, CASE WHEN store_open AND row_observed AND is_stockout = false THEN quantity_sold END AS ref FROM @panel)
  WINDOW a AS ({SW} RANGE BETWEEN INTERVAL 84 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), s AS (PARTITION BY {KEYS}, isodow(date) ORDER BY date RANGE BETWEEN INTERVAL 84 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))))""",
)


def rebuilt(spark, sf):
    return P.reconstruct(panel(spark, sf))


@query(
    "reconstruct_demand",
    "recon",
    """SELECT store_key, product_key, date, demand_proxy, feature_demand, CASE WHEN NOT cens THEN 'not_censored' WHEN sn >= 3 THEN 'same_store_product_weekday_median' WHEN an >= 3 THEN 'same_store_product_recent_median' ELSE 'insufficient_history' END AS reconstruction_method,
  conf AS reconstruction_confidence, CASE WHEN NOT cens OR conf <> 'low' THEN '' WHEN sn < 3 AND an < 3 THEN 'RECONSTRUCTION_INSUFFICIENT_SUPPORT' ELSE concat_ws(',', CASE WHEN rec > 28 THEN 'RECONSTRUCTION_STALE_HISTORY' END, CASE WHEN spread > 0.5 THEN 'RECONSTRUCTION_HIGH_DISPERSION' END) END AS reasons,
  CASE WHEN unknown_ THEN 'stockout_unknown' WHEN store_open AND NOT row_observed THEN 'missing_open_day' WHEN cens AND conf IN ('high', 'medium') THEN 'stockout_reconstructed' WHEN cens THEN 'stockout_censored' WHEN NOT store_open THEN 'store_closed' ELSE 'observed' END AS target_quality,
  store_open AND demand_proxy IS NOT NULL AND (NOT cens OR conf IN ('high', 'medium')) AS train_eligible FROM recon""",
)
def reconstruct_demand(spark, sf):
    return rebuilt(spark, sf).select("store_key", "product_key", "date", "demand_proxy", "feature_demand", "reconstruction_method", "reconstruction_confidence", F.array_join("reconstruction_reasons", ",").alias("reasons"), "target_quality", "train_eligible")


def _roll(f, n, least, c="feature_demand"):
    frame = f"OVER ({SW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} >= {least} THEN {f.format(c=c)} {frame} END"


HIST = ", ".join(
    [f"last_value(feature_demand IGNORE NULLS) OVER ({SW} ROWS UNBOUNDED PRECEDING) AS last_observed_demand", f"count(feature_demand) OVER ({SW} ROWS UNBOUNDED PRECEDING) AS history_observation_count"]
    + [f"lag(feature_demand, {n}) OVER ({SW}) AS cutoff_lag_{n}" for n in (1, 2, 7, 14, 28)]
    + [f"{_roll(f, n, least)} AS rolling_{s}_{n}" for n in (7, 14, 28) for s, f, least in (("mean", "avg({c})", max(2, n // 2)), ("median", "quantile_cont({c}, 0.5)", max(2, n // 2)), ("std", "stddev_samp({c})", max(3, n // 2)), ("count", "count({c})", 1))]
    + [f"{_roll('avg({c})', 7, 3)} - CASE WHEN count(feature_demand) OVER ({SW} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) >= 4 THEN avg(feature_demand) OVER ({SW} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) END AS mean_last_7_minus_previous_7"]
    + [f"{_roll('sum({c})', n, 1, 'so')} AS stockout_count_{n}, {_roll('avg({c})', n, 1, 'so')} AS stockout_rate_{n}" for n in (7, 28)]
)
part("hist", f"SELECT *, {HIST} FROM (SELECT *, is_stockout::INT::DOUBLE AS so FROM @recon)")


def history(spark, sf):
    return P.add_history(rebuilt(spark, sf))


def _rounded(columns, digits=5):
    return [F.round(c, digits).alias(c) for c in columns]


def _sql_rounded(columns, digits=5):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _hist_query(name, columns):
    @query(name, "hist", f"SELECT store_key, product_key, date, {_sql_rounded(columns)} FROM hist")
    def run(spark, sf):
        return history(spark, sf).select("store_key", "product_key", "date", *_rounded(columns))

    return run


ffill_count = _hist_query("ffill_count", ["last_observed_demand", "history_observation_count"])
lags = _hist_query("lags", [f"cutoff_lag_{n}" for n in (1, 2, 7, 14, 28)])
rolling_stats = _hist_query("rolling_stats", [f"rolling_{s}_{n}" for n in (7, 14, 28) for s in ("mean", "median", "std", "count")])
mean_diff = _hist_query("mean_diff", ["mean_last_7_minus_previous_7"])
stockout_rates = _hist_query("stockout_rates", [f"stockout_{s}_{n}" for n in (7, 28) for s in ("count", "rate")])

part(
    "train",
    """SELECT h.store_key, h.product_key, h.date AS cutoff_date, g.horizon, (h.date + g.horizon::INT) AS target_date, t.demand_proxy AS target, coalesce(t.store_open AND t.demand_proxy IS NOT NULL AND (NOT t.cens OR t.conf IN ('high', 'medium')), false) AS target_train_eligible,
  h.rolling_median_7, h.rolling_median_28, h.rolling_mean_7, h.rolling_mean_28, h.rolling_std_28, h.rolling_count_7, h.last_observed_demand, h.history_observation_count
  FROM @hist h CROSS JOIN (SELECT unnest(range(1, 8)) AS horizon) g LEFT JOIN @recon t ON t.date = h.date + g.horizon::INT AND t.store_key = h.store_key AND t.product_key = h.product_key""",
)
part("rows_", "SELECT t.*, " + ", ".join(f"l{n}.feature_demand AS seasonal_lag_{n}_target" for n in (7, 14, 28)) + " FROM @train t " + " ".join(f"LEFT JOIN @recon l{n} ON l{n}.store_key = t.store_key AND l{n}.product_key = t.product_key AND l{n}.date = t.target_date - {n} AND l{n}.date <= t.cutoff_date" for n in (7, 14, 28)))
NAIVE_SQL = "greatest(0, coalesce(seasonal_lag_7_target, rolling_median_7, rolling_median_28, last_observed_demand, 0))"
part(
    "pred",
    f"""SELECT *, greatest(0, p50 - 0.5 * coalesce(rolling_std_28, 1)) AS p25, p50 + 0.4 * coalesce(rolling_std_28, 1) - 2 AS p75, greatest(0, coalesce(rolling_mean_7, last_observed_demand, 0)) AS ma7, greatest(0, coalesce(rolling_mean_28, last_observed_demand, 0)) AS ma28
  FROM (SELECT *, {NAIVE_SQL} AS p50 FROM @rows_ WHERE target IS NOT NULL AND target_train_eligible AND history_observation_count >= 28)""",
)


def lagged_rows(spark, sf):
    return P.training_rows(history(spark, sf))


def eligible(rows, least=28):
    """Rows that may be learned from: target known and accepted, history long enough."""
    return rows.where(F.col("target").isNotNull() & F.col("target_train_eligible") & (F.col("history_observation_count") >= least))


def predictions(spark, sf):
    """Seasonal naive quantiles (which cross at times) and moving averages on eligible rows."""
    value, _ = FC.seasonal_naive()
    rows = eligible(lagged_rows(spark, sf)).withColumn("p50", value)
    spread = F.coalesce("rolling_std_28", F.lit(1.0))
    return rows.withColumn("p25", F.greatest(F.lit(0.0), F.col("p50") - 0.5 * spread)).withColumn("p75", F.col("p50") + 0.4 * spread - 2).withColumn("ma7", FC.moving_average(7)[0]).withColumn("ma28", FC.moving_average(28)[0])


@query("training_table", "train", "SELECT store_key, product_key, cutoff_date, horizon, target_date, target, target_train_eligible FROM train")
def training_table(spark, sf):
    return lagged_rows(spark, sf).select("store_key", "product_key", "cutoff_date", "horizon", "target_date", "target", "target_train_eligible")


@query("seasonal_lags", "rows_", "SELECT store_key, product_key, cutoff_date, horizon, seasonal_lag_7_target, seasonal_lag_14_target, seasonal_lag_28_target FROM rows_")
def seasonal_lags(spark, sf):
    return lagged_rows(spark, sf).select("store_key", "product_key", "cutoff_date", "horizon", "seasonal_lag_7_target", "seasonal_lag_14_target", "seasonal_lag_28_target")


@query("eligible_rows", "rows_", "SELECT horizon, count(*) AS n, sum(target) AS target FROM rows_ WHERE target IS NOT NULL AND target_train_eligible AND history_observation_count >= 28 GROUP BY 1")
def eligible_rows(spark, sf):
    return eligible(lagged_rows(spark, sf)).groupBy("horizon").agg(F.count("*").alias("n"), F.sum("target").alias("target"))


@query("date_features", "calendar", "SELECT date, isodow(date) - 1 AS day_of_week, (isodow(date) >= 6)::INT AS is_weekend, month(date) AS month, day(date) AS day_of_month, (day(date) - 1) // 7 + 1 AS week_of_month, weekofyear(date) AS week_of_year FROM calendar")
def date_features(spark, sf):
    return calendar(spark, sf).select("date", *[c.alias(n) for n, c in P.date_features(F.col("date")).items()])


WEATHER_OK = "weather_kind = 'forecast' AND weather_issued_at <= cutoff_date AND weather_available_at <= cutoff_date"


@query(
    "weather_mask",
    "train calendar",
    f"""SELECT t.store_key, t.product_key, t.cutoff_date, t.horizon, CASE WHEN {WEATHER_OK} THEN temperature END AS target_temperature, CASE WHEN {WEATHER_OK} THEN rainfall END AS target_rainfall,
  coalesce(is_holiday, false)::INT AS target_is_holiday, coalesce(is_store_closed, false)::INT AS target_store_closed, (c.date IS NOT NULL)::INT AS calendar_available FROM train t LEFT JOIN calendar c ON c.date = t.target_date""",
)
def weather_mask(spark, sf):
    rows = P.add_target_calendar(lagged_rows(spark, sf).drop("is_holiday"), calendar(spark, sf))
    return rows.select("store_key", "product_key", "cutoff_date", "horizon", "target_temperature", "target_rainfall", "target_is_holiday", "target_store_closed", "calendar_available")


@query("weather_bundle", "calendar", "SELECT date, CASE WHEN weather_kind = 'forecast' AND weather_issued_at <= DATE '2001-09-01' AND weather_available_at <= DATE '2001-09-01' THEN temperature END AS temperature FROM calendar WHERE date >= DATE '2001-09-01'")
def weather_bundle(spark, sf):
    c = calendar(spark, sf).where("date >= DATE '2001-09-01'").withColumn("origin", F.lit("2001-09-01").cast("date"))
    return c.select("date", F.when(P.weather_safe("origin"), F.col("temperature")).alias("temperature"))


@query("category_codes", "sales", "SELECT s.store_key, coalesce(b.code, -1) AS code, count(*) AS n FROM sales s LEFT JOIN (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT store_key AS value FROM sales WHERE store_key <> 'S3')) b ON s.store_key = b.value GROUP BY 1, 2")
def category_codes(spark, sf):
    s = sales(spark, sf)
    return P.encode(s.select("store_key"), "store_key", P.category_codes(s.where("store_key <> 'S3'"), "store_key"), "code").groupBy("store_key", "code").agg(F.count("*").alias("n"))


@query("unit_backfill", "sales", "SELECT s.product_key, coalesce(s.unit, m.unit) AS unit, count(*) AS n FROM sales s LEFT JOIN (SELECT p_type, ['kg', 'g', 'unit'][max(p_size) % 3 + 1] AS unit FROM part GROUP BY 1) m ON s.product_key = m.p_type GROUP BY 1, 2")
def unit_backfill(spark, sf):
    units = F.array(F.lit("kg"), F.lit("g"), F.lit("unit"))
    menu = table(spark, sf, "part").groupBy(F.col("p_type").alias("product_key")).agg(F.element_at(units, F.max("p_size") % 3 + 1).alias("menu_unit"))
    return sales(spark, sf).join(menu, "product_key", "left").groupBy("product_key", F.coalesce("unit", "menu_unit").alias("unit")).agg(F.count("*").alias("n"))


@query("feature_table", "rows_ calendar", f"SELECT r.horizon, count(*) AS n, round(avg(r.target), 5) AS target, round(avg(r.rolling_mean_7), 5) AS rolling_mean_7, round(avg(r.seasonal_lag_14_target), 5) AS seasonal_lag_14_target, round(avg(CASE WHEN {WEATHER_OK} THEN temperature END), 5) AS target_temperature FROM rows_ r LEFT JOIN calendar c ON c.date = r.target_date GROUP BY 1")
def feature_table(spark, sf):
    rows = P.add_target_calendar(lagged_rows(spark, sf).drop("is_holiday"), calendar(spark, sf))
    return rows.groupBy("horizon").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("target", "rolling_mean_7", "seasonal_lag_14_target", "target_temperature")])


@query("runtime_rows", "hist recon", "SELECT h.store_key, h.product_key, g.horizon, h.date + g.horizon::INT AS target_date, h.last_observed_demand, l.feature_demand AS seasonal_lag_7_target FROM hist h CROSS JOIN (SELECT unnest(range(1, 8)) AS horizon) g LEFT JOIN recon l ON l.store_key = h.store_key AND l.product_key = h.product_key AND l.date = h.date + g.horizon::INT - 7 AND l.date <= h.date WHERE h.date = DATE '2001-09-01'")
def runtime_rows(spark, sf):
    return lagged_rows(spark, sf).where("cutoff_date = DATE '2001-09-01'").select("store_key", "product_key", "horizon", "target_date", "last_observed_demand", "seasonal_lag_7_target")


@query(
    "seasonal_naive",
    "rows_",
    f"SELECT store_key, product_key, cutoff_date, horizon, {NAIVE_SQL} AS prediction, CASE WHEN seasonal_lag_7_target IS NOT NULL THEN '' WHEN rolling_median_7 IS NOT NULL THEN 'FALLBACK_ROLLING_MEDIAN_7' WHEN rolling_median_28 IS NOT NULL THEN 'FALLBACK_ROLLING_MEDIAN_28' WHEN last_observed_demand IS NOT NULL THEN 'FALLBACK_LAST_OBSERVED_DEMAND' ELSE 'FALLBACK_ZERO_NO_HISTORY' END AS warning FROM rows_",
)
def seasonal_naive(spark, sf):
    value, label = FC.seasonal_naive()
    return lagged_rows(spark, sf).select("store_key", "product_key", "cutoff_date", "horizon", value.alias("prediction"), label.alias("warning"))


@query("moving_average", "hist", "SELECT store_key, product_key, date, round(greatest(0, coalesce(rolling_mean_7, last_observed_demand, 0)), 5) AS ma7, round(greatest(0, coalesce(rolling_mean_28, last_observed_demand, 0)), 5) AS ma28, CASE WHEN rolling_mean_28 IS NOT NULL THEN '' WHEN last_observed_demand IS NOT NULL THEN 'FALLBACK_LAST_OBSERVED_DEMAND' ELSE 'FALLBACK_ZERO_NO_HISTORY' END AS warning FROM hist")
def moving_average(spark, sf):
    (a, _), (b, label) = FC.moving_average(7), FC.moving_average(28)
    return history(spark, sf).select("store_key", "product_key", "date", F.round(a, 5).alias("ma7"), F.round(b, 5).alias("ma28"), label.alias("warning"))


part("gapless", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY store_key, product_key) AS k FROM (SELECT *, max(CASE WHEN quantity_sold IS NULL THEN date END) OVER (PARTITION BY store_key, product_key) AS gap FROM @panel) WHERE gap IS NULL OR date > gap) WHERE k >= 2")


@query("contiguous_suffix", "gapless", "SELECT store_key, product_key, date, quantity_sold FROM gapless")
def contiguous_suffix(spark, sf):
    return P.latest_full_suffix(panel(spark, sf), "quantity_sold", 2).select("store_key", "product_key", "date", "quantity_sold")


@query("holt_winters")
def holt_winters(spark, sf):
    filled = history(spark, sf).where("last_observed_demand IS NOT NULL").select("store_key", "product_key", "date", F.col("last_observed_demand").alias("y"))
    return FC.holt_winters(filled)


part("split_", "SELECT p.*, CASE WHEN target_date <= te THEN 'train' WHEN target_date <= ce AND cutoff_date >= te THEN 'calibration' WHEN target_date <= ce THEN 'calibration_purged' WHEN cutoff_date >= ce THEN 'test' ELSE 'test_purged' END AS split FROM @pred p CROSS JOIN (SELECT max(target_date) FILTER (b > 28) AS ce, max(target_date) FILTER (b > 56) AS te FROM (SELECT target_date, row_number() OVER (ORDER BY target_date DESC) AS b FROM (SELECT DISTINCT target_date FROM @pred)))")


def splits(spark, sf):
    return E.final_split(keep(predictions(spark, sf)))


@query("final_split_audit", "split_", "SELECT split, count(*) AS n, min(cutoff_date) AS first_origin, max(cutoff_date) AS last_origin, min(target_date) AS first_target, max(target_date) AS last_target FROM split_ GROUP BY 1")
def final_split_audit(spark, sf):
    return splits(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("cutoff_date").alias("first_origin"), F.max("cutoff_date").alias("last_origin"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"))


part("cal_", "SELECT * FROM @split_ WHERE split = 'calibration'")
part("fixed_", "SELECT store_key, product_key, target_date, horizon, target, greatest(0, s[1]) AS p25, greatest(0, s[2]) AS p50, greatest(0, s[3]) AS p75, crossed, split FROM (SELECT *, list_sort([p25, p50, p75]) AS s, p25 > p50 OR p50 > p75 AS crossed FROM @split_)")


def repaired(spark, sf):
    return splits(spark, sf).select("store_key", "product_key", "target_date", "horizon", "target", *FC.repair(), "split")


@query("quantile_repair", "fixed_", "SELECT store_key, product_key, target_date, horizon, round(p25, 5) AS p25, round(p50, 5) AS p50, round(p75, 5) AS p75, crossed FROM fixed_")
def quantile_repair(spark, sf):
    return repaired(spark, sf).select("store_key", "product_key", "target_date", "horizon", *_rounded(["p25", "p50", "p75"]), "crossed")


part(
    "point_",
    """SELECT h.horizon, (n / (n + 20.0)) * m + (1 - n / (n + 20.0)) * g AS "offset", n, n_dates FROM (SELECT horizon, quantile_cont(target - p50, 0.5) AS m, count(*) AS n, count(DISTINCT target_date) AS n_dates FROM @fixed_ WHERE split = 'calibration' GROUP BY 1) h
  CROSS JOIN (SELECT quantile_cont(target - p50, 0.5) AS g FROM @fixed_ WHERE split = 'calibration') WHERE n >= 30 AND n_dates >= 7
  UNION ALL SELECT NULL, quantile_cont(target - p50, 0.5), count(*), count(DISTINCT target_date) FROM @fixed_ WHERE split = 'calibration'""",
)


def calibration(spark, sf):
    return repaired(spark, sf).where("split = 'calibration'")


@query("point_corrector", "point_", 'SELECT horizon, round("offset", 6) AS "offset", n, n_dates FROM point_')
def point_corrector(spark, sf):
    return FC.fit_point(keep(calibration(spark, sf))).withColumn("offset", F.round("offset", 6))


part(
    "cqr_",
    """SELECT horizon, max(s) FILTER (r = ceil((n + 1) * 0.5)) AS correction, n, ceil((n + 1) * 0.5) / n AS level FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY s) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM (
  SELECT unnest([horizon, NULL]) AS horizon, greatest(p25 - target, target - p75) AS s FROM @fixed_ WHERE split = 'calibration')) GROUP BY horizon, n HAVING horizon IS NULL OR n >= 30""",
)


@query("cqr_fit", "cqr_", "SELECT horizon, round(correction, 6) AS correction, n, round(level, 8) AS level FROM cqr_")
def cqr_fit(spark, sf):
    return FC.fit_cqr(calibration(spark, sf)).select("horizon", F.round("correction", 6).alias("correction"), "n", F.round("level", 8).alias("level"))


part(
    "widened",
    """SELECT f.*, correction, source, least(greatest(0, p25 - correction), p50) AS interval_lower, greatest(p75 + correction, p50) AS interval_upper FROM (SELECT f.*, coalesce(h.correction, g.correction) AS correction, CASE WHEN h.correction IS NULL THEN 'global' ELSE 'horizon_' || f.horizon END AS source
  FROM @fixed_ f LEFT JOIN @cqr_ h ON h.horizon = f.horizon CROSS JOIN (SELECT correction FROM @cqr_ WHERE horizon IS NULL) g WHERE f.split = 'test') f""",
)


def widened(spark, sf):
    both = keep(repaired(spark, sf))
    rows = FC.by_horizon(both.where("split = 'test'"), FC.fit_cqr(both.where("split = 'calibration'")), "correction")
    return rows.select("*", *FC.widen())


@query("cqr_apply", "widened", "SELECT store_key, product_key, target_date, horizon, source AS correction_source, round(interval_lower, 5) AS interval_lower, round(interval_upper, 5) AS interval_upper FROM widened")
def cqr_apply(spark, sf):
    return widened(spark, sf).select("store_key", "product_key", "target_date", "horizon", "correction_source", *_rounded(["interval_lower", "interval_upper"]))


METRIC_SQL = "count(*) AS n, round(avg(abs(target - p50)), 6) AS mae, round(avg(p50 - target), 6) AS bias, round(sum(abs(target - p50)) / nullif(sum(abs(target)), 0), 6) AS wape, " + ", ".join(f"round(avg(greatest((target - p{k}) * {k / 100}, (target - p{k}) * {k / 100 - 1})), 6) AS pinball_{k}" for k in (25, 50, 75)) + ", round(avg((p25 > p50 OR p50 > p75)::INT), 6) AS crossing_rate"


@query("metrics_by_horizon", "pred", f"SELECT horizon, {METRIC_SQL} FROM pred GROUP BY GROUPING SETS ((), (horizon))")
def metrics_by_horizon(spark, sf):
    m = E.overall_and_by(predictions(spark, sf), ["horizon"], E.quantile_metrics())
    return m.select("horizon", "n", *_rounded([c for c in m.columns if c not in ("horizon", "n")], 6))


@query("model_comparison", "pred", " UNION ALL ".join(f"SELECT '{m}' AS model, horizon, round(sum(abs(target - {m})) / nullif(sum(abs(target)), 0), 6) AS wape, round(avg(abs(target - {m})), 6) AS mae, round(avg({m} - target), 6) AS bias FROM pred GROUP BY GROUPING SETS ((), (horizon))" for m in ("p50", "ma7", "ma28")))
def model_comparison(spark, sf):
    return E.compare_models(predictions(spark, sf), ["p50", "ma7", "ma28"]).select("model", "horizon", *_rounded(["wape", "mae", "bias"], 6))


@query("best_baseline", "pred", "SELECT m AS best, w AS wape FROM (SELECT m, round(w, 6) AS w FROM (SELECT 'ma7' AS m, sum(abs(target - ma7)) / sum(target) AS w FROM pred UNION ALL SELECT 'ma28', sum(abs(target - ma28)) / sum(target) FROM pred)) ORDER BY w, m LIMIT 1")
def best_baseline(spark, sf):
    m = E.compare_models(predictions(spark, sf), ["ma7", "ma28"]).where("horizon IS NULL")
    least = F.min(F.struct(F.round("wape", 6).alias("wape"), F.col("model").alias("best")))
    return m.agg(least.alias("x")).select("x.best", "x.wape")


@query("interval_metrics", "widened", "SELECT horizon, count(*) AS n, round(avg((target BETWEEN interval_lower AND interval_upper)::INT), 6) AS coverage, round(avg((target BETWEEN interval_lower AND interval_upper)::INT) - 0.5, 6) AS gap, round(avg(interval_upper - interval_lower), 6) AS width, count(*) FILTER (interval_lower > interval_upper) AS invalid, count(*) FILTER (p50 < interval_lower OR p50 > interval_upper) AS excludes_median FROM widened GROUP BY GROUPING SETS ((), (horizon))")
def interval_metrics(spark, sf):
    m = E.overall_and_by(widened(spark, sf), ["horizon"], E.interval_metrics())
    return m.select("horizon", "n", *_rounded(["coverage", "gap", "width"], 6), "invalid", "excludes_median")


part("folds_", "SELECT fold_id, d[i] AS train_end, d[i + 1] AS validation_start, d[least(i + 14, len(d))] AS validation_end FROM (SELECT d, unnest(range(0, len(d))) AS k, 84 + 14 * k AS i, k + 1 AS fold_id FROM (SELECT list(DISTINCT target_date ORDER BY target_date) AS d FROM @pred)) WHERE i < len(d) ORDER BY fold_id DESC LIMIT 3")


@query("walk_forward_folds", "folds_", "SELECT * FROM folds_")
def walk_forward_folds(spark, sf):
    return E.walk_forward_folds(predictions(spark, sf).select("target_date").distinct())


@query("walk_forward_metrics", "folds_ pred", "SELECT fold_id, horizon, count(*) AS n, round(sum(abs(target - p50)) / nullif(sum(abs(target)), 0), 6) AS wape FROM pred JOIN folds_ ON target_date BETWEEN validation_start AND validation_end AND cutoff_date >= train_end GROUP BY GROUPING SETS ((), (fold_id), (horizon))")
def walk_forward_metrics(spark, sf):
    p = keep(predictions(spark, sf))
    rows = E.walk_forward_rows(p, E.walk_forward_folds(p))
    g = rows.groupingSets([[], [F.col("fold_id")], [F.col("horizon")]], F.col("fold_id"), F.col("horizon"))
    return g.agg(F.count("*").alias("n"), F.round(E.wape(F.col("target"), F.col("p50")), 6).alias("wape"))


part("fit_rows", "SELECT f.fold_id, p.store_key, p.product_key, p.horizon, p.target - p.p50 AS residual FROM @pred p JOIN @folds_ f ON p.target_date <= f.train_end")
part(
    "fold_fit",
    " UNION ALL ".join(f"SELECT '{name}' AS level, fold_id, {', '.join(c if c in keys else e + ' AS ' + c for c, e in (('store_key', chr(39) * 2), ('product_key', chr(39) * 2), ('horizon', '-1')))}, count(*) AS n, quantile_cont(residual, [0.25, 0.5, 0.75]) AS q FROM @fit_rows GROUP BY {', '.join(['fold_id', *keys])} HAVING count(*) >= 20" for name, keys in E.LEVELS),
)
part(
    "fold_pred",
    """SELECT r.*, greatest(0, r.anchor + coalesce(q[1], 0)) AS p25, greatest(0, r.anchor + coalesce(q[2], 0)) AS p50, greatest(0, r.anchor + coalesce(q[3], 0)) AS p75 FROM (SELECT v.*, CASE WHEN a.q IS NOT NULL THEN 'series' WHEN b.q IS NOT NULL THEN 'horizon' WHEN c.q IS NOT NULL THEN 'all' ELSE 'none' END AS level, coalesce(a.q, b.q, c.q) AS q
  FROM (SELECT f.fold_id, p.store_key, p.product_key, p.horizon, p.target_date, p.target, p.p50 AS anchor, p.ma7, p.ma28 FROM @pred p JOIN @folds_ f ON p.target_date BETWEEN validation_start AND validation_end AND cutoff_date >= train_end) v
  LEFT JOIN @fold_fit a ON a.level = 'series' AND a.fold_id = v.fold_id AND a.store_key = v.store_key AND a.product_key = v.product_key AND a.horizon = v.horizon
  LEFT JOIN @fold_fit b ON b.level = 'horizon' AND b.fold_id = v.fold_id AND b.horizon = v.horizon LEFT JOIN @fold_fit c ON c.level = 'all' AND c.fold_id = v.fold_id) r""",
)


def fold_inputs(spark, sf):
    rows = keep(predictions(spark, sf).withColumn("anchor", F.col("p50")).drop("p25", "p50", "p75"))
    return rows, keep(E.walk_forward_folds(rows))


@query("fold_quantiles", "fold_fit", "SELECT level, fold_id, store_key, product_key, horizon, n, round(q[1], 6) AS q25, round(q[2], 6) AS q50, round(q[3], 6) AS q75 FROM fold_fit")
def fold_quantiles(spark, sf):
    """What each fold learns from the rows up to its training end, of all folds in one pass."""
    return E.fold_quantiles(*fold_inputs(spark, sf)).select("level", "fold_id", "store_key", "product_key", "horizon", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


FOLD_MODELS = ("p50", "anchor", "ma7", "ma28")


@query(
    "fold_metrics",
    "fold_pred",
    f"""SELECT fold_id, horizon, count(*) AS n, {", ".join(f"round(sum(abs(target - {m})) / nullif(sum(abs(target)), 0), 6) AS wape_{m}" for m in FOLD_MODELS)}, {", ".join(f"round(avg(greatest((target - p{k}) * {k / 100}::DOUBLE, (target - p{k}) * {k / 100 - 1}::DOUBLE)), 6) AS pinball_{k}" for k in (25, 50, 75))},
  round(avg((target BETWEEN p25 AND p75)::INT), 6) AS coverage, count(*) FILTER (level = 'series') AS n_series, count(*) FILTER (level = 'horizon') AS n_horizon FROM fold_pred GROUP BY GROUPING SETS ((), (fold_id), (fold_id, horizon))""",
)
def fold_metrics(spark, sf):
    """Errors of the quantiles fitted on each fold and of its baselines, of all folds, by fold, and by fold and horizon."""
    out = E.fold_forecasts(*fold_inputs(spark, sf))
    g = out.groupingSets([[], [F.col("fold_id")], [F.col("fold_id"), F.col("horizon")]], F.col("fold_id"), F.col("horizon"))
    y = F.col("target")
    return g.agg(
        F.count("*").alias("n"), *[F.round(E.wape(y, F.col(m)), 6).alias(f"wape_{m}") for m in FOLD_MODELS], *[F.round(E.pinball(y, F.col(f"p{k}"), k / 100), 6).alias(f"pinball_{k}") for k in (25, 50, 75)],
        F.round(F.avg(((y >= F.col("p25")) & (y <= F.col("p75"))).cast("double")), 6).alias("coverage"), F.count_if(F.col("level") == "series").alias("n_series"), F.count_if(F.col("level") == "horizon").alias("n_horizon"),
    )


@query(
    "fold_audit",
    "folds_ rows_ train",
    """SELECT fold_id, count(*) AS n_candidates, count(*) FILTER (NOT (a OR b OR c OR d)) AS n_eligible, count(*) FILTER (a) AS n_origin_too_early, count(*) FILTER (b) AS n_not_accepted, count(*) FILTER (c) AS n_no_target, count(*) FILTER (d) AS n_short_history
  FROM (SELECT f.fold_id, t.cutoff_date < f.train_end AS a, NOT t.target_train_eligible AS b, t.target IS NULL AS c, coalesce(t.history_observation_count < 28, true) AS d FROM train t JOIN folds_ f ON t.target_date BETWEEN validation_start AND validation_end) GROUP BY 1""",
)
def fold_audit(spark, sf):
    every = keep(lagged_rows(spark, sf))
    reasons = {"not_accepted": ~F.col("target_train_eligible"), "no_target": F.col("target").isNull(), "short_history": F.col("history_observation_count") < 28}
    return E.fold_audit(every, E.walk_forward_folds(keep(predictions(spark, sf).select("target_date").distinct())), reasons)


@query("fold_union", "folds_ pred", "SELECT fold_id, min(target_date) AS first_date, count(*) AS n FROM pred JOIN folds_ ON target_date BETWEEN validation_start AND validation_end AND cutoff_date >= train_end GROUP BY 1")
def fold_union(spark, sf):
    p = keep(predictions(spark, sf))
    return E.walk_forward_rows(p, E.walk_forward_folds(p)).groupBy("fold_id").agg(F.min("target_date").alias("first_date"), F.count("*").alias("n"))


@query("common_key_matrix", "pred", "SELECT store_key, product_key, target_date, horizon, target, round(p50, 5) AS naive, round(ma7, 5) AS ma7 FROM pred")
def common_key_matrix(spark, sf):
    keys = ["store_key", "product_key", "target_date", "horizon"]
    p = keep(predictions(spark, sf)).withColumnRenamed("p50", "naive")
    long = p.unpivot([*keys, "target"], ["naive", "ma7"], "method", "prediction")
    wide = long.groupBy(*keys).pivot("method", ["naive", "ma7"]).agg(F.first("prediction"))
    actual = long.groupBy(*keys).agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most")
    return wide.join(actual, keys).where("naive IS NOT NULL AND ma7 IS NOT NULL").select(*keys, "target", *_rounded(["naive", "ma7"]))


@query("block_plan")
def block_plan(spark, sf):
    return E.block_plan(keep(predictions(spark, sf).select("target_date").distinct()), 7, 200, 11)


@query("paired_wape_bootstrap")
def paired_wape_bootstrap(spark, sf):
    p = keep(predictions(spark, sf))
    return E.paired_wape(p, E.block_plan(p, 7, 200, 11), "p50", ["ma7", "ma28"])


@query("interval_bootstrap")
def interval_bootstrap(spark, sf):
    w = keep(widened(spark, sf))
    return E.interval_bootstrap(w, E.block_plan(w, 7, 200, 11))


part("resid", "SELECT store_key, product_key, cutoff_date AS forecast_origin, target_date, horizon, target AS actual, least(p25, p50, p75) AS p25, p50, greatest(p25, p50, p75) AS p75, target_date + 1 AS actual_known_at, target - p50 AS raw_residual, (target - p50) / greatest(greatest(p25, p50, p75) - least(p25, p50, p75), 0.000001) AS scaled_residual FROM @pred")


def residuals(spark, sf):
    """Residual history with the day on which each actual became known."""
    low, high = F.least("p25", "p50", "p75"), F.greatest("p25", "p50", "p75")
    return predictions(spark, sf).select(
        "store_key", "product_key", F.col("cutoff_date").alias("forecast_origin"), "target_date", "horizon", F.col("target").alias("actual"), low.alias("p25"), "p50", high.alias("p75"), F.date_add("target_date", 1).alias("actual_known_at"),
        (F.col("target") - F.col("p50")).alias("raw_residual"), ((F.col("target") - F.col("p50")) / F.greatest(high - low, F.lit(1e-6))).alias("scaled_residual"),
    )


@query("residual_history", "resid", "SELECT store_key, horizon, count(*) AS n, round(avg(raw_residual), 5) AS mean_residual, max(actual_known_at) AS latest FROM resid WHERE actual_known_at <= DATE '2001-09-15' AND forecast_origin + horizon::INT = target_date GROUP BY 1, 2")
def residual_history(spark, sf):
    known = residuals(spark, sf).where("actual_known_at <= DATE '2001-09-15' AND date_add(forecast_origin, horizon) = target_date AND p25 <= p50 AND p50 <= p75")
    return known.groupBy("store_key", "horizon").agg(F.count("*").alias("n"), F.round(F.avg("raw_residual"), 5).alias("mean_residual"), F.max("actual_known_at").alias("latest"))


@query("scaled_residuals", "resid", "SELECT store_key, product_key, target_date, horizon, round(scaled_residual, 4) AS scaled_residual FROM resid")
def scaled_residuals(spark, sf):
    return residuals(spark, sf).select("store_key", "product_key", "target_date", "horizon", F.round("scaled_residual", 4).alias("scaled_residual"))


@query("label_availability", "resid", "SELECT horizon, min(actual_known_at) AS first_known, max(actual_known_at) AS last_known, count(*) FILTER (actual_known_at > DATE '2001-10-01') AS n_late FROM resid GROUP BY 1")
def label_availability(spark, sf):
    return residuals(spark, sf).groupBy("horizon").agg(F.min("actual_known_at").alias("first_known"), F.max("actual_known_at").alias("last_known"), F.count_if(F.col("actual_known_at") > F.lit("2001-10-01").cast("date")).alias("n_late"))


@query("average_ranks", "resid", "SELECT store_key, product_key, target_date, horizon, rank() OVER (PARTITION BY store_key, product_key, horizon ORDER BY raw_residual) + (count(*) OVER (PARTITION BY store_key, product_key, horizon, raw_residual) - 1) / 2 AS avg_rank FROM resid")
def average_ranks(spark, sf):
    return residuals(spark, sf).select("store_key", "product_key", "target_date", "horizon", average_rank(["store_key", "product_key", "horizon"], "raw_residual").alias("avg_rank"))


part(
    "rq",
    """SELECT t.store_key, t.product_key, t.target_date, t.horizon, t.target, CASE WHEN a.q IS NOT NULL THEN 'series' WHEN b.q IS NOT NULL THEN 'horizon' ELSE 'all' END AS level, coalesce(a.q, b.q, c.q) AS q, t.p50 AS anchor FROM (SELECT * FROM @split_ WHERE split = 'test') t
  LEFT JOIN (SELECT store_key, product_key, horizon, quantile_cont(target - p50, [0.25, 0.5, 0.75]) AS q FROM @split_ WHERE split = 'train' GROUP BY 1, 2, 3 HAVING count(*) >= 20) a ON a.store_key = t.store_key AND a.product_key = t.product_key AND a.horizon = t.horizon
  LEFT JOIN (SELECT horizon, quantile_cont(target - p50, [0.25, 0.5, 0.75]) AS q FROM @split_ WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 20) b ON b.horizon = t.horizon CROSS JOIN (SELECT quantile_cont(target - p50, [0.25, 0.5, 0.75]) AS q FROM @split_ WHERE split = 'train') c""",
)


def residual_forecast(spark, sf):
    s = keep(splits(spark, sf)).withColumn("anchor", F.col("p50")).drop("p25", "p50", "p75")
    return FC.residual_quantiles(s.where("split = 'train'"), s.where("split = 'test'"))


@query("residual_quantile_forecast", "rq", "SELECT store_key, product_key, target_date, horizon, level, round(greatest(0, anchor + q[1]), 5) AS p25, round(greatest(0, anchor + q[2]), 5) AS p50, round(greatest(0, anchor + q[3]), 5) AS p75 FROM rq")
def residual_quantile_forecast(spark, sf):
    return residual_forecast(spark, sf).select("store_key", "product_key", "target_date", "horizon", "level", *_rounded(["p25", "p50", "p75"]))


@query(
    "forecast_job",
    "fixed_ point_ cqr_ calendar",
    """SELECT f.store_key, f.product_key, f.target_date, f.horizon, round(CASE WHEN c.is_store_closed THEN 0 ELSE greatest(0, p50 + o) END, 4) AS p50, round(CASE WHEN c.is_store_closed THEN 0 ELSE least(greatest(0, greatest(0, p25 + o) - k), greatest(0, p50 + o)) END, 4) AS interval_lower,
  round(CASE WHEN c.is_store_closed THEN 0 ELSE greatest(greatest(0, p75 + o) + k, greatest(0, p50 + o)) END, 4) AS interval_upper, concat_ws(',', CASE WHEN k_h IS NULL THEN 'GLOBAL_CALIBRATION' END, CASE WHEN c.is_store_closed THEN 'STORE_CLOSED' END) AS warnings
  FROM (SELECT f.*, coalesce(ph."offset", pg."offset") AS o, ch.correction AS k_h, coalesce(ch.correction, cg.correction) AS k FROM fixed_ f LEFT JOIN point_ ph ON ph.horizon = f.horizon CROSS JOIN (SELECT "offset" FROM point_ WHERE horizon IS NULL) pg LEFT JOIN cqr_ ch ON ch.horizon = f.horizon CROSS JOIN (SELECT correction FROM cqr_ WHERE horizon IS NULL) cg WHERE f.split = 'test') f LEFT JOIN calendar c ON c.date = f.target_date""",
)
def forecast_job(spark, sf):
    both = keep(repaired(spark, sf))
    cal = both.where("split = 'calibration'")
    rows = FC.by_horizon(FC.by_horizon(both.where("split = 'test'"), FC.fit_point(cal), "offset"), FC.fit_cqr(cal), "correction")
    for q in ("p25", "p50", "p75"):
        rows = rows.withColumn(q, F.greatest(F.lit(0.0), F.col(q) + F.col("offset")))
    rows = rows.select("*", *FC.widen()).join(calendar(spark, sf).select(F.col("date").alias("target_date"), "is_store_closed"), "target_date", "left")
    closed = F.coalesce("is_store_closed", F.lit(False))
    for c in ("p50", "interval_lower", "interval_upper"):
        rows = rows.withColumn(c, F.round(F.when(closed, 0.0).otherwise(F.col(c)), 4))
    notes = F.filter(F.array(F.when(F.col("correction_source") == "global", F.lit("GLOBAL_CALIBRATION")), F.when(closed, F.lit("STORE_CLOSED"))), lambda x: x.isNotNull())
    return rows.select("store_key", "product_key", "target_date", "horizon", "p50", "interval_lower", "interval_upper", F.array_join(notes, ",").alias("warnings"))


@query("override_rows", "sales calendar", "SELECT 'SHOP' AS store_key, p.product_key, c.date AS target_date, (c.date - DATE '2001-09-01')::INT AS horizon, 10.0::DOUBLE AS p50, 'declared' AS forecast_method FROM (SELECT DISTINCT product_key FROM sales WHERE product_key LIKE '%O%') p JOIN calendar c ON c.date BETWEEN DATE '2001-09-02' AND DATE '2001-09-08' UNION ALL SELECT store_key, product_key, date, 0, max(quantity_sold), 'observed' FROM sales WHERE date = DATE '2001-09-01' AND product_key NOT LIKE '%O%' GROUP BY 1, 2, 3")
def override_rows(spark, sf):
    s = sales(spark, sf)
    declared = s.select("product_key").distinct().where("product_key LIKE '%O%'")
    days = calendar(spark, sf).where("date BETWEEN DATE '2001-09-02' AND DATE '2001-09-08'").select(F.col("date").alias("target_date"))
    made = declared.join(F.broadcast(days), F.lit(True)).select(F.lit("SHOP").alias("store_key"), "product_key", "target_date", F.datediff("target_date", F.lit("2001-09-01")).alias("horizon"), F.lit(10.0).alias("p50"), F.lit("declared").alias("forecast_method"))
    rest = s.where("date = DATE '2001-09-01'").join(declared, "product_key", "left_anti").groupBy("store_key", "product_key", F.col("date").alias("target_date")).agg(F.max("quantity_sold").alias("p50"))
    return made.unionByName(rest.withColumn("horizon", F.lit(0)).withColumn("forecast_method", F.lit("observed")))


@query("training_job")
def training_job(spark, sf):
    """Splits, fits on train and calibration, scores on test: the model against its baselines and its interval."""
    test = residual_forecast(spark, sf)
    compared = E.compare_models(test, ["p50", "ma7", "ma28"]).where("horizon IS NULL").select(F.col("model").alias("name"), F.col("wape").alias("value"))
    inside = widened(spark, sf).agg(F.avg(((F.col("target") >= F.col("interval_lower")) & (F.col("target") <= F.col("interval_upper"))).cast("double")).alias("value")).select(F.lit("coverage").alias("name"), "value")
    return compared.unionByName(inside)
