"""Queries on rules, edits and the review of plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.operators import coherence as C
from tidegrain.operators import critic as CR
from tidegrain.operators import inventory as I
from tidegrain.operators import review as W
from tidegrain.operators import rule_mapping as RM
from tidegrain.operators.checks import union_all
from tidegrain.sources.keep import keep

from .inputs import sales
from .registry import part, query
from .stock_queries import KEY, ONE, STRESSES, WORLDS, flow, needs, simulated, simulated_sql, summaries

EDITS = [{"store_key": "S1", "product_key": "PROMO", "multiplier": 1.2}, {"store_key": "S2", "multiplier": 0.5}]


@query("demand_edits", "sales", "SELECT store_key, product_key, round(sum(quantity_sold * CASE WHEN store_key = 'S1' AND product_key = 'PROMO' THEN 1.2 WHEN store_key = 'S2' THEN 0.5 ELSE 1.0 END), 4) AS quantity FROM sales GROUP BY 1, 2")
def demand_edits(spark, sf):
    scaled = W.scale_demand(sales(spark, sf), EDITS, ["store_key", "product_key", "date"], "quantity_sold")
    return scaled.groupBy("store_key", "product_key").agg(F.round(F.sum("quantity_sold"), 4).alias("quantity"))


def store_rules(spark, sf):
    """Three rules for each store: a peak, a least end of day from 1997 on, and an expected fill."""
    one = lambda kind, grade, target, start: F.struct(F.lit(kind).alias("semantics"), F.lit(grade).alias("classification"), F.lit(target).alias("target"), F.lit(start).cast("date").alias("effective_from"))
    kinds = F.array(one("RECEIVING_PEAK", "HARD", 900.0, None), one("END_OF_DAY_MIN", "SOFT", 20.0, "1997-01-01"), one("PER_KEY_EXPECTED_FILL", "SOFT", 0.75, None))
    rows = flow(spark, sf).select("store_key").distinct().select("store_key", F.inline(kinds))
    return rows.select("*", F.concat_ws(":", "semantics", "store_key").alias("rule_id"), F.lit(None).cast("string").alias("ingredient_id"), F.lit(None).cast("date").alias("effective_to"), F.lit(None).cast("double").alias("reference_daily"), F.lit(2.0).alias("penalty"))


@query(
    "business_rules",
    "flow",
    """SELECT rule_id, CASE WHEN max(v) <= 1e-8 THEN 'PASS' WHEN rule_id LIKE 'RECEIVING%' THEN 'FAIL' ELSE 'TARGET_MISS' END AS status, round(max(v), 4) AS worst, round(sum(v), 4) AS weighted, count(*) AS n FROM (
  SELECT 'RECEIVING_PEAK:' || store_key AS rule_id, greatest(0, sum(demand) - 900) AS v FROM flow GROUP BY store_key, date
  UNION ALL SELECT 'END_OF_DAY_MIN:' || store_key, greatest(0, 20 - sum(fulfilled)) FROM flow WHERE date >= DATE '1997-01-01' GROUP BY store_key, date
  UNION ALL SELECT 'PER_KEY_EXPECTED_FILL:' || store_key, greatest(0, 0.75 - CASE WHEN sum(demand) = 0 THEN 1 ELSE 1 - sum(demand - fulfilled) / sum(demand) END) FROM flow GROUP BY store_key, ingredient_id) GROUP BY 1""",
)
def business_rules(spark, sf):
    """Rules of each store over the daily lines of its sales, as one world."""
    rules = store_rules(spark, sf)
    ledger = flow(spark, sf).select(*KEY, "date", "demand", "shortage", F.col("demand").alias("maximum"), F.col("fulfilled").alias("ending"), F.lit("sold").alias("scenario_id"), F.lit(1.0).alias("weight"))
    r = W.evaluate_rules(rules, W.rule_observations(rules, ledger))
    return r.select("rule_id", "status", F.round("maximum_violation", 4).alias("worst"), F.round("weighted_violation", 4).alias("weighted"), "n")


PROFILE = {"minimum_acceptable_fill_rate": 0.72, "maximum_stockout_probability": 0.5, "minimum_expected_fill_rate": 0.73, "minimum_fill_rate": 0.7, "required_fill_rate_probability": 0.8}

part("key_years", "SELECT store_key, ingredient_id, year(date) AS y, CASE WHEN sum(demand) = 0 THEN 1 ELSE sum(fulfilled) / sum(demand) END AS fill, sum(demand - fulfilled) AS shortage, 1.0::DOUBLE / (SELECT count(DISTINCT year(date)) FROM flow) AS w FROM @flow GROUP BY 1, 2, 3")


def key_years(spark, sf):
    """A summary line of each key and year, years as worlds of equal weight; and these worlds."""
    fill = F.when(F.sum("demand") == 0, 1.0).otherwise(F.try_divide(F.sum("fulfilled"), F.sum("demand")))
    per = flow(spark, sf).groupBy(*KEY, F.year("date").alias("scenario_id")).agg(fill.alias("fill_rate"), F.sum("shortage").alias("shortage"))
    years = per.select("scenario_id").distinct()
    worlds = years.crossJoin(F.broadcast(years.agg((1 / F.count("*")).alias("weight"))))  # one row
    return per.join(worlds, "scenario_id").withColumn("capacity_violation", F.lit(None).cast("double")).withColumn("accounting_valid", F.lit(True)), worlds


@query(
    "plan_review",
    "key_years",
    """, worlds AS (SELECT store_key, y, w, max(shortage) AS s, min(fill) AS f FROM key_years GROUP BY 1, 2, 3),
per AS (SELECT store_key, min(f) AS f, sum(w * (s > 1e-9)::INT) AS p, count(*) AS n FROM worlds GROUP BY 1),
keys AS (SELECT store_key, min(e) AS e, min(p) AS p FROM (SELECT store_key, ingredient_id, sum(w * fill) AS e, sum(w * (fill + 1e-9 >= 0.7)::INT) AS p FROM key_years GROUP BY 1, 2) GROUP BY 1)
SELECT store_key, 'EVALUATION_SCENARIO_COVERAGE_MISMATCH' AS issue FROM per WHERE n <> (SELECT count(DISTINCT y) FROM key_years)
UNION ALL SELECT store_key, 'EXACT_SIMULATION_SAFETY_FLOOR' FROM per WHERE f + 1e-9 < 0.72
UNION ALL SELECT store_key, 'RISK_CONSTRAINT_VIOLATION' FROM per WHERE p > 0.5 + 1e-9
UNION ALL SELECT store_key, 'SERVICE_LEVEL_REQUIREMENT' FROM keys WHERE e + 1e-9 < 0.73 OR p + 1e-9 < 0.8""",
)
def plan_review(spark, sf):
    summary, worlds = key_years(spark, sf)
    return W.critique(summary, worlds, PROFILE, ["store_key"], "ingredient_id")


@query("world_key_gaps", "key_years", "SELECT store_key, ingredient_id, count(*) AS n_worlds FROM key_years GROUP BY 1, 2 HAVING count(*) < (SELECT count(DISTINCT y) FROM key_years)")
def world_key_gaps(spark, sf):
    return W.world_key_gaps(key_years(spark, sf)[0], "scenario_id", KEY)


# Artifacts with planted faults: demand of two scenarios, and lines that ought to follow from it.
part("artifact_demand", "SELECT s AS scenario_id, store_key, ingredient_id, date, quantity * (1 + s * 0.25::DOUBLE) AS quantity FROM (SELECT store_key, ingredient_id, date, sum(quantity) AS quantity FROM @needs GROUP BY 1, 2, 3) CROSS JOIN (SELECT unnest([0, 1]) AS s)")
part("artifact_window", "SELECT min(date) - 1 AS forecast_date, min(date) AS first_day, max(date) AS last_day, 'v1' AS version FROM @needs")
part(
    "artifact_lines",
    """SELECT scenario_id, store_key, ingredient_id, CASE WHEN store_key = 'S4' AND d % 120 = 0 THEN date + 4000 ELSE date END AS date, quantity * CASE WHEN store_key = 'S2' AND d % 50 = 0 THEN 1.01 ELSE 1 END AS quantity, CASE WHEN scenario_id = 1 AND ingredient_id = 'Brand#2' THEN NULL ELSE 0.5 END AS weight,
  (date - forecast_date) + CASE WHEN store_key = 'S3' AND d % 80 = 0 THEN 1 WHEN store_key = 'S4' AND d % 120 = 0 THEN 4000 ELSE 0 END AS horizon, CASE WHEN ingredient_id = 'Brand#7' AND d % 90 = 0 THEN 'v0' ELSE 'v1' END AS version
  FROM (SELECT *, dayofyear(date) AS d FROM @artifact_demand) CROSS JOIN @artifact_window CROSS JOIN (SELECT unnest([0, 1]) AS again) WHERE (again = 0 OR (store_key = 'S0' AND d % 100 = 0)) AND NOT (scenario_id = 1 AND store_key = 'S1' AND d % 61 = 0)""",
)
LINE_KEY = ["scenario_id", *KEY, "date"]
LINE_JSON = "json_object('scenario_id', {0}scenario_id, 'store_key', {0}store_key, 'ingredient_id', {0}ingredient_id, 'date', {0}date::VARCHAR)::VARCHAR"
RELATIONS = [
    C.Pair("demand", "lines", LINE_KEY, [C.only_left("LINE_MISSING"), C.only_right("LINE_UNKNOWN"), C.differs("QUANTITY_LINEAGE_MISMATCH", "quantity", tolerance=1e-9)]),
    C.Pair("lines", "window", [], [C.outside("DATE_OUTSIDE_WINDOW", "date", "first_day", "last_day"), C.holds("HORIZON_MISMATCH", lambda a, b: a("horizon") == F.datediff(a("date"), b("forecast_date"))), C.differs("MODEL_VERSION_MISMATCH", "version", severity="WARNING", blocking=False)]),
    C.Pair("weights", "worlds", ["scenario_id"], [C.only_left("SCENARIO_UNKNOWN"), C.only_right("SCENARIO_WITHOUT_LINES"), C.differs("WEIGHT_MISMATCH", "weight", tolerance=1e-9)]),
]


def artifacts(spark, sf):
    base = keep(needs(spark, sf).groupBy(*KEY, "date").agg(F.sum("quantity").alias("quantity")))
    demand = base.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("scenario_id"), *KEY, "date", "quantity").withColumn("quantity", F.col("quantity") * (1 + F.col("scenario_id") * 0.25))
    window = base.agg(F.date_sub(F.min("date"), 1).alias("forecast_date"), F.min("date").alias("first_day"), F.max("date").alias("last_day")).withColumn("version", F.lit("v1"))
    d, at = F.dayofyear("date"), lambda s, n: (F.col("store_key") == s) & (F.dayofyear("date") % n == 0)
    away = F.when(at("S4", 120), 4000).otherwise(0)
    x = demand.join(F.broadcast(window.select("forecast_date")), F.lit(True)).where(~((F.col("scenario_id") == 1) & at("S1", 61)))  # one row
    x = x.withColumn("again", F.explode(F.when(at("S0", 100), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    lines = x.select(
        "scenario_id", *KEY, F.date_add("date", away).alias("date"), (F.col("quantity") * F.when(at("S2", 50), 1.01).otherwise(1.0)).alias("quantity"), F.when(~((F.col("scenario_id") == 1) & (F.col("ingredient_id") == "Brand#2")), 0.5).alias("weight"),
        (F.datediff("date", "forecast_date") + F.when(at("S3", 80), 1).otherwise(away)).alias("horizon"), F.when((F.col("ingredient_id") == "Brand#7") & (d % 90 == 0), "v0").otherwise("v1").alias("version"),
    )
    worlds = spark.range(3).select(F.col("id").cast("int").alias("scenario_id"), (F.lit(0.6) - F.col("id") * 0.2).alias("weight"))
    lines = keep(lines)
    weights = lines.groupBy("scenario_id").agg(F.max("weight").alias("weight"))
    return {"demand": demand, "lines": lines, "window": keep(window), "worlds": worlds, "weights": weights}


@query(
    "artifact_coherence",
    "artifact_demand artifact_lines artifact_window",
    f""", j AS (SELECT d.scenario_id IS NOT NULL AS a, l.scenario_id IS NOT NULL AS b, d.quantity AS x, l.quantity AS y, {LINE_JSON.format("d.")} AS dk, {LINE_JSON.format("l.")} AS lk FROM artifact_demand d FULL JOIN artifact_lines l ON d.scenario_id = l.scenario_id AND d.store_key = l.store_key AND d.ingredient_id = l.ingredient_id AND d.date = l.date),
w AS (SELECT l.*, f.forecast_date, f.first_day, f.last_day FROM artifact_lines l CROSS JOIN artifact_window f),
worlds(scenario_id, weight) AS (VALUES (0, 0.6::DOUBLE), (1, 0.4::DOUBLE), (2, 0.2::DOUBLE)), weights AS (SELECT scenario_id, max(weight) AS weight FROM artifact_lines GROUP BY 1)
SELECT code, n, severity, blocking FROM (
  SELECT 'LINE_MISSING' AS code, count(*) AS n, 'ERROR' AS severity, true AS blocking FROM j WHERE a AND NOT b
  UNION ALL SELECT 'LINE_UNKNOWN', count(*), 'ERROR', true FROM j WHERE b AND NOT a
  UNION ALL SELECT 'QUANTITY_LINEAGE_MISMATCH', count(*), 'ERROR', true FROM j WHERE a AND b AND abs(x - y) > 1e-9 * greatest(1, abs(x), abs(y))
  UNION ALL SELECT 'DATE_OUTSIDE_WINDOW', count(*), 'ERROR', true FROM w WHERE NOT date BETWEEN first_day AND last_day
  UNION ALL SELECT 'HORIZON_MISMATCH', count(*), 'ERROR', true FROM w WHERE horizon <> date - forecast_date
  UNION ALL SELECT 'MODEL_VERSION_MISMATCH', count(*), 'WARNING', false FROM w WHERE version <> 'v1'
  UNION ALL SELECT 'SCENARIO_WITHOUT_LINES', count(*), 'ERROR', true FROM worlds WHERE scenario_id NOT IN (SELECT scenario_id FROM weights)
  UNION ALL SELECT 'WEIGHT_MISMATCH', count(*), 'ERROR', true FROM worlds v JOIN weights u ON u.scenario_id = v.scenario_id WHERE abs(u.weight - v.weight) > 1e-9
  UNION ALL SELECT 'DUPLICATE_LINE', count(*), 'ERROR', true FROM (SELECT 1 FROM artifact_lines GROUP BY scenario_id, store_key, ingredient_id, date HAVING count(*) > 1)
  UNION ALL SELECT 'WEIGHTS_NOT_ONE', count(*), 'ERROR', true FROM (SELECT 1 FROM worlds HAVING abs(sum(weight) - 1) > 1e-6)) WHERE n > 0""",
)
def artifact_coherence(spark, sf):
    """Issues by code of artifacts with planted faults."""
    made = artifacts(spark, sf)
    issues = union_all([C.check_pairs(made, RELATIONS), C.repeated(made["lines"], "lines", LINE_KEY, "DUPLICATE_LINE"), C.wrong_total(made["worlds"], "worlds", [], "weight", 1.0, "WEIGHTS_NOT_ONE")])
    return C.report(issues).select("code", "n", "severity", "blocking")


@query("lineage_gaps", "artifact_demand artifact_lines", f"SELECT {LINE_JSON.format('d.')} AS key FROM artifact_demand d WHERE NOT EXISTS (SELECT 1 FROM artifact_lines l WHERE d.scenario_id = l.scenario_id AND d.store_key = l.store_key AND d.ingredient_id = l.ingredient_id AND d.date = l.date)")
def lineage_gaps(spark, sf):
    """Keys of the demand that no line follows from."""
    return C.check_pairs(artifacts(spark, sf), RELATIONS[:1]).where("code = 'LINE_MISSING'").select("key")


# A claimed ledger that parts from the run: amounts, a missing day, a day too much.
CLAIMS = ("fulfilled", "expired", "ending")


@query(
    "ledger_divergence",
    "lots pairs",
    simulated_sql(
        ONE,
        """, claimed AS (SELECT store_key, ingredient_id, CASE WHEN store_key = 'S4' AND day(date) = 31 AND year(date) > 1999 THEN date + 10000 ELSE date END AS date, fulfilled * CASE WHEN store_key = 'S1' AND date >= DATE '1997-03-01' THEN 1.5 ELSE 1 END AS fulfilled, expired + CASE WHEN store_key = 'S2' AND month(date) = 7 THEN 1 ELSE 0 END AS expired, ending FROM lines
  WHERE NOT (store_key = 'S3' AND ingredient_id = 'Brand#3' AND dayofyear(date) = 200)),
j AS (SELECT coalesce(c.store_key, l.store_key) AS store_key, coalesce(c.ingredient_id, l.ingredient_id) AS ingredient_id, coalesce(c.date, l.date) AS date, concat_ws(',', CASE WHEN c.store_key IS NULL THEN 'NOT_CLAIMED' END, CASE WHEN l.store_key IS NULL THEN 'NOT_FOUND' END,
  CASE WHEN abs(c.fulfilled - l.fulfilled) > 1e-6 * greatest(1, abs(c.fulfilled), abs(l.fulfilled)) THEN 'fulfilled' END, CASE WHEN abs(c.expired - l.expired) > 1e-6 * greatest(1, abs(c.expired), abs(l.expired)) THEN 'expired' END) AS differs FROM claimed c FULL JOIN lines l ON c.store_key = l.store_key AND c.ingredient_id = l.ingredient_id AND c.date = l.date)
SELECT store_key, ingredient_id, min(date) AS date, min_by(differs, date) AS differs, count(*) AS n FROM j WHERE differs <> '' GROUP BY 1, 2""",
    ),
)
def ledger_divergence(spark, sf):
    """Where a claimed ledger first parts from the run, by key."""
    exact = keep(simulated(spark, sf, ONE).select(*KEY, "date", *CLAIMS))
    day = F.col("date")
    claimed = exact.where(~((F.col("store_key") == "S3") & (F.col("ingredient_id") == "Brand#3") & (F.dayofyear(day) == 200)))
    claimed = claimed.withColumn("fulfilled", F.col("fulfilled") * F.when((F.col("store_key") == "S1") & (day >= F.lit("1997-03-01").cast("date")), 1.5).otherwise(1.0)).withColumn("expired", F.col("expired") + F.when((F.col("store_key") == "S2") & (F.month(day) == 7), 1.0).otherwise(0.0))
    claimed = claimed.withColumn("date", F.when((F.col("store_key") == "S4") & (F.dayofmonth(day) == 31) & (F.year(day) > 1999), F.date_add(day, 10000)).otherwise(day))
    return CR.first_divergence(claimed, exact, KEY, ["date"], list(CLAIMS)).select(*KEY, "date", F.array_join("differs", ",").alias("differs"), "n")


@query("model_gaps", "lots pairs", simulated_sql(WORLDS, "SELECT store_key, ingredient_id, round(max(CASE WHEN run = '2' THEN fill_rate END) - avg(fill_rate), 6) AS fill_gap, round(avg((shortage > 1e-9)::INT) - max(CASE WHEN run = '2' THEN (shortage > 1e-9)::INT END), 6) AS stockout_gap FROM sums GROUP BY 1, 2 HAVING max(CASE WHEN run = '2' THEN fill_rate END) - avg(fill_rate) > 0.01 + 1e-9 OR avg((shortage > 1e-9)::INT) - max(CASE WHEN run = '2' THEN (shortage > 1e-9)::INT END) > 0.05 + 1e-9"))
def model_gaps(spark, sf):
    """Keys whose median world alone is more hopeful than the run of all worlds."""
    sums = keep(summaries(spark, sf, WORLDS).withColumn("weight", F.lit(0.2)))
    exact, predicted = I.risk(sums, KEY), I.risk(sums.where("run = '2'"), KEY)
    return CR.model_gaps(predicted, exact, KEY, 0.01, 0.05).select(*KEY, F.round("fill_gap", 6).alias("fill_gap"), F.round("stockout_gap", 6).alias("stockout_gap"))


@query("stress_review", "lots pairs", simulated_sql(STRESSES, "SELECT run, store_key, 'STRESS_SHORTAGE_OBSERVED' AS issue FROM sums GROUP BY 1, 2 HAVING max(shortage) > 0"))
def stress_review(spark, sf):
    sums = summaries(spark, sf, STRESSES).withColumn("capacity_violation", F.lit(None).cast("double")).withColumn("accounting_valid", F.lit(True))
    return CR.stress_issues(sums, ["run", "store_key"])


# Source rules of every store and brand, read by a mapping that lacks one kind, misreads another and has one too many.
part(
    "source_rules",
    """SELECT store_key || ':' || ingredient_id || ':' || t AS rule_id, store_key AS store_id, ingredient_id, t AS rule_type, v * (1 + length(ingredient_id)) AS value, u AS unit FROM (SELECT DISTINCT store_key, ingredient_id FROM @needs)
  CROSS JOIN (VALUES ('maximum_stock', 900.0::DOUBLE, 'kg'), ('safety_stock', 20000.0, 'g'), ('service_level_target', 0.1, 'ratio'), ('shelf_life_target', 2.0, 'day'), ('unheard_of', 1.0, 'kg')) k(t, v, u)""",
)
BASES = ("kg", "liter", "kg")


def rule_inputs(spark, sf):
    keys = needs(spark, sf).select(F.col("store_key").alias("store_id"), "ingredient_id").distinct()
    kinds = [("maximum_stock", 900.0, "kg"), ("safety_stock", 20000.0, "g"), ("service_level_target", 0.1, "ratio"), ("shelf_life_target", 2.0, "day"), ("unheard_of", 1.0, "kg")]
    rows = keys.select("*", F.inline(F.array(*[F.struct(F.lit(t).alias("rule_type"), F.lit(v).alias("v"), F.lit(u).alias("unit")) for t, v, u in kinds])))
    none = F.lit(None).cast("date")
    source = rows.select(F.concat_ws(":", "store_id", "ingredient_id", "rule_type").alias("rule_id"), "store_id", "ingredient_id", "rule_type", (F.col("v") * (1 + F.length("ingredient_id"))).alias("value"), "unit", none.alias("effective_from"), none.alias("effective_to"))
    wanted = [("maximum_stock", "END_OF_DAY_MAX", "kg"), ("safety_stock", "END_OF_DAY_MIN", "g"), ("service_level_target", "PER_KEY_EXPECTED_FILL", "percent"), ("shelf_life_target", "PURCHASE_COVER_DAYS", "day")]
    brands = keys.select("ingredient_id").distinct()
    mapping = brands.select("ingredient_id", F.inline(F.array(*[F.struct(F.lit(t).alias("rule_type"), F.lit(s).alias("semantics"), F.lit(u).alias("unit")) for t, s, u in wanted]))).withColumn("classification", F.lit("HARD")).withColumn("penalty", F.lit(1.0))
    extra = mapping.limit(1).select(F.lit("Brand#none").alias("ingredient_id"), *[c for c in mapping.columns if c != "ingredient_id"]).withColumn("rule_type", F.lit("maximum_stock"))
    number = F.regexp_extract("ingredient_id", r"(\d+)", 1).cast("int") % 3
    units = keys.select("store_id", "ingredient_id", F.element_at(F.array(*map(F.lit, BASES)), (number + 1).cast("int")).alias("base_unit"))
    factors = spark.createDataFrame([("g", "kg", 0.001)], "from_unit string, to_unit string, factor double")
    daily = needs(spark, sf).groupBy(F.col("store_key").alias("store_id"), "ingredient_id").agg(F.avg("quantity").alias("quantity"))
    return source, mapping.unionByName(extra), units, factors, daily


RULES_SQL = """, r AS (SELECT *, ['kg', 'liter', 'kg'][regexp_extract(ingredient_id, '(\\d+)', 1)::INT % 3 + 1] AS base FROM source_rules),
n AS (SELECT *, CASE WHEN unit IN ('day', 'ratio') OR unit = base THEN 1.0::DOUBLE WHEN unit = 'g' AND base = 'kg' THEN 0.001::DOUBLE END AS f FROM r)
"""


@query("normalised_rules", "source_rules needs", RULES_SQL + "SELECT rule_id, CASE rule_type WHEN 'maximum_stock' THEN 'END_OF_DAY_MAX' WHEN 'safety_stock' THEN 'END_OF_DAY_MIN' ELSE 'PURCHASE_COVER_DAYS' END AS semantics, round(value * f, 6) AS target, CASE WHEN unit = 'day' THEN unit ELSE base END AS unit, CASE WHEN rule_type = 'shelf_life_target' THEN round(d.q, 5) END AS reference_daily FROM n LEFT JOIN (SELECT store_key, ingredient_id AS i, avg(quantity) AS q FROM needs GROUP BY 1, 2) d ON store_key = store_id AND i = ingredient_id WHERE rule_type IN ('maximum_stock', 'safety_stock', 'shelf_life_target') AND f IS NOT NULL")
def normalised_rules(spark, sf):
    rows, _ = RM.normalise_rules(*rule_inputs(spark, sf))
    return rows.select("rule_id", "semantics", F.round("target", 6).alias("target"), "unit", F.round("reference_daily", 5).alias("reference_daily"))


@query("refused_rules", "source_rules", RULES_SQL + "SELECT rule_id, CASE rule_type WHEN 'unheard_of' THEN 'PREVIEW_UNMAPPED_SOURCE_RULE' WHEN 'service_level_target' THEN 'RULE_TYPE_SEMANTICS_OR_UNIT_MISMATCH' ELSE 'RULE_TARGET_UNIT_REQUIRED' END AS issue FROM n WHERE rule_type IN ('unheard_of', 'service_level_target') OR f IS NULL UNION ALL SELECT 'maximum_stock:Brand#none', 'UNUSED_RULE_MAPPING'")
def refused_rules(spark, sf):
    return RM.normalise_rules(*rule_inputs(spark, sf))[1]


@query("line_key_gaps", "artifact_lines", "SELECT store_key, ingredient_id, date, count(DISTINCT scenario_id) AS n_worlds FROM artifact_lines GROUP BY 1, 2, 3 HAVING count(DISTINCT scenario_id) < 2")
def line_key_gaps(spark, sf):
    """Keys that a scenario of the lines with planted faults lacks."""
    return W.world_key_gaps(artifacts(spark, sf)["lines"], "scenario_id", [*KEY, "date"])
