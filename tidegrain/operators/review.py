"""Rules, gates, selectors and edits that come as parameters or tables, and the review of a plan by them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import DataRefused, failed, guard
from .ranking import first_rows

NEAR = 1e-9  # what is told apart in weights and shares
SETTLED = 1e-8  # violations up to here count as none


def gates(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with the metric of its name: does the value hold? A metric that is null or absent does not pass, and is noted.

    metrics: metric_name, value, n and any keys. targets: metric_name, operator (eq, gte, lte), target.
    """
    v, t = F.col("value"), F.col("target")
    holds = F.when(F.col("operator") == "eq", v == t).when(F.col("operator") == "gte", v >= t).when(F.col("operator") == "lte", v <= t)
    met = targets.join(metrics, "metric_name", "left")
    return met.withColumn("passed", F.coalesce(holds, F.lit(False))).withColumn("note", F.when(v.isNull(), "NOT_APPLICABLE"))


def selected(selectors: DataFrame, evidence: DataFrame) -> DataFrame:
    """selector_id, evidence_id: what each selector means.

    selectors: selector_id, evidence_type, entities (map of wanted values), allow_missing, path_prefix, payload_equals (map of texts),
    payload_greater (map of numbers); nulls ask for nothing. evidence: evidence_id, evidence_type, entities, source_path, payload (JSON).
    Payload values are compared as they are written; a value that is no number is not greater than any.
    """
    s = selectors.select("selector_id", *[F.col(c).alias(f"s_{c}") for c in ("evidence_type", "entities", "allow_missing", "path_prefix", "payload_equals", "payload_greater")])
    e = evidence.withColumn("values_", F.from_json("payload", "map<string,string>")).drop("payload")

    def all_of(wanted: str, holds) -> Column:
        return F.coalesce(F.forall(F.map_entries(wanted), lambda x: F.coalesce(holds(x["key"], x["value"]), F.lit(False))), F.lit(True))

    named = all_of("s_entities", lambda k, v: F.coalesce(F.col("entities")[k] == v, F.col("s_allow_missing")))
    equal = all_of("s_payload_equals", lambda k, v: F.col("values_")[k] == v)
    above = all_of("s_payload_greater", lambda k, v: F.col("values_")[k].try_cast("double") > v)
    under = F.coalesce(F.col("source_path").startswith(F.col("s_path_prefix")), F.col("s_path_prefix").isNull())
    met = e.join(s, F.col("evidence_type").eqNullSafe(F.col("s_evidence_type")))
    return met.where(named & equal & above & under).select("selector_id", "evidence_id")


def selector_report(selectors: DataFrame, matches: DataFrame) -> DataFrame:
    """selector_id, n, issue: a selector with fewer matches than ``minimum`` or more than ``maximum`` (null: no bound)."""
    n = matches.groupBy("selector_id").agg(F.count("*").alias("n"))
    rows = selectors.select("selector_id", "minimum", "maximum").join(n, "selector_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issue = F.when(F.col("n") < F.col("minimum"), "TOO_FEW").when(F.col("n") > F.col("maximum"), "AMBIGUOUS")
    return rows.select("selector_id", "n", issue.alias("issue"))


# --- edits -------------------------------------------------------------------------------------------------------------------
def scale_demand(demand: DataFrame, edits: list[dict], scope: list[str], quantity: str = "quantity") -> DataFrame:
    """Demand times the multiplier of the edit that a line falls under.

    An edit names values of some of the ``scope`` columns, a ``multiplier`` and, if wanted, ``expected_matches``. Edits that could meet
    in one line are refused, and so is one whose number of lines is not the expected one.
    """
    for a, b in combinations(edits, 2):
        if all(a.get(c) is None or b.get(c) is None or a[c] == b[c] for c in scope):
            raise DataRefused(f"OVERLAPPING_EDITS: {a} {b}")
    hits = [reduce(lambda x, c: x & (F.col(c) == F.lit(e[c])), [c for c in scope if e.get(c) is not None], F.lit(True)) for e in edits]
    counted = [i for i, e in enumerate(edits) if e.get("expected_matches") is not None]
    if counted:
        found = demand.agg(*[F.count_if(hits[i]).alias(f"n{i}") for i in counted]).first()
        for i in counted:
            if found[f"n{i}"] != edits[i]["expected_matches"]:
                raise DataRefused(f"{'ZERO_MATCH' if found[f'n{i}'] == 0 else 'CARDINALITY_MISMATCH'}: {edits[i]}, found {found[f'n{i}']}")
    times = F.coalesce(*[F.when(h, F.lit(float(e["multiplier"]))) for h, e in zip(hits, edits, strict=True)], F.lit(1.0))
    return demand.withColumn(quantity, F.col(quantity) * times)


def patch_one_each(df: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the non-null values of its patch in each row; a patch must meet exactly one row, and a row at most one patch."""
    columns = [c for c in patches.columns if c not in keys]
    guard(patches.groupBy(*keys).agg(F.count("*").alias("n_patches")).where("n_patches > 1"), "CONFLICTING_CHANGES")
    found = df.join(patches.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n_rows"))
    guard(patches.select(*keys).join(found, keys, "left").where("n_rows IS NULL OR n_rows > 1"), "PATCH_NEEDS_ONE_MATCH")
    new = patches.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    return df.join(new, keys, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- rules and review --------------------------------------------------------------------------------------------------------
def rule_observations(rules: DataFrame, ledger: DataFrame, orders: DataFrame | None = None, coefficients: DataFrame | None = None) -> DataFrame:
    """rule_id, identity, observed, violation, weight: what each rule sees, by its semantics.

    RECEIVING_PEAK, GLOBAL_RECEIVING_PEAK (in liters), END_OF_DAY_MIN and END_OF_DAY_MAX see every world and day; PER_KEY_EXPECTED_FILL
    every key, over all worlds (which hold the same keys); PURCHASE_COVER_DAYS every day of arrival, MIN_REMAINING_LIFE_AT_RECEIVING
    every offer. A purchase bound on a demand of zero has no cover days: its violation is the quantity.
    rules: rule_id, store_key, ingredient_id (null: all), semantics, target, effective_from, effective_to (null: open), reference_daily.
    ledger: scenario_id, weight, store_key, ingredient_id, date, demand, shortage, maximum, ending.
    orders: store_key, ingredient_id, offer_id, arrival_date, quantity, shelf_life_days. coefficients: ingredient_id, liters.
    """
    r = rules.select("rule_id", "semantics", "target", "effective_from", "effective_to", "reference_daily", "store_key", F.col("ingredient_id").alias("only_"))
    mine = F.col("only_").isNull() | (F.col("only_") == F.col("ingredient_id"))
    active = lambda day: F.coalesce(F.col(day) >= F.col("effective_from"), F.lit(True)) & F.coalesce(F.col(day) <= F.col("effective_to"), F.lit(True))
    kind, target = F.col("semantics"), F.col("target")
    over, short = F.greatest(F.lit(0.0), F.col("observed") - target), F.greatest(F.lit(0.0), target - F.col("observed"))
    out = ["rule_id", "identity", "observed", "violation", "weight"]

    seen = ledger.join(r, "store_key").where(mine)
    days = seen.where(active("date") & kind.isin("RECEIVING_PEAK", "GLOBAL_RECEIVING_PEAK", "END_OF_DAY_MIN", "END_OF_DAY_MAX"))
    if coefficients is not None:
        days = days.join(coefficients.select("ingredient_id", "liters"), "ingredient_id", "left")
        guard(days.where((kind == "GLOBAL_RECEIVING_PEAK") & F.col("liters").isNull()).select("rule_id", "ingredient_id"), "OCCUPANCY_COVERAGE")
    else:
        guard(r.where(kind == "GLOBAL_RECEIVING_PEAK").select("rule_id"), "OCCUPANCY_COVERAGE")
        days = days.withColumn("liters", F.lit(None).cast("double"))
    amount = F.when(kind == "GLOBAL_RECEIVING_PEAK", F.col("maximum") * F.col("liters")).when(kind == "RECEIVING_PEAK", F.col("maximum")).otherwise(F.col("ending"))
    by_day = days.groupBy("rule_id", "semantics", "target", "scenario_id", "weight", "date").agg(F.sum(amount).alias("observed"))
    by_day = by_day.withColumn("violation", F.when(kind == "END_OF_DAY_MIN", short).otherwise(over)).withColumn("identity", F.concat_ws("|", "scenario_id", "date"))

    sums = seen.where(kind == "PER_KEY_EXPECTED_FILL").groupBy("rule_id", "target", "store_key", "ingredient_id", "scenario_id", "weight")
    sums = sums.agg(F.sum(F.when(active("date"), F.col("demand")).otherwise(0.0)).alias("d"), F.sum(F.when(active("date"), F.col("shortage")).otherwise(0.0)).alias("s"))
    fill = F.col("weight") * F.when(F.col("d") == 0, 1.0).otherwise(1 - F.try_divide(F.col("s"), F.col("d")))
    by_key = sums.groupBy("rule_id", "target", "store_key", "ingredient_id").agg(F.sum(fill).alias("observed"))
    by_key = by_key.withColumn("violation", short).withColumn("identity", F.concat_ws("|", "store_key", "ingredient_id")).withColumn("weight", F.lit(1.0))
    rows = by_day.select(*out).unionByName(by_key.select(*out))
    if orders is None:
        return rows

    bought = orders.join(r, "store_key").where((F.col("only_") == F.col("ingredient_id")) & active("arrival_date"))
    cover = bought.where(kind == "PURCHASE_COVER_DAYS").groupBy("rule_id", "target", "reference_daily", "arrival_date").agg(F.sum("quantity").alias("q"))
    cover = cover.withColumn("observed", F.try_divide(F.col("q"), F.col("reference_daily"))).withColumn("violation", F.when(F.col("reference_daily") == 0, F.col("q")).otherwise(over))
    life = bought.where(kind == "MIN_REMAINING_LIFE_AT_RECEIVING").groupBy("rule_id", "target", "offer_id").agg(F.min(F.coalesce(F.col("shelf_life_days").cast("double"), F.lit(-1.0))).alias("observed"))
    cover, life = cover.withColumn("identity", F.col("arrival_date").cast("string")), life.withColumn("identity", F.col("offer_id").cast("string")).withColumn("violation", short)
    return rows.unionByName(cover.withColumn("weight", F.lit(1.0)).select(*out)).unionByName(life.withColumn("weight", F.lit(1.0)).select(*out))


def evaluate_rules(rules: DataFrame, observations: DataFrame, worst: int = 10) -> DataFrame:
    """Per rule: status (PASS; a broken HARD rule FAIL, another TARGET_MISS), greatest and weighted violation, penalty, worst identities.

    A rule that sees nothing passes. Ties among the worst go by identity.
    """
    per = observations.groupBy("rule_id").agg(F.max("violation").alias("maximum_violation"), F.sum(F.col("weight") * F.col("violation")).alias("weighted_violation"), F.max("observed").alias("maximum_observed"), F.count("*").alias("n"))
    first = first_rows(observations, ["rule_id"], [F.desc("violation"), "identity"], worst).groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("violation")).alias("v"), "identity"))).alias("w_"))
    rows = rules.select("rule_id", "classification", "penalty").join(per, "rule_id", "left").join(first, "rule_id", "left").fillna(0, ["maximum_violation", "weighted_violation", "n"])
    status = F.when(F.col("maximum_violation") <= SETTLED, "PASS").when(F.col("classification") == "HARD", "FAIL").otherwise("TARGET_MISS")
    worst_ids = F.coalesce(F.col("w_")["identity"], F.array().cast("array<string>"))
    return rows.select("rule_id", "classification", status.alias("status"), "maximum_violation", "weighted_violation", "maximum_observed", "n", (F.col("weighted_violation") * F.coalesce("penalty", F.lit(0.0))).alias("penalty"), worst_ids.alias("worst"))


def critique(summary: DataFrame, worlds: DataFrame, profile: dict, by: list[str], key: str) -> DataFrame:
    """One row per plan and hard violation: the columns ``by`` and ``issue``. What the profile does not name is not asked for.

    summary: by, key, scenario_id, weight, fill_rate, shortage, capacity_violation (null: none), accounting_valid, a row per key and world.
    worlds: scenario_id, weight, as planned; each plan must have been run in exactly these.
    profile: minimum_acceptable_fill_rate, maximum_acceptable_stockout_probability, minimum_expected_fill_rate, minimum_fill_rate with
    required_fill_rate_probability, maximum_stockout_probability.
    """
    w, fill = F.col("weight"), F.col("fill_rate")
    world = summary.groupBy(*by, "scenario_id", "weight").agg(F.max("shortage").alias("short_"), F.min("fill_rate").alias("fill_"), F.max(F.coalesce("capacity_violation", F.lit(0.0))).alias("cap_"), F.bool_and("accounting_valid").alias("books_"))
    expected = worlds.select("scenario_id", F.col("weight").alias("planned_"))
    same = F.coalesce(F.abs(w - F.col("planned_")) <= NEAR, F.lit(False))
    per = world.join(expected, "scenario_id", "left").groupBy(*by).agg(
        F.min("fill_").alias("least_fill"), F.sum(w * (F.col("short_") > NEAR).cast("int")).alias("p_stockout"), F.max("cap_").alias("capacity"), F.bool_and("books_").alias("books"), F.count("*").alias("n"), F.count_if(same).alias("n_same")
    )
    enough = fill + NEAR >= F.lit(profile.get("minimum_fill_rate"))
    keys = summary.groupBy(*by, key).agg(F.sum(w * fill).alias("e"), F.sum(w * enough.cast("int")).alias("p")).groupBy(*by).agg(F.min("e").alias("expected_fill"), F.min("p").alias("p_fill"))
    rows = per.join(keys, by).crossJoin(F.broadcast(worlds.agg(F.count("*").alias("n_worlds"))))  # one row
    below = lambda c, name: F.coalesce(F.col(c) + NEAR < F.lit(profile.get(name)), F.lit(False))
    above = lambda c, name: F.coalesce(F.col(c) > F.lit(profile.get(name)) + NEAR, F.lit(False))
    rules = {
        "ACCOUNTING_INVALID": ~F.col("books"),
        "CAPACITY_CONSEQUENCE": F.col("capacity") > NEAR,
        "EVALUATION_SCENARIO_COVERAGE_MISMATCH": (F.col("n") != F.col("n_same")) | (F.col("n") != F.col("n_worlds")),
        "EXACT_SIMULATION_SAFETY_FLOOR": below("least_fill", "minimum_acceptable_fill_rate") | above("p_stockout", "maximum_acceptable_stockout_probability"),
        "RISK_CONSTRAINT_VIOLATION": above("p_stockout", "maximum_stockout_probability"),
        "SERVICE_LEVEL_REQUIREMENT": below("expected_fill", "minimum_expected_fill_rate") | below("p_fill", "required_fill_rate_probability"),
    }
    return rows.select(*by, F.explode(failed(rules)).alias("issue"))


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables holds, each once, with the side that lacks them."""
    a, b = left.select(*keys).distinct().withColumn("l_", F.lit(1)), right.select(*keys).distinct().withColumn("r_", F.lit(1))
    return a.join(b, keys, "full").where("l_ IS NULL OR r_ IS NULL").select(*keys, F.when(F.col("l_").isNull(), "left").otherwise("right").alias("missing"))


def world_key_gaps(df: DataFrame, world: str, keys: list[str]) -> DataFrame:
    """Keys that some world lacks, with the number of worlds that hold them."""
    per = df.select(world, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n_worlds"))
    total = F.broadcast(df.agg(F.countDistinct(world).alias("all_")))  # one row
    return per.crossJoin(total).where("n_worlds < all_").drop("all_")
