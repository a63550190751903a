"""Business rules of a source table turned into rules of known semantics and units by an explicit mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import failed

# Semantics that a source rule of a type may be read as: fixed values.
ALLOWED = {
    "maximum_stock": ("RECEIVING_PEAK", "END_OF_DAY_MAX"),
    "storage_capacity": ("GLOBAL_RECEIVING_PEAK",),
    "safety_stock": ("END_OF_DAY_MIN",),
    "service_level_target": ("PER_KEY_EXPECTED_FILL",),
    "shelf_life_target": ("PURCHASE_COVER_DAYS", "MIN_REMAINING_LIFE_AT_RECEIVING"),
}
UNMAPPED, MISMATCH, UNIT_REQUIRED, UNUSED = "PREVIEW_UNMAPPED_SOURCE_RULE", "RULE_TYPE_SEMANTICS_OR_UNIT_MISMATCH", "RULE_TARGET_UNIT_REQUIRED", "UNUSED_RULE_MAPPING"
NO_UNIT = ("day", "ratio")


def normalise_rules(source: DataFrame, mapping: DataFrame, units: DataFrame, factors: DataFrame, daily: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules, and what is refused (rule_id or the unused mapping, issue).

    source: rule_id, store_id, rule_type, ingredient_id (null: of the store), value, unit, effective_from, effective_to.
    mapping: rule_type, ingredient_id, semantics, unit, classification, penalty; one row a rule type and ingredient.
    units: store_id, ingredient_id, base_unit. factors: from_unit, to_unit, factor (a unit into itself need not be listed).
    daily: store_id, ingredient_id, quantity: what covers are counted in.
    """
    m = mapping.select(F.col("rule_type").alias("t_"), F.col("ingredient_id").alias("i_"), F.col("semantics"), F.col("unit").alias("mapped_unit"), "classification", "penalty", F.lit(True).alias("mapped_"))
    met = source.join(F.broadcast(m), (F.col("rule_type") == F.col("t_")) & F.col("ingredient_id").eqNullSafe(F.col("i_")), "left")  # as many rows as kinds of rules
    scaled = F.col("ingredient_id").isNotNull() & ~F.col("unit").isin(*NO_UNIT)
    met = met.join(units, ["store_id", "ingredient_id"], "left").join(F.broadcast(factors), (F.col("unit") == F.col("from_unit")) & (F.col("base_unit") == F.col("to_unit")), "left")  # a table of units
    factor = F.when(~scaled, 1.0).when(F.col("unit") == F.col("base_unit"), 1.0).otherwise(F.col("factor"))
    allowed = F.lit(False)
    for kind, semantics in ALLOWED.items():
        allowed = allowed | ((F.col("rule_type") == kind) & F.col("semantics").isin(*semantics))
    here = F.coalesce("mapped_", F.lit(False))
    rules = {UNMAPPED: ~here, MISMATCH: here & ~F.coalesce(allowed & (F.col("mapped_unit") == F.col("unit")), F.lit(False)), UNIT_REQUIRED: here & scaled & factor.isNull()}
    met = met.withColumn("issues_", failed(rules)).withColumn("target", F.col("value") * factor).withColumn("target_unit", F.when(scaled, F.col("base_unit")).otherwise(F.col("unit")))
    good = met.where(F.size("issues_") == 0)
    if daily is not None:
        good = good.join(daily.select("store_id", "ingredient_id", F.col("quantity").alias("daily_")), ["store_id", "ingredient_id"], "left")
    reference = F.when(F.col("semantics") == "PURCHASE_COVER_DAYS", F.coalesce("daily_", F.lit(0.0))) if daily is not None else F.lit(None).cast("double")
    rows = good.select("rule_id", "store_id", "ingredient_id", "rule_type", "semantics", "classification", "target", F.col("target_unit").alias("unit"), "effective_from", "effective_to", "penalty", reference.alias("reference_daily"))
    used = source.select(F.col("rule_type").alias("t_"), F.col("ingredient_id").alias("i_")).distinct()
    unused = mapping.join(used, (F.col("rule_type") == F.col("t_")) & F.col("ingredient_id").eqNullSafe(F.col("i_")), "left_anti")
    away = met.select("rule_id", F.explode("issues_").alias("issue")).unionByName(unused.select(F.concat_ws(":", "rule_type", F.coalesce("ingredient_id", F.lit(""))).alias("rule_id"), F.lit(UNUSED).alias("issue")))
    return rows, away
