"""Provenance graph of evidence: typed nodes, and typed edges declared by the entities that two kinds of evidence share.

An edge spec names the evidence types of both ends and entity keys. Two items are related if all of these keys that both have agree, and
there is at least one. Each item stands in the join once for every choice of its keys that it could have in common with another, with the
values it has there; a pair meets in exactly one of these, the keys that both have. So a spec is one equality join, however its items differ
in the keys they carry.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.sources.keep import keep, keep_table

from .checks import guard, union_all

# Node types by evidence type, and edges: fixed values.
NODE_TYPES = {
    "decision_request": "DecisionRequest",
    "forecast_prediction": "ForecastPrediction",
    "product_demand_scenario": "ProductDemandScenario",
    "ingredient_demand": "IngredientDemand",
    "ingredient_demand_scenario": "IngredientDemand",
    "recipe_contribution": "RecipeContribution",
    "scenario_recipe_contribution": "RecipeContribution",
    "inventory_demand_scenario": "InventoryScenario",
    "inventory_scenario_result": "InventoryScenario",
    "stress_result": "StressResult",
    "inventory_key_summary": "InventoryKey",
    "stress_inventory_key": "InventoryKey",
    "inventory_risk": "RiskMetric",
    "inventory_key_risk": "RiskMetric",
    "lot_consumption": "InventoryLot",
    "lot_expiry": "InventoryLot",
    "lot_waste": "InventoryLot",
    "strategy_profile": "ProcurementStrategy",
    "procurement_plan": "ProcurementPlan",
    "first_stage_order": "ProcurementOrder",
    "recourse_order": "ProcurementOrder",
    "critic_verdict": "CriticCheck",
    "recommendation": "Recommendation",
    "stress_definition": "StressDefinition",
    "bom_issue": "Warning",
}


class Spec(NamedTuple):
    kind: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    keys: tuple[tuple[str, str], ...]  # entity of the source, entity of the target
    only: Callable[[], Column] | None = None  # which items may be the source


def same(*keys: str) -> tuple[tuple[str, str], ...]:
    return tuple((k, k) for k in keys)


PLAN, CRITIC = ("procurement_plan",), ("critic_verdict",)
CONTRIBUTIONS = ("recipe_contribution", "scenario_recipe_contribution")
BY_PLAN = same("strategy", "plan_id")
BY_PRODUCT, BY_SCENARIO_PRODUCT = same("store_id", "product_id", "target_date"), same("scenario_id", "store_id", "product_id", "target_date")
BY_LOT = same("strategy", "scenario_id", "store_id", "ingredient_id")
SPECS = (
    Spec("VALIDATED_BY", PLAN, CRITIC, BY_PLAN),
    Spec("PASSED_CHECK", CRITIC, PLAN, BY_PLAN, lambda: F.coalesce("passed", F.lit(False))),
    Spec("FAILED_CHECK", CRITIC, PLAN, BY_PLAN, lambda: ~F.coalesce("passed", F.lit(False))),
    Spec("HAS_ORDER", PLAN, ("first_stage_order",), same("strategy")),
    Spec("HAS_RECOURSE", PLAN, ("recourse_order",), same("strategy")),
    Spec("SIMULATED_UNDER", PLAN, ("exact_simulation_package", "stress_simulation_package"), same("strategy")),
    Spec("RECOMMENDED_AS", ("recommendation",), PLAN, same("strategy")),
    Spec("CONTRIBUTES_TO", CONTRIBUTIONS, ("ingredient_demand", "ingredient_demand_scenario"), same("scenario_id", "store_id", "ingredient_id", "target_date")),
    Spec("USES_RECIPE", ("forecast_prediction",), CONTRIBUTIONS, BY_PRODUCT),
    Spec("DERIVED_FROM", CONTRIBUTIONS, ("forecast_prediction",), BY_PRODUCT),
    Spec("USES_RECIPE", ("product_demand_scenario",), ("scenario_recipe_contribution",), BY_SCENARIO_PRODUCT),
    Spec("DERIVED_FROM", ("scenario_recipe_contribution",), ("product_demand_scenario",), BY_SCENARIO_PRODUCT),
    Spec("REALIZED_AS_SCENARIO", ("inventory_demand_scenario",), ("inventory_scenario_result",), same("scenario_id")),
    Spec("HAS_RISK", ("inventory_scenario_result", "inventory_key_summary"), ("inventory_risk", "inventory_key_risk"), same("strategy", "store_id", "ingredient_id", "unit")),
    Spec("CONSUMED_BY", ("lot_consumption",), ("inventory_key_summary",), BY_LOT),
    Spec("EXPIRED_AS", ("lot_expiry",), ("inventory_key_summary",), BY_LOT),
    Spec("WASTED_AS", ("lot_waste",), ("inventory_key_summary",), BY_LOT),
    Spec("SIMULATED_UNDER", ("stress_definition",), ("stress_result", "stress_inventory_key"), (("stress_id", "scenario_id"),)),
)


FEW = 20_000  # rows that may go to every task
HOT = 100_000  # edges at one node that are not left to one task


def few(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows, sent to every task where it is small."""
    return F.broadcast(df) if n <= FEW else df


def checked(items: DataFrame, shared_ids: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Items once each, kept. Stops if an id stands for different evidence; with ``shared_ids`` each of these is an item of its own, and
    such ids (evidence_id) come second.

    Ids are counted by their hash, which is short. Only items whose hash comes again are compared, as a whole.
    """
    every, h = keep_table(items), F.xxhash64("evidence_id")
    repeated = keep(every.groupBy(h.alias("h_")).count().where("count > 1").select("h_"))
    n = repeated.count()
    if not n:
        return every, None
    content = F.to_json(F.struct("layer", "evidence_type", F.to_json(F.array_sort(F.map_entries("entities"))).alias("entities"), "text"))
    again = every.withColumn("h_", h).join(few(repeated, n), "h_", "left_semi").drop("h_").withColumn("content_", content)
    clash = again.groupBy("evidence_id").agg(F.min("content_").alias("one"), F.max("content_").alias("other")).where("one <> other")
    if not shared_ids:
        guard(clash, "EVIDENCE_ID_COLLISION")
    once = again.dropDuplicates(["evidence_id", "content_"] if shared_ids else ["evidence_id"]).drop("content_")
    others = every.withColumn("h_", h).join(few(repeated, n), "h_", "left_anti").drop("h_")
    return others.unionByName(once), keep(clash.select("evidence_id")) if shared_ids else None


def node_id(evidence_id: Column) -> Column:
    return F.concat(F.lit("node:"), evidence_id)


def nodes(items: DataFrame, request_id: str, shared_ids: bool = False) -> DataFrame:
    """node_id, node_type, label, evidence_id: a node for each item, and one for the request. items: evidence_id, layer, evidence_type, entities (map), text."""
    known = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    own = checked(items, shared_ids)[0].select(node_id(F.col("evidence_id")).alias("node_id"), F.coalesce(F.try_element_at(known, F.col("evidence_type")), F.lit("Evidence")).alias("node_type"), F.col("text").alias("label"), "evidence_id")
    none = F.lit(None).cast(items.schema["evidence_id"].dataType)
    request = items.sparkSession.range(1).select(F.lit(f"request:{request_id}").alias("node_id"), F.lit("DecisionRequest").alias("node_type"), F.lit(f"Decision request {request_id}").alias("label"), none.alias("evidence_id"))
    return own.unionByName(request)


def _met(every: DataFrame, specs: tuple[Spec, ...]) -> list[DataFrame]:
    """source, target (evidence ids) and kind: the pairs of all specs.

    How many items of a type have which keys is counted first. An item then stands in the join once for each choice of keys that it and
    some item of the other end have in common. Specs with few items at one end send these to every task, and the other end is read once
    for all of them; the others meet in one shuffle.
    """
    names = sorted({k for s in specs for pair in s.keys for k in pair})
    bit = {n: 1 << i for i, n in enumerate(names)}
    every = every.where(F.col("evidence_type").isin(*{t for s in specs for t in s.source + s.target}))
    every = every.select("*", F.array(*[F.col("entities")[n] for n in names]).alias("values_"))
    every = every.withColumn("has_", sum((F.when(F.col("values_")[i].isNotNull(), 1 << i).otherwise(0) for i in range(len(names))), F.lit(0)))
    held = every.groupBy("evidence_type", "has_").count().collect()  # types by sets of keys
    rows = {"source": ([], [], []), "target": ([], [], [])}  # by end: of specs with a small target, with a small source, with neither
    used = {"source": (set(), set(), set()), "target": (set(), set(), set())}
    for k, spec in enumerate(specs):
        size, masks = {}, {}
        for end, types, keys in (("source", spec.source, [x for x, _ in spec.keys]), ("target", spec.target, [y for _, y in spec.keys])):
            own = [r for r in held if r.evidence_type in types]
            size[end] = sum(r["count"] for r in own)
            masks[end] = {}  # keys of the spec -> all keys of the items that have these
            for r in own:
                masks[end].setdefault(sum(1 << i for i, n in enumerate(keys) if r.has_ & bit[n]), []).append(r.has_)
        way = 0 if size["target"] <= min(FEW, size["source"]) else 1 if size["source"] <= FEW else 2
        common = {a & b for a in masks["source"] for b in masks["target"]} - {0}
        for chosen in sorted(common):
            for end, other, types, side in (("source", "target", spec.source, 0), ("target", "source", spec.target, 1)):
                own = sorted({h for m, all_ in masks[end].items() if any(m & o == chosen for o in masks[other]) for h in all_})
                ok = F.col("evidence_type").isin(*types) & F.col("has_").isin(*own)
                ok = ok & spec.only() if spec.only and end == "source" else ok
                values = F.array(*[F.col("values_")[names.index(pair[side])] for i, pair in enumerate(spec.keys) if chosen >> i & 1])
                mask = sum((F.when(F.col("values_")[names.index(pair[side])].isNotNull(), 1 << i).otherwise(0) for i, pair in enumerate(spec.keys)), F.lit(0))
                used[end][way].update(types)
                rows[end][way].append(F.when(ok, F.struct(F.lit(k).alias("spec_"), F.lit(chosen).alias("chosen_"), values.alias("key_"), mask.alias(f"mask_{end}"))))
    kind = F.element_at(F.array(*[F.lit(s.kind) for s in specs]), F.col("spec_") + 1)
    out = []
    for way in range(3):
        if rows["source"][way]:
            a, b = (every.where(F.col("evidence_type").isin(*used[end][way])).select(F.col("evidence_id").alias(end), F.inline(F.array(*rows[end][way]))).where("spec_ IS NOT NULL") for end in ("source", "target"))
            a, b = F.broadcast(a) if way == 1 else a, F.broadcast(b) if way == 0 else b
            met = a.join(b, ["spec_", "chosen_", "key_"]).where(F.col("mask_source").bitwiseAND(F.col("mask_target")) == F.col("chosen_"))
            out.append(met.select("source", "target", kind.alias("kind")))
    return out


def edges(items: DataFrame, request_id: str, specs: tuple[Spec, ...] = SPECS, shared_ids: bool = False) -> DataFrame:
    """edge_id, source_node_id, target_node_id, edge_type: the edges of all specs, and HAS_EVIDENCE from the request to each item.

    A pair meets once in a spec, so edges are told apart only where they could come again: of kinds that two specs have between the same
    types, and at nodes that items share.
    """
    every, shared = checked(items, shared_ids)
    out = [every.select(F.lit(f"request:{request_id}").alias("source_node_id"), node_id(F.col("evidence_id")).alias("target_node_id"), F.lit("HAS_EVIDENCE").alias("edge_type"))]
    out += [m.select(node_id(F.col("source")).alias("source_node_id"), node_id(F.col("target")).alias("target_node_id"), F.col("kind").alias("edge_type")) for m in (_met(every, specs) if specs else [])]
    found = union_all(out)
    twice = {a.kind for a, b in combinations(specs, 2) if a.kind == b.kind and set(a.source) & set(b.source) and set(a.target) & set(b.target)} | {s.kind for s in specs if s.kind == "HAS_EVIDENCE"}
    again = F.col("edge_type").isin(*twice) if twice else F.lit(False)
    if shared is not None:
        ids = few(shared.select(node_id(F.col("evidence_id")).alias("n_"), F.lit(True).alias("y_")), shared.count())
        for end in ("source_node_id", "target_node_id"):
            found = found.join(ids.select(F.col("n_").alias(f"n_{end}"), F.col("y_").alias(f"y_{end}")), F.col(end) == F.col(f"n_{end}"), "left")
            again = again | F.coalesce(f"y_{end}", F.lit(False))
    names = ["source_node_id", "target_node_id", "edge_type"]
    found = found.where(~again).select(*names).unionByName(found.where(again).select(*names).distinct()) if twice or shared is not None else found
    text = F.concat_ws("|", "source_node_id", "edge_type", "target_node_id")
    edge_id = F.concat(F.lit("edge:"), F.lower("edge_type"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))
    return found.select(edge_id.alias("edge_id"), *names)


def reach(found: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node_id, depth: what lies within ``depth`` undirected steps of the seeds (node_id), with the fewest steps.

    Each step goes out from the nodes of the last one alone; what it comes to was met in the last two steps or never. Few nodes are sent
    to every task; many are joined by shuffle, those with very many edges apart.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("from_"), F.col(b).alias("node_id"))
    both = keep_table(found.select("source_node_id", "target_node_id")).select(F.inline(F.array(pair("source_node_id", "target_node_id"), pair("target_node_id", "source_node_id"))))
    fronts, hot = [keep_table(seeds.select("node_id").distinct())], None
    for step in range(1, depth + 1):
        front, n = fronts[-1].select(F.col("node_id").alias("from_")), fronts[-1].count()
        if not n:
            break
        if n <= FEW:
            after = both.join(F.broadcast(front), "from_")
        else:
            far, front = (x.withColumn("h_", F.xxhash64("from_")) for x in (both, front))
            hot = keep(far.groupBy("h_").count().where(F.col("count") > HOT).select("h_")) if hot is None else hot
            n_hot = hot.count()
            cold = far.join(few(hot, n_hot), "h_", "left_anti").join(front.drop("h_"), "from_") if n_hot else far.join(front.drop("h_"), "from_")
            after = cold.select("node_id")
            if n_hot:
                near = front.join(few(hot, n_hot), "h_", "left_semi").drop("h_")
                after = after.unionByName(far.join(few(hot, n_hot), "h_", "left_semi").join(few(near, n_hot), "from_").select("node_id"))
        met = union_all(fronts[-2:])
        fronts.append(keep_table(after.select("node_id").distinct().join(met, "node_id", "left_anti")))
    return union_all([f.withColumn("depth", F.lit(k)) for k, f in enumerate(fronts)])
