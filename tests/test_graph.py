"""The provenance graph against every pair of items, refusals, and steps from seeds."""

import random

import pytest

from tidegrain.operators import graph as G
from tidegrain.operators.checks import DataRefused

ITEMS = "evidence_id string, layer string, evidence_type string, entities map<string,string>, text string, passed boolean"


def items(seed):
    r = random.Random(seed)
    kinds = sorted({t for s in G.SPECS for t in s.source + s.target}) + ["bom_issue", "unheard_of"]
    names = ["strategy", "plan_id", "store_id", "product_id", "ingredient_id", "scenario_id", "target_date", "unit", "stress_id"]
    return [(f"e{i}", "M", r.choice(kinds), {n: r.choice("xy") for n in names if r.random() < 0.4}, f"text {i}", r.choice([True, False, None])) for i in range(160)]


def by_hand(rows):
    out = {("request:R", f"node:{r[0]}", "HAS_EVIDENCE") for r in rows}
    for s in G.SPECS:
        for a in rows:
            for b in rows:
                shared = [(x, y) for x, y in s.keys if x in a[3] and y in b[3]]
                if a[2] in s.source and b[2] in s.target and shared and all(a[3][x] == b[3][y] for x, y in shared):
                    if s.kind == "PASSED_CHECK" and not a[5] or s.kind == "FAILED_CHECK" and a[5]:
                        continue
                    out.add((f"node:{a[0]}", f"node:{b[0]}", s.kind))
    return out


def test_edges_against_all_pairs(spark):
    rows = items(2)
    df = spark.createDataFrame(rows + rows[:5], ITEMS)
    got = G.edges(df, "R").collect()
    assert {(e.source_node_id, e.target_node_id, e.edge_type) for e in got} == by_hand(rows) and len({e.edge_id for e in got}) == len(got)
    assert len({e.edge_type for e in got}) >= 12
    kinds = {n.node_id: n.node_type for n in G.nodes(df, "R").collect()}
    assert len(kinds) == len(rows) + 1 and kinds["request:R"] == "DecisionRequest"
    assert all(kinds[f"node:{r[0]}"] == G.NODE_TYPES.get(r[2], "Evidence") for r in rows)


def test_an_id_for_two_things_is_refused(spark):
    rows = items(3)
    with pytest.raises(DataRefused, match="EVIDENCE_ID_COLLISION"):
        G.edges(spark.createDataFrame(rows + [(rows[0][0], *rows[1][1:])], ITEMS), "R")
    assert G.edges(spark.createDataFrame([], ITEMS), "R").count() == 0


def test_steps_from_seeds(spark):
    found = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)] + [("2", "0"), ("9", "9")], "source_node_id string, target_node_id string")
    seeds = spark.createDataFrame([("0",), ("0",), ("7",)], "node_id string")
    depths = lambda k: {r.node_id: r.depth for r in G.reach(found, seeds, k).collect()}
    assert depths(0) == {"0": 0, "7": 0} and depths(2) == {"0": 0, "7": 0, "1": 1, "2": 1, "3": 2} and depths(50) == {**depths(2), "4": 3, "5": 4, "6": 5}


def test_all_ways_to_meet_give_the_same(spark, monkeypatch):
    """Where no end has few items, all specs meet in one shuffle."""
    rows = items(5)
    df = spark.createDataFrame(rows, ITEMS)
    monkeypatch.setattr(G, "FEW", 0)
    monkeypatch.setattr(G, "SPECS", G.SPECS[:8])
    got = G.edges(df, "R", G.SPECS).where("edge_type <> 'HAS_EVIDENCE'").collect()
    assert {(e.source_node_id, e.target_node_id, e.edge_type) for e in got} == {e for e in by_hand(rows) if e[2] != "HAS_EVIDENCE"}


def test_items_are_read_a_bounded_number_of_times_and_edges_not_sorted_out_again(spark):
    """However many specs there are, the kept items are read by a few scans, and edges that cannot come again are not shuffled."""
    rows = [(f"w{i}", "M", "lot_waste", {"store_id": "S", "ingredient_id": "a"}, f"t{i}", None) for i in range(50)] + [(f"k{s}", "M", "inventory_key_summary", {"strategy": s, "store_id": "S", "ingredient_id": "a"}, s, None) for s in "xy"]
    found = G.edges(spark.createDataFrame(rows, ITEMS), "R")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 52 + 100
    assert plan.count("Relation [") <= 7 and "Aggregate" not in plan


def test_an_id_that_items_share_is_one_node(spark):
    rows = [("a", "M", "lot_waste", {"store_id": "S", "ingredient_id": i}, f"t{i}", None) for i in "uvv"] + [(f"k{i}", "M", "inventory_key_summary", {"strategy": "x", "store_id": "S", "ingredient_id": i}, i, None) for i in "uvw"]
    df = spark.createDataFrame(rows, ITEMS)
    got = [tuple(e)[1:] for e in G.edges(df, "R", shared_ids=True).collect()]
    want = {("request:R", f"node:{x}", "HAS_EVIDENCE") for x in ("a", "ku", "kv", "kw")} | {("node:a", f"node:k{i}", "WASTED_AS") for i in "uv"}
    assert set(got) == want and len(got) == len(want)
    assert G.nodes(df, "R", shared_ids=True).count() == 6
    with pytest.raises(DataRefused, match="EVIDENCE_ID_COLLISION"):
        G.edges(df, "R")


def test_many_nodes_of_a_step_meet_by_shuffle(spark, monkeypatch):
    """Steps from many nodes, those with very many edges apart."""
    monkeypatch.setattr(G, "FEW", 0)
    monkeypatch.setattr(G, "HOT", 2)
    found = spark.createDataFrame([("hub", f"n{i}") for i in range(9)] + [("n1", "m"), ("m", "z"), ("hub", "hub")], "source_node_id string, target_node_id string")
    depths = {r.node_id: r.depth for r in G.reach(found, spark.createDataFrame([("n3",)], "node_id string"), 4).collect()}
    assert depths == {"n3": 0, "hub": 1, **{f"n{i}": 2 for i in range(9) if i != 3}, "m": 3, "z": 4}
