"""The critic by recomputation, with a planted fault for each code."""

import datetime as dt

from pyspark.sql import functions as F

from tidegrain.operators import critic as CR
from tidegrain.operators import inventory as I
from tidegrain.operators import lots as L

D = dt.date
KEYS = ["store_key", "ingredient_id"]
DAY = D(2026, 5, 1)
LOTS = "store_key string, ingredient_id string, lot_id string, quantity double, expiry_date date, received_date date"


def ledger(spark):
    lots = [("S", "a", "x", 4.0, DAY + dt.timedelta(2), None), ("S", "a", "y", 9.0, None, None), ("S", "b", "z", 3.0, DAY, None)]
    demand = [("S", k, DAY + dt.timedelta(t), 3.0) for k in "ab" for t in range(4)]
    make = spark.createDataFrame
    waste = make([], "store_key string, ingredient_id string, event_id string, date date, quantity double, lot_id string")
    rows, placed = L.flow(make(lots, LOTS), make(demand, "store_key string, ingredient_id string, date date, demand double"), make([], LOTS + ", arrival_date date"), waste, KEYS)
    rows = rows.cache()
    return L.lines(rows, KEYS), L.traces(rows, placed, KEYS)


def test_ledgers_part_where_the_fault_is(spark):
    exact, traces = ledger(spark)
    found = lambda claimed: {r.ingredient_id: (r.date, r.differs, r.n) for r in CR.first_divergence(claimed, exact, KEYS, ["date"], ["fulfilled", "ending"]).collect()}
    second = DAY + dt.timedelta(1)
    late = F.col("date") >= second
    assert found(exact) == {}
    assert found(exact.withColumn("ending", F.when(late & (F.col("ingredient_id") == "a"), F.col("ending") + 1).otherwise(F.col("ending")))) == {"a": (second, ["ending"], 3)}
    assert found(exact.where(~late | (F.col("ingredient_id") == "a"))) == {"b": (second, ["NOT_CLAIMED"], 3)}
    moved = exact.withColumn("date", F.when(F.col("date") == DAY, F.lit(D(2025, 1, 1))).otherwise(F.col("date")))
    assert found(moved)["a"] == (D(2025, 1, 1), ["NOT_FOUND"], 2)
    assert found(exact.withColumn("fulfilled", F.when(late, None).otherwise(F.col("fulfilled"))))["b"][1] == ["fulfilled"]
    swapped = traces.withColumn("lot_id", F.when(F.col("date") == second, "y").otherwise(F.col("lot_id")))
    parts = CR.allocation_divergence(swapped, traces, KEYS).collect()
    assert [(r.ingredient_id, r.date, r.lot_id) for r in parts] == [("a", second, "x")] and CR.allocation_divergence(traces, traces, KEYS).count() == 0


def test_a_chain_of_days(spark):
    exact, _ = ledger(spark)
    third = DAY + dt.timedelta(2)
    assert CR.broken_chain(exact, KEYS).count() == 0
    broken = CR.broken_chain(exact.withColumn("beginning", F.when(F.col("date") == third, F.col("beginning") + 1).otherwise(F.col("beginning"))), KEYS)
    assert {(r.ingredient_id, r.date, r.issue, r.gap) for r in broken.collect()} == {(k, third, "CARRY_OVER_MISMATCH", 1.0) for k in "ab"}
    assert {r.issue for r in CR.broken_chain(exact.where(F.col("date") != third), KEYS).collect()} == {"DAY_MISSING"}


def test_hopeful_figures(spark):
    schema = "store_key string, ingredient_id string, fill_rate double, p_stockout double"
    exact = spark.createDataFrame([("S", k, 0.9, 0.3) for k in "abcd"], schema)
    told = spark.createDataFrame([("S", "a", 0.92, 0.3), ("S", "b", 0.99, 0.3), ("S", "c", 0.9, 0.1)], schema)
    got = {r.ingredient_id: r.issue for r in CR.model_gaps(told, exact, KEYS, 0.05, 0.05).collect()}
    assert got == {k: CR.MODEL_MISMATCH for k in "bcd"}


def test_stress_and_what_was_not_evaluated(spark):
    schema = "plan string, store_key string, ingredient_id string, scenario_id int, shortage double, capacity_violation double, accounting_valid boolean"
    rows = [("p", "S", "a", 1, 0.0, 0.0, True), ("p", "S", "a", 2, 0.0, 0.0, True), ("q", "S", "a", 1, 1.0, 2.0, True), ("q", "S", "a", 2, 0.0, None, False)]
    summary = spark.createDataFrame(rows, schema)
    assert {(r.plan, r.issue) for r in CR.stress_issues(summary, ["plan"]).collect()} == {("q", CR.STRESS_ACCOUNTING), ("q", CR.STRESS_SHORTAGE), ("q", CR.STRESS_CAPACITY)}
    limits = spark.createDataFrame([("S", "a")], "store_key string, ingredient_id string")
    worlds = lambda *w: spark.createDataFrame(list(enumerate(w)), "scenario_id int, weight double")
    orders = spark.createDataFrame([("p", None), ("q", 3)], "plan string, shelf_life_days int")
    profile = {"maximum_stockout_probability": 0.1, "minimum_fill_rate": 0.9, "required_fill_rate_probability": 0.5}
    issues = lambda w, p, o=None: {(r.plan, r.issue) for r in CR.not_evaluated(summary, w, limits, p, ["plan"], KEYS, o).collect()}
    assert issues(worlds(0.5, 0.5), profile, orders) == {("q", CR.CAPACITY_NOT_EVALUATED), ("p", CR.UNKNOWN_EXPIRY)}
    assert issues(worlds(0.5, None), {"maximum_stockout_probability": 0.1}) == {("q", CR.CAPACITY_NOT_EVALUATED), ("p", CR.UNWEIGHTED_STOCKOUT), ("q", CR.UNWEIGHTED_STOCKOUT)}
    assert ("p", CR.UNWEIGHTED_SERVICE) in issues(worlds(None, None), profile) and issues(worlds(None), {}) == {("q", CR.CAPACITY_NOT_EVALUATED)}
    found = CR.not_evaluated(summary, worlds(0.5, 0.5), limits, profile, ["plan"], KEYS, orders).unionByName(CR.stress_issues(summary, ["plan"]))
    out = {r.plan: r for r in CR.verdict(found, summary, ["plan"], F.col("issue").startswith("STRESS_S") | (F.col("issue") == CR.CAPACITY_NOT_EVALUATED)).collect()}
    assert not out["p"].passed and out["p"].violations == [CR.UNKNOWN_EXPIRY] and out["q"].warnings == [CR.CAPACITY_NOT_EVALUATED, CR.STRESS_SHORTAGE]
    assert CR.verdict(found.limit(0), summary, ["plan"], F.lit(False)).where("passed").count() == 2


def test_ledgers_with_waste_agree_with_the_plain_ledger(spark):
    exact, _ = ledger(spark)
    make = spark.createDataFrame
    lots = make([("S", "a", "x", 4.0, DAY + dt.timedelta(2), None), ("S", "a", "y", 9.0, None, None), ("S", "b", "z", 3.0, DAY, None)], LOTS)
    demand = make([("S", k, DAY + dt.timedelta(t), 3.0) for k in "ab" for t in range(4)], "store_key string, ingredient_id string, date date, demand double")
    plain = I.ledger(lots, demand, make([], LOTS + ", arrival_date date"), KEYS)
    assert CR.first_divergence(plain, exact, KEYS, ["date"], ["beginning", "inbound", "expired", "fulfilled", "ending", "shortage"]).count() == 0
