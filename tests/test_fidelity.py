"""Fidelity of answers and rules from source rows, case by case."""

from pyspark.sql import functions as F

from tidegrain.operators import fidelity as FI
from tidegrain.operators import rule_mapping as RM


def test_numbers_of_texts(spark):
    texts = ["sold 12 of 3.5, -4 and 1e5", "v2 x3 10.", "3.4.5 7a 8", None, '{"a":1.50,"b":[2,-3]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", FI.numbers(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {0: [12.0, 3.5, -4.0], 1: [10.0], 2: [8.0], 3: [], 4: [1.5, 2.0, -3.0]}


CLAIMS = "answer_id int, claim_id int, text string, evidence_ids array<string>, facts map<string,string>"


def test_citations(spark):
    claims = [(1, 1, "", ["a", "b"], None), (1, 2, "", ["b"], None), (2, 3, "", ["a", "z"], None), (3, 4, "", [], None), (4, 5, "", None, None)]
    answers = [(1, ["b", "a", "a"]), (2, ["a"]), (3, []), (4, None), (5, []), (6, ["a"]), (7, ["q"])]
    evidence = spark.createDataFrame([("a",), ("b",), ("a",)], "evidence_id string")
    got = {r.answer_id: (r.valid, r.complete, r.n_unknown) for r in FI.citations(spark.createDataFrame(answers, "answer_id int, citations array<string>"), spark.createDataFrame(claims, CLAIMS), evidence).collect()}
    assert got == {1: (True, True, 0), 2: (False, False, 1), 3: (True, False, 0), 4: (True, False, 0), 5: (True, True, 0), 6: (True, False, 0), 7: (False, False, 1)}


def test_numbers_and_meanings_that_evidence_bears_out(spark):
    claims = [(1, 1, "10 of 3.0001 likely", ["a", "b"], None), (1, 2, "10 because of 4", ["b"], None), (1, 3, "10", ["z"], None), (1, 4, None, None, None)]
    evidence = spark.createDataFrame([("a", '{"q":10}', "probability"), ("b", '{"x":[3.0]}', None)], "evidence_id string, payload string, semantics string")
    words = {"P": ("likely", "probability"), "C": ("because", "causal")}
    got = {r.claim_id: (r.n_numbers, r.n_supported, r.violations) for r in FI.support(spark.createDataFrame(claims, CLAIMS), evidence, 1e-3, words).collect()}
    assert got == {1: (2, 2, []), 2: (2, 0, ["C"]), 3: (1, 0, []), 4: (0, 0, [])}


def test_facts_and_orders(spark):
    claims = spark.createDataFrame([(1, 1, "", None, {"q": "10.0000001", "s": "LEAN"}), (1, 2, "", None, {"q": "7"}), (2, 3, "", None, None)], CLAIMS)
    expected = spark.createDataFrame([(1, "q", "10"), (1, "s", "lean"), (1, "t", "1"), (2, "q", "1")], "answer_id int, fact string, value string")
    assert {r.answer_id: (r.n_expected, r.n_found) for r in FI.fact_fidelity(expected, claims).collect()} == {1: (3, 1), 2: (1, 0)}
    rows = lambda *x: spark.createDataFrame(list(x), "answer_id int, offer string, quantity double")
    got = {r.answer_id: (r.equal, r.n_ordered, r.n_told) for r in FI.order_fidelity(rows((1, "a", 1.0), (1, "a", 1.0), (2, "b", 2.0)), rows((1, "a", 1.0), (2, "b", 2.0), (3, "c", 1.0)), ["offer", "quantity"]).collect()}
    assert got == {1: (False, 2, 1), 2: (True, 1, 1), 3: (False, 0, 1)}


def test_rules_from_source_rows(spark):
    source = [("r1", "S", "maximum_stock", "i", 5000.0, "g"), ("r2", "S", "maximum_stock", None, 4.0, "ratio"), ("r3", "S", "safety_stock", "i", 1.0, "kg"), ("r4", "S", "shelf_life_target", "i", 3.0, "day"), ("r5", "S", "unheard", "i", 1.0, "kg"), ("r6", "S", "maximum_stock", "j", 1.0, "box"), ("r7", "S", "storage_capacity", "i", 1.0, "kg")]
    source = spark.createDataFrame([(*r, None, None) for r in source], "rule_id string, store_id string, rule_type string, ingredient_id string, value double, unit string, effective_from date, effective_to date")
    mapping = spark.createDataFrame(
        [("maximum_stock", "i", "RECEIVING_PEAK", "g"), ("maximum_stock", None, "END_OF_DAY_MAX", "ratio"), ("safety_stock", "i", "END_OF_DAY_MIN", "g"), ("shelf_life_target", "i", "PURCHASE_COVER_DAYS", "day"), ("maximum_stock", "j", "END_OF_DAY_MAX", "box"), ("storage_capacity", "i", "RECEIVING_PEAK", "kg"), ("safety_stock", "k", "END_OF_DAY_MIN", "kg")],
        "rule_type string, ingredient_id string, semantics string, unit string",
    ).withColumns({"classification": F.lit("HARD"), "penalty": F.lit(None).cast("double")})
    units = spark.createDataFrame([("S", "i", "kg"), ("S", "j", "kg")], "store_id string, ingredient_id string, base_unit string")
    factors = spark.createDataFrame([("g", "kg", 0.001)], "from_unit string, to_unit string, factor double")
    daily = spark.createDataFrame([("S", "i", 2.5)], "store_id string, ingredient_id string, quantity double")
    rows, away = RM.normalise_rules(source, mapping, units, factors, daily)
    assert {r.rule_id: (r.semantics, r.target, r.unit, r.reference_daily) for r in rows.collect()} == {"r1": ("RECEIVING_PEAK", 5.0, "kg", None), "r2": ("END_OF_DAY_MAX", 4.0, "ratio", None), "r4": ("PURCHASE_COVER_DAYS", 3.0, "day", 2.5)}
    assert {(r.rule_id, r.issue) for r in away.collect()} == {("r3", RM.MISMATCH), ("r5", RM.UNMAPPED), ("r6", RM.UNIT_REQUIRED), ("r7", RM.MISMATCH), ("safety_stock:k", RM.UNUSED)}
    assert RM.normalise_rules(source.limit(0), mapping.limit(0), units, factors)[0].count() == 0
