"""Retrieval from the index in blocks against scoring every pair."""

import random

import pytest

from tidegrain.operators import evidence as V
from tidegrain.operators import retrieval as R

TERM = "array<struct<term:string,weight:double,opens:boolean>>"


def by_hand(questions, items, k, penalty=0.0):
    out = {}
    for q, terms, keys in questions:
        weights, opens = {}, {}
        for t, w, o in terms:
            weights[t], opens[t] = max(w, weights.get(t, 0)), o or opens.get(t, False)
        scored = []
        for i, own, own_keys in items:
            common = set(own or ()) & set(weights)
            if any(opens[t] for t in common):
                scored.append((-(sum(weights[t] for t in common) - penalty * len(set(keys) & set(own_keys or ()))), i, len(common)))
        out[q] = [(i, n, -s) for s, i, n in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("penalty,block", [(0.0, 7), (1.5, 1 << 16)])
def test_best_items_against_all_pairs(spark, penalty, block):
    r = random.Random(4)
    pool = [f"t{i}" for i in range(40)]
    often = lambda n: [min(pool[int(r.paretovariate(0.7)) % 40], pool[r.randrange(40)]) for _ in range(n)]
    items = [(i, None if i == 5 else often(r.randint(0, 12)), r.sample(["a", "b", "c"], r.randint(0, 2))) for i in range(120)]
    questions = [(q, [(t, float(r.choice([1, 1, 2, 7])), r.random() < 0.8) for t in often(r.randint(1, 10))], r.sample(["a", "b"], r.randint(0, 2))) for q in range(25)]
    asked = R.asked(spark.createDataFrame(questions, f"query_id int, terms {TERM}, keys array<string>"))
    index = R.index(spark.createDataFrame(items, "evidence_id int, terms array<string>, keys array<string>"), block)
    found = {}
    for x in R.best_items(asked, index, 4, penalty).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.evidence_id, x.shared, x.score))
    assert found == by_hand(questions, items, 4, penalty)
    assert index.select("block").distinct().count() > 1 or block > 100


def test_retrieval_of_nothing(spark):
    items = spark.createDataFrame([(1, None), (2, "")], "evidence_id int, text string")
    queries = spark.createDataFrame([(1, "word"), (2, None)], "query_id int, query string")
    assert V.lexical(queries, items, 3).count() == 0 and V.lexical(queries.limit(0), items, 3).count() == 0
    assert V.lexical(queries, items.limit(0), 3).count() == 0


def test_context_scores(spark):
    items = spark.createDataFrame(
        [(1, "SALES", "plain words", {"store": "S1"}), (2, "SALES", "other", {"store": "S2"}), (3, "RISK", "nothing", None), (4, "SALES", "plain", {"store": "s1", "strategy": "LEAN"}), (5, "NOTE", "far away", {"store": "S2"})],
        "evidence_id int, evidence_type string, text string, entities map<string,string>",
    )
    edges = spark.createDataFrame([(1, 5), (9, 1)], "source_id int, target_id int")
    ask = lambda *q: V.in_context(spark.createDataFrame([(1, *q)], "query_id int, query string, intent string, context map<string,string>"), items, edges, {"risk": {"RISK": 3.0}}, ("LEAN", "PROTECTED"), 10, seeds=1).orderBy("rank").collect()
    got = {r.evidence_id: r.score for r in ask("plain words", "risk", {"store": "s1"})}
    assert got == {1: 24.0, 4: 22.0, 3: 3.0, 5: 0.5}  # 2 differs in its entity; 5 is a neighbour of the best
    named = {r.evidence_id: r.score for r in ask("lean plain words", "risk", None)}
    assert named == {4: 20.0}  # 1 has 4 - 4 and no more than 0, nor do the others
    assert ask("plain", "what_if", None) == [] and ask("plain", "risk", {"store": "S9"}) == []


def test_priorities_of_intents(spark):
    items = spark.createDataFrame([(1, "B", "x y"), (2, "A", "z"), (3, "A", "x"), (4, "C", "x y z"), (5, "C", "w")], "evidence_id int, evidence_type string, text string")
    queries = spark.createDataFrame([(1, "x y z", "one"), (2, "x y z", "none")], "query_id int, query string, intent string")
    got = {}
    for r in V.prioritised(queries, items, {"one": ("A", "B")}, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.evidence_id, r.priority, r.shared))
    assert [x[:2] for x in got[1]] == [(2, 2), (3, 2), (1, 1), (4, 0)] and [x[0] for x in got[2]] == [4, 1, 2, 3]
    assert [x[2] for x in got[1]] == [1, 1, 2, 3]
