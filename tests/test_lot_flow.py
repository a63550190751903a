"""Lot ledgers with waste, costs and traces against a run of single lots."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import lots as L

D = dt.date
KEYS = ["store_key", "ingredient_id"]
START = D(2026, 3, 1)
LOTS = "store_key string, ingredient_id string, lot_id string, quantity double, expiry_date date, received_date date"
WASTE = "store_key string, ingredient_id string, event_id string, date date, quantity double, lot_id string"
DEMAND = "store_key string, ingredient_id string, date date, demand double"


def case(seed):
    r = random.Random(seed)
    keys = [("S", "a"), ("S", "b")]
    at = lambda low, high: START + dt.timedelta(r.randint(low, high))
    lots = [(*r.choice(keys), f"l{i:02}", float(r.randint(1, 6)), r.choice([None, at(-1, 6)]), r.choice([None, at(-3, -1)])) for i in range(14)]
    inbound = []
    for i in range(30):
        day = at(0, 9)
        inbound.append((*r.choice(keys), f"m{i:02}", float(r.randint(1, 5)), r.choice([None, day + dt.timedelta(r.randint(-1, 3)), day + dt.timedelta(2)]), day, day))
    demand = [(*k, START + dt.timedelta(t), float(r.randint(0, 9))) for k in keys for t in range(10)]
    waste = [(*r.choice(keys), f"w{i:02}", at(0, 9), float(r.randint(1, 4)), r.choice([None, None, f"l{r.randint(0, 13):02}", f"m{r.randint(0, 29):02}"])) for i in range(12)]
    return lots, inbound, demand, waste


def by_hand(lots, inbound, demand, waste, inclusive, risk_days):
    lines, traces, refused = {}, defaultdict(float), {}
    late = D(9999, 12, 31)
    for key in {d[:2] for d in demand}:
        stock = [{"id": x[2], "q": x[3], "e": x[4] or late, "r": x[5] or late} for x in lots if x[:2] == key]
        for day in sorted(d[2] for d in demand if d[:2] == key):
            beginning = sum(x["q"] for x in stock)
            came = [{"id": x[2], "q": x[3], "e": x[4] or late, "r": x[5] or late} for x in inbound if x[:2] == key and x[6] == day]
            stock = sorted(stock + came, key=lambda x: (x["e"], x["r"], x["id"]))
            dead = [x for x in stock if (x["e"] < day if inclusive else x["e"] <= day)]
            for x in dead:
                traces[key, x["id"], day, "expired", None] += x["q"]
            stock = [x for x in stock if x not in dead]

            def take(kind, wanted, event=None, lot=None):
                for x in stock:  # noqa: B023
                    got = min(x["q"], wanted) if lot in (None, x["id"]) else 0.0
                    x["q"] -= got
                    wanted -= got
                    traces[key, x["id"], day, kind, event] += got  # noqa: B023
                return wanted

            want = next(d[3] for d in demand if d[:2] == key and d[2] == day)
            short = take("consumed", want)
            before = sum(x["q"] for x in stock)
            for w in sorted(waste, key=lambda w: w[2]):
                if w[:2] == key and w[3] == day:
                    rest = take("wasted", w[4], w[2], w[5])
                    if rest > 0:
                        refused[w[2]] = rest
            ending = sum(x["q"] for x in stock)
            risk = sum(x["q"] for x in stock if x["e"] != late and 0 <= (x["e"] - day).days <= risk_days)
            arrived = sum(x[3] for x in inbound if x[:2] == key and x[6] == day)
            lines[key, day] = (beginning, arrived, beginning + arrived, sum(x["q"] for x in dead), want, want - short, before - ending, ending, risk)
    return lines, {k: q for k, q in traces.items() if q > 0}, refused


def run(spark, lots, inbound, demand, waste, inclusive=True, risk_days=3):
    make = spark.createDataFrame
    rows, placed = L.flow(make(lots, LOTS), make(demand, DEMAND), make(inbound, LOTS + ", arrival_date date"), make(waste, WASTE), KEYS, inclusive, risk_days)
    return rows.cache(), placed


@pytest.mark.parametrize("seed,inclusive", [(1, True), (2, False), (5, True)])
def test_flow_against_single_lots(spark, seed, inclusive):
    given = case(seed)
    lines, traces, refused = by_hand(*given, inclusive, 3)
    rows, placed = run(spark, *given, inclusive)
    ledger = L.lines(rows, KEYS)
    assert {((r.store_key, r.ingredient_id), r.date): tuple(r[c] for c in L.AMOUNTS) for r in ledger.collect()} == lines
    assert {r.event_id: r.quantity for r in L.refused_waste(rows, KEYS).collect()} == refused
    found = L.traces(rows, placed, KEYS)
    got = {((r.store_key, r.ingredient_id), r.lot_id, r.date, r.kind, r.event_id): r.quantity for r in found.collect()}
    assert got == traces and L.unbalanced(ledger).count() == 0
    out = L.outcomes(placed, found, KEYS).collect()
    assert len(out) == len(given[0]) + len(given[1]) and all(r.left >= 0 for r in out)
    last = {k: max(d for q, d in lines if q == k) for k, _ in lines}
    for key, day in last.items():
        assert sum(r.left for r in out if (r.store_key, r.ingredient_id) == key) == lines[key, day][7]


def test_a_broken_ledger_is_found(spark):
    rows, _ = run(spark, *case(1))
    ledger = L.lines(rows, KEYS)
    assert L.unbalanced(ledger.withColumn("waste", F.col("waste") + F.when(F.col("date") == START, 1.0).otherwise(0.0))).count() == 2


def test_many_lots_of_equal_dates_are_one_entry(spark):
    lots = [("S", "a", f"l{i:04}", 1.0, START + dt.timedelta(5), None) for i in range(600)]
    demand = [("S", "a", START + dt.timedelta(t), 100.0) for t in range(7)]
    rows, placed = run(spark, lots, [], demand, [("S", "a", "w", START, 0.5, None)])
    assert rows.count() < 20
    found = L.traces(rows, placed, KEYS)
    per_lot = {r.lot_id: r.q for r in found.groupBy("lot_id").agg(F.sum("quantity").alias("q")).collect()}
    assert len(per_lot) == 600 and set(per_lot.values()) == {1.0}
    first = {r.lot_id: r.quantity for r in found.where(F.col("date") == START).where("kind = 'consumed'").collect()}
    assert first == {f"l{i:04}": 1.0 for i in range(100)}
    assert {r.lot_id: r.quantity for r in found.where("kind = 'wasted'").collect()} == {"l0100": 0.5}


def test_costs_capacity_and_summary(spark):
    lots, demand = [("S", "a", "x", 10.0, START, None), ("S", "b", "y", 4.0, None, None)], [("S", k, START + dt.timedelta(t), q) for k in "ab" for t, q in ((0, 3.0), (1, 2.0))]
    rows, _ = run(spark, lots, [], demand, [("S", "a", "w", START, 1.0, None)])
    terms = spark.createDataFrame([("S", "a", 0.5, 2.0, 3.0, 4.0, 8.0, None, START)], "store_key string, ingredient_id string, holding_cost double, shortage_cost double, expired_cost double, waste_cost double, capacity double, capacity_from date, capacity_to date")
    costed = L.with_costs(L.lines(rows, KEYS), terms, KEYS)
    got = {(r.ingredient_id, r.date): (r.cost_holding, r.cost_short, r.cost_expiry, r.cost_wasting, r.capacity_violation) for r in costed.collect()}
    next_ = START + dt.timedelta(1)
    assert got["a", START] == (3.0, 0.0, 0.0, 4.0, 2.0) and got["a", next_] == (0.0, 4.0, 18.0, 0.0, 0.0)
    assert got["b", START] == (None, None, None, None, 0.0)
    sums = {r.ingredient_id: r for r in L.summarize(costed, KEYS).collect()}
    assert (sums["a"].cost_total, sums["a"].fill_rate, sums["a"].n_stockout_days, sums["a"].first_stockout, sums["a"].days_of_supply) == (29.0, 0.6, 1, next_, 0.0)
    assert sums["b"].cost_total is None and sums["b"].n_stockout_days == 1 and sums["b"].waste == 0.0


def test_flow_of_nothing(spark):
    rows, placed = run(spark, [], [], [], [])
    assert L.lines(rows, KEYS).count() == 0 and L.traces(rows, placed, KEYS).count() == 0
    rows, placed = run(spark, [("S", "a", "x", 1.0, None, None)], [], [], [])
    assert L.outcomes(placed, L.traces(rows, placed, KEYS), KEYS).first().left == 1.0


def test_waste_that_names_no_lot_is_one_row_of_the_fold(spark):
    """The events of a day are as many as there are sales; the fold sees one run of them, and each gets its own share back."""
    key = ("S", "a")
    lots = [(*key, f"l{i}", 10.0, START + dt.timedelta(9), START) for i in range(5)]
    waste = [(*key, f"w{i:03}", START, 0.5, None) for i in range(120)] + [(*key, "w060b", START, 4.0, "l4")]
    runs = L.waste_runs(spark.createDataFrame(waste, WASTE), KEYS)
    assert [tuple(r) for r in runs.groupBy("run_", "lot_id").agg(F.count("*"), F.sum("quantity")).orderBy("run_").collect()] == [(0, None, 61, 30.5), (1, "l4", 1, 4.0), (2, None, 59, 29.5)]
    rows, placed = L.flow(spark.createDataFrame(lots, LOTS), spark.createDataFrame([(*key, START, 1.0)], DEMAND), spark.createDataFrame([], LOTS + ", arrival_date date"), spark.createDataFrame(waste, WASTE), KEYS)
    got = {r.event_id: r.quantity for r in L.traces(rows, placed, KEYS).where("kind = 'wasted'").groupBy("event_id").agg(F.sum("quantity").alias("quantity")).collect()}
    refused = {r.event_id: r.quantity for r in L.refused_waste(rows, KEYS).collect()}
    # 49 after demand: 61 events of 0.5, 4 of lot l4, then 14.5 for 29 events; the last 30 go without.
    assert got == {f"w{i:03}": 0.5 for i in range(90)} | {"w060b": 4.0} and refused == {f"w{i:03}": 0.5 for i in range(90, 120)}
