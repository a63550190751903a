"""Supply bounds against loops over every need, lot, delivery and offer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import supply as U

D = dt.date
KEYS = ["store_key", "ingredient_id"]
NEEDS = "scenario_id long, store_key string, ingredient_id string, date date, quantity double"
STOCK = "store_key string, ingredient_id string, quantity double, expiry_date date"
INBOUND = STOCK + ", arrival_date date"
OFFERS = "offer_id string, store_key string, ingredient_id string, available boolean, order_date date, order_cutoff_date date, arrival_date date, shelf_life_days int, maximum_order_quantity double, price_per_unit double"
START = D(2026, 1, 10)


def day(r, low=-5, high=25):
    return START + dt.timedelta(r.randint(low, high))


def case(seed):
    r = random.Random(seed)
    keys = [("S", "a"), ("S", "b"), ("T", "a")]
    some = lambda n: [(*r.choice(keys), float(r.randint(1, 9)), r.choice([None, day(r)])) for _ in range(n)]
    needs = [(w, *k, START + dt.timedelta(t), float(r.randint(0, 70))) for w in (1, 2) for k in keys for t in range(15) if r.random() < 0.8]
    inbound = [(*x, day(r, -2, 16)) for x in some(12)]
    offers = [
        (f"o{i}", *r.choice(keys[:2]), r.choice([True, True, False, None]), day(r, -2, 12), r.choice([None, day(r, 0, 12)]), r.choice([None, day(r, 2, 18), day(r, 2, 18)]), r.choice([None, 0, 3, 8]), r.choice([None, 4.0, 2.0, 6.0, 5.0]), float(r.randint(1, 5)))
        for i in range(14)
    ]
    return needs, some(6), inbound, offers


def by_hand(needs, initial, inbound, offers, inclusive, unknown):
    ok = lambda e, d: e is None or (e >= d if inclusive else e > d)
    opened = [o for o in offers if o[3] and o[4] >= START and (o[5] is None or o[4] <= o[5]) and o[6] is not None]
    rows = {}
    for w, s, i, d, q in needs:
        own = [o for o in opened if o[1:3] == (s, i)]
        base = sum(x[2] for x in initial if x[:2] == (s, i) and ok(x[3], d)) + sum(x[2] for x in inbound if x[:2] == (s, i) and x[4] <= d and ok(x[3], d) and ok(x[3], x[4]))
        free = 0
        for o in own:
            last = None if o[7] is None else o[6] + dt.timedelta(o[7])
            if o[6] <= d and ok(last, d) and not (o[7] is None and unknown == "reject"):
                free, base = (free + 1, base) if o[8] is None else (free, base + o[8])
        first = min((o[6] for o in own), default=None)
        short = 0.0 if free else max(0.0, q - base)
        reason = None if short <= 1e-6 else U.BEFORE_FIRST_ARRIVAL if first and d < first else U.NO_USABLE_LOT
        rows[w, s, i, d] = (q, base, free, short, reason, first, min((o[6] for o in own if o[6] > d), default=None), max((o[6] + dt.timedelta(o[7]) for o in own if o[7] is not None), default=None))
    prefixes = {}
    for key in {k[:3] for k in rows}:
        own = {k[3]: v for k, v in rows.items() if k[:3] == key and (v[5] is None or k[3] < v[5])}
        if own:
            point = max(own)
            stock = sum(x[2] for x in initial if x[:2] == key[1:]) + sum(x[2] for x in inbound if x[:2] == key[1:] and x[4] <= point)
            prefixes[key] = (point, sum(v[0] for v in own.values()), stock, max(0.0, sum(v[0] for v in own.values()) - stock))
    return rows, prefixes


def frames(spark, needs, initial, inbound, offers, inclusive=True, unknown="reject"):
    opened = U.open_offers(spark.createDataFrame(offers, OFFERS), F.lit(START), unknown)
    n = spark.createDataFrame(needs, NEEDS)
    swept = U.usable_supply(n, spark.createDataFrame(initial, STOCK), spark.createDataFrame(inbound, INBOUND), opened, KEYS, inclusive)
    return n, opened, U.supply_bounds(n, swept, KEYS)


@pytest.mark.parametrize("seed,inclusive,unknown", [(1, True, "reject"), (4, False, "last")])
def test_bounds_against_loops(spark, seed, inclusive, unknown):
    given = case(seed)
    rows, prefixes = by_hand(*given, inclusive, unknown)
    _, _, bounds = frames(spark, *given, inclusive, unknown)
    got = {(r.scenario_id, r.store_key, r.ingredient_id, r.date): (r.required, r.usable, r.unlimited, r.shortfall, r.reason, r.earliest_arrival, r.next_arrival, r.last_expiry) for r in bounds.collect()}
    assert got == rows and any(v[4] for v in rows.values())
    found = {(r.scenario_id, r.store_key, r.ingredient_id): (r.date, r.required, r.received, r.shortfall) for r in U.prefix_bounds(bounds, KEYS).collect()}
    assert found == prefixes
    totals = {(r.scenario_id, r.store_key, r.ingredient_id): (r.required, r.shortfall, r.short) for r in U.key_bounds(bounds, U.prefix_bounds(bounds, KEYS), KEYS).collect()}
    for key in {k[:3] for k in rows}:
        days = [v for k, v in rows.items() if k[:3] == key]
        prefix = prefixes.get(key, (None, 0, 0, 0.0))[3]
        assert totals[key] == (sum(v[0] for v in days), max(sum(v[3] for v in days), prefix), any(v[4] for v in days) or prefix > 1e-6)


def test_bounds_never_exceed_the_ledger_shortage(spark):
    """What a first-expired-first-out run falls short of with everything delivered is at least the bound of each key."""
    from tidegrain.operators import inventory as I

    needs, initial, inbound, _ = case(9)
    inbound = [x for x in inbound if x[4] >= START]
    needs = [n for n in needs if n[0] == 1]
    n, _, bounds = frames(spark, needs, initial, inbound, [])
    lots = spark.createDataFrame([(*x, f"l{i}", None) for i, x in enumerate(initial)], STOCK + ", lot_id string, received_date date")
    coming = spark.createDataFrame([(*x, f"m{i}", x[4]) for i, x in enumerate(inbound)], INBOUND + ", lot_id string, received_date date")
    days = [(*k, START + dt.timedelta(t), sum((x[4] for x in needs if x[1:3] == k and x[3] == START + dt.timedelta(t)), 0.0)) for k in {x[1:3] for x in needs} for t in range(17)]
    lines = I.ledger(lots, spark.createDataFrame(days, "store_key string, ingredient_id string, date date, demand double"), coming, KEYS)
    short = {(r.store_key, r.ingredient_id): r.s for r in lines.groupBy(*KEYS).agg(F.sum("shortage").alias("s")).collect()}
    low = U.key_bounds(bounds, U.prefix_bounds(bounds, KEYS), KEYS).collect()
    assert low and all(r.shortfall <= short[r.store_key, r.ingredient_id] + 1e-9 for r in low)


def test_blocked_offers_profiles_and_cost(spark):
    needs = [(1, "S", "a", START, 10.0), (2, "S", "a", START, 20.0), (1, "S", "a", START + dt.timedelta(3), 10.0), (2, "S", "a", START + dt.timedelta(3), 10.0)]
    offers = [("x", "S", "a", True, START, None, START + dt.timedelta(2), None, 50.0, 2.0), ("y", "S", "a", True, START, None, START + dt.timedelta(3), 4, 50.0, 3.0), ("z", "S", "a", True, START, None, START + dt.timedelta(9), None, 50.0, 1.0)]
    n, opened, bounds = frames(spark, needs, [("S", "a", 5.0, None)], [], offers)
    assert [tuple(r) for r in U.blocked_offers(opened, n, KEYS).collect()] == [("S", "a", "x", START + dt.timedelta(2), U.EXPIRY_REQUIRED)]
    by_key = U.key_bounds(bounds, U.prefix_bounds(bounds, KEYS), KEYS)
    assert {r.scenario_id: (r.required, r.shortfall) for r in by_key.collect()} == {1: (20.0, 5.0), 2: (30.0, 15.0)}
    weights = spark.createDataFrame([(1, 0.75), (2, 0.25)], "scenario_id long, weight double")
    profiles = [("fill", 0.6, 1.0, 0.0), ("risk", 0.0, 0.5, 0.0), ("mean", 0.0, 1.0, 0.7), ("none", 0.5, 1.0, 0.68)]
    out = {r.profile: r for r in U.ruled_out(by_key, weights, profiles, KEYS).collect()}
    assert {p: r.infeasible for p, r in out.items()} == {"fill": True, "risk": True, "mean": True, "none": False}
    assert (out["fill"].worst_fill, out["fill"].stockout_probability, out["fill"].worst_expected_fill) == (0.5, 1.0, 0.6875)
    unknown = {r.profile: r for r in U.ruled_out(by_key, weights.withColumn("weight", F.when(F.col("scenario_id") == 1, F.col("weight"))), profiles, KEYS).collect()}
    assert {p for p, r in unknown.items() if r.infeasible} == {"fill"} and unknown["risk"].stockout_probability is None
    received = spark.createDataFrame([("S", "a", 5.0)], "store_key string, ingredient_id string, received double")
    cost = U.least_cost(by_key, received, opened, 0.5, KEYS, F.lit(START + dt.timedelta(5))).first()
    assert (cost.quantity, cost.price, cost.cost) == (10.0, 2.0, 20.0)


def test_bounds_of_nothing(spark):
    _, _, bounds = frames(spark, [], [], [], [])
    assert bounds.count() == 0 and U.prefix_bounds(bounds, KEYS).count() == 0
    _, _, bounds = frames(spark, [(1, "S", "a", START, None), (1, "S", "a", START + dt.timedelta(1), 3.0)], [], [], [])
    assert {(r.shortfall, r.reason) for r in bounds.where("required is not null").collect()} == {(3.0, U.NO_USABLE_LOT)}


def test_stock_is_read_once_for_each_input(spark):
    """The sweep has one scan of the needs and one of each kind of supply, and adds up before the one shuffle of changes."""
    needs, initial, inbound, offers = case(1)
    opened = U.open_offers(spark.createDataFrame(offers, OFFERS), F.lit(START))
    swept = U.usable_supply(spark.createDataFrame(needs, NEEDS), spark.createDataFrame(initial, STOCK), spark.createDataFrame(inbound, INBOUND), opened, KEYS)
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 4
