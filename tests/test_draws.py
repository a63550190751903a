"""Draws from pools with fallback: every level, ranks across buckets, lines without a pool."""

import datetime as dt

from pyspark.sql import functions as F

from tidegrain.operators import draws as DR

D = dt.date
SEEN = "supplier_id string, ingredient_id string, lead int"
LINES = "line int, supplier_id string, ingredient_id string, order_date date, shelf_life_days int, u double"


def test_each_level_draws_an_observed_value(spark):
    seen = [("s", "i", d) for d in (5, 1, 3)] + [("s", "j", 40), ("t", "i", 7), (None, "k", 9), ("t", None, 11)]
    lines = [(k * 10 + n, *who, D(2026, 1, 1), shelf, u) for k, who in enumerate([("s", "i"), ("s", "j"), ("t", "i"), ("t", "z"), ("x", "z"), (None, None)]) for n, (u, shelf) in enumerate([(0.0, 0), (0.5, None), (0.999999, -1)])]
    got, without = DR.realise_supply(spark.createDataFrame(lines, LINES), spark.createDataFrame(seen, SEEN), F.col("u"), 3)
    pools = {"supplier_ingredient": [1, 3, 5], "supplier": [1, 3, 5, 40], "ingredient": [1, 3, 5, 7], "global": [1, 3, 5, 7, 9, 11, 40]}
    want = {0: "supplier_ingredient", 1: "supplier", 2: "ingredient", 3: "global", 4: "global", 5: "global"}
    rows = {r.line: r for r in got.collect()}
    assert len(rows) == len(lines) and without.count() == 0
    for line, *_, day, shelf, u in lines:
        r, pool = rows[line], pools[want[line // 10]]
        assert (r.source, r.n_observed, r.lead) == (want[line // 10], len(pool), pool[min(len(pool) - 1, int(u * len(pool)))])
        assert r.arrival_date == day + dt.timedelta(r.lead) and r.expiry_date == (None if shelf is None else r.arrival_date + dt.timedelta(shelf))
        assert r.arrival_condition == ("arrived_expired_realization" if shelf == -1 else "normal")
    none, all_ = DR.realise_supply(spark.createDataFrame(lines, LINES), spark.createDataFrame(seen, SEEN), F.col("u"), 100)
    assert none.count() == 0 and {r.issue for r in all_.collect()} == {DR.INSUFFICIENT} and all_.count() == len(lines)
    assert DR.realise_supply(spark.createDataFrame([], LINES), spark.createDataFrame(seen, SEEN), F.col("u"))[0].count() == 0


def test_ranks_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(DR, "WIDTH", 4)
    values = [float(i // 3) for i in range(40)] + [99.0] * 30
    seen = spark.createDataFrame([(v,) for v in values], "lead double")
    lines = spark.createDataFrame([(i, (i + 0.5) / 70) for i in range(70)], "line int, u double")
    drawn, _ = DR.draw(lines, seen, [("global", [])], "lead", F.col("u"))
    assert {r.line: r.lead for r in drawn.collect()} == dict(enumerate(sorted(values)))


def test_orders_that_cannot_be_used(spark):
    orders = [("s", "i", D(2026, 1, 1), D(2026, 1, 4)), ("s", "i", D(2026, 1, 5), D(2026, 1, 4)), ("s", "i", None, D(2026, 1, 4)), ("s", "i", D(2026, 1, 1), D(2030, 1, 1))]
    seen, away = DR.observed_lead_times(spark.createDataFrame(orders, "supplier_id string, ingredient_id string, order_date date, arrival_date date"), F.lit(D(2026, 6, 1)))
    assert [r.lead for r in seen.collect()] == [3] and sorted(r.issue for r in away.collect()) == ["DATES_MISSING", "LEAD_TIME_NEGATIVE"]


def test_counted_observations_and_lines_copied_last(spark):
    """Observations with their numbers, and each line drawn in several worlds, give what rows written out give; the lines are joined once."""
    seen = [("s", "i", d) for d in (5, 1, 3, 3, 3)] + [("t", "i", 7)]
    counted = spark.createDataFrame([("s", "i", 5, 1), ("s", "i", 1, 1), ("s", "i", 3, 3), ("t", "i", 7, 1)], SEEN + ", n int")
    lines = [(k, who, "i", D(2026, 1, 1), None, 0.1 * k) for k, who in enumerate("sstx")]
    plain = spark.createDataFrame(lines, LINES)
    copies = [(r, w) for r in lines for w in range(3)]
    want, _ = DR.realise_supply(spark.createDataFrame([(*r[:5], (r[5] + 0.3 * w) % 1, w) for r, w in copies], LINES + ", scenario_id long"), spark.createDataFrame(seen, SEEN), F.col("u"), 3)
    got, without = DR.realise_supply(plain, counted, lambda w: (F.col("u") + 0.3 * w) % 1, 3, count="n", asked=plain, worlds=range(3), dealt=["supplier_id"])
    of = lambda df: sorted((r.line, r.scenario_id, r.source, r.n_observed, r.lead, r.arrival_date) for r in df.collect())
    assert of(got) == of(want) and len(of(got)) == len(copies) and without.count() == 0
