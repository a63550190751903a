"""Hand-made cases for the planning operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrain.functions import text as X
from tidegrain.operators import bom, checks, clean, evaluate, evidence, forecast, inventory, panel, review, revise, scenarios, supply
from tidegrain.sources import files

D = dt.date


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_numbers_dates_booleans(spark):
    t = F.col("t")
    assert values(spark, ["1.234,5", "1,234.5", "2,5", "1,234", "1.234", "bad", "", None, " 3 "], X.parse_number(t)) == [1234.5, 1234.5, 2.5, None, None, None, None, None, 3.0]
    assert values(spark, ["1,234", "1.2.3", "bad", "2,5", ""], X.number_issue(t)) == ["NUMBER_SEPARATOR_AMBIGUOUS", "NUMBER_SEPARATOR_AMBIGUOUS", "NUMBER_INVALID", None, None]
    assert values(spark, ["2026-08-12", "31/12/2026", "12/31/2026", "01/02/2026", "x", None], X.parse_date(t)) == [D(2026, 8, 12), D(2026, 12, 31), D(2026, 12, 31), None, None, None]
    assert values(spark, ["01/02/2026"], X.parse_date(t, "DMY")) == [D(2026, 2, 1)] and values(spark, ["01/02/2026"], X.parse_date(t, "MDY")) == [D(2026, 1, 2)]
    assert values(spark, ["Có", "no", "?", None], X.parse_boolean(t)) == [True, False, None, None]
    assert values(spark, ["Cà phê  Sữa đá!", None], X.text_key(t)) == ["ca_phe_sua_a", ""] and values(spark, ["Sữa đá"], X.entity_key(t)) == ["sua da"]
    assert values(spark, ["thứ 2, 4; CN", "x"], X.parse_weekdays(t)) == [[0, 2, 6], None]
    assert values(spark, ["Cà-phê a.b a.b"], X.tokens(t)) == [["cà-phê", "a.b"]]
    assert values(spark, ["=1+1", "ok"], X.guard_formula(t)) == ["'=1+1", "ok"]


def test_point_in_time_and_weather(spark):
    days = spark.createDataFrame([(D(2026, 10, 4), 31.0, 3.0, k, D(2026, 10, 2), a, False, False) for k, a in (("forecast", D(2026, 10, 5)),)], "date date, temperature double, rainfall double, weather_kind string, weather_issued_at date, weather_available_at date, is_holiday boolean, is_store_closed boolean")
    rows = spark.createDataFrame([(D(2026, 10, 3), D(2026, 10, 4))], "cutoff_date date, target_date date")
    ask = lambda c: panel.add_target_calendar(rows, c).first().target_temperature
    assert ask(days) is None
    assert ask(days.withColumn("weather_available_at", F.lit(D(2026, 10, 3)))) == 31.0
    assert ask(days.withColumn("weather_available_at", F.lit(D(2026, 10, 3))).withColumn("weather_kind", F.lit("realized"))) is None


def series(spark, n=60, future=0.0):
    start = D(2026, 1, 1)
    rows = [(start + dt.timedelta(i), "S", "P", float(i) + (future if i > 39 else 0.0), 1.0, False, "kg") for i in range(n)]
    return spark.createDataFrame(rows, "date date, store_key string, product_key string, quantity_sold double, revenue double, is_stockout boolean, unit string")


def test_features_do_not_see_the_future(spark):
    calendar = spark.createDataFrame([], "date date, is_holiday boolean, is_store_closed boolean")
    made = [panel.training_rows(panel.add_history(panel.reconstruct(panel.daily_panel(series(spark, future=f), calendar)))).where("cutoff_date = DATE '2026-02-09' AND horizon = 3").drop("target").collect() for f in (0.0, 1000.0)]
    assert made[0] == made[1] and made[0][0].seasonal_lag_7_target == 35.0


def test_reconstruction_and_ladder(spark):
    rows = series(spark, 40).withColumn("quantity_sold", F.when(F.col("date") == D(2026, 2, 9), 1.0).otherwise(10.0)).withColumn("is_stockout", F.when(F.col("date") == D(2026, 2, 8), None).otherwise(F.col("date") == D(2026, 2, 9)))
    calendar = spark.createDataFrame([(D(2026, 1, 5), False, True)], "date date, is_holiday boolean, is_store_closed boolean")
    got = {r.date: r for r in panel.reconstruct(panel.daily_panel(rows.where("date <> DATE '2026-01-20'"), calendar)).collect()}
    assert got[D(2026, 2, 9)].demand_proxy == 10.0 and got[D(2026, 2, 9)].target_quality == "stockout_reconstructed"
    assert got[D(2026, 2, 8)].target_quality == "stockout_unknown" and got[D(2026, 1, 20)].target_quality == "missing_open_day"
    assert got[D(2026, 1, 5)].target_quality == "store_closed" and got[D(2026, 1, 5)].quantity_sold is None


def test_conformal_order_statistic(spark):
    scores = spark.createDataFrame([(1, 0.0, 0.0, 0.0, float(i)) for i in range(20)], "horizon int, p25 double, p50 double, p75 double, target double")
    got = {r.horizon: r for r in forecast.fit_cqr(scores, 0.5, 10).collect()}
    assert got[None].correction == 10.0 and got[None].level == 11 / 20 and got[1].correction == 10.0
    assert forecast.fit_cqr(scores.limit(1), 0.9, 1).where("horizon IS NULL").first().correction is None


def test_split_purge(spark):
    rows = spark.sql("SELECT d AS target_date, h AS horizon, date_sub(d, h) AS cutoff_date FROM (SELECT explode(sequence(DATE '2026-01-01', DATE '2026-08-11')) AS d) CROSS JOIN (SELECT explode(sequence(1, 7)) AS h)")
    got = {r.split: r.n for r in evaluate.final_split(rows).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got["calibration_purged"] == 21 and got["test_purged"] == 21
    folds = evaluate.walk_forward_folds(rows).collect()
    assert len(folds) == 3 and all((f.validation_start - f.train_end).days == 1 for f in folds)


def test_quantile_repair_and_metrics(spark):
    rows = spark.createDataFrame([(3.0, 1.0, -2.0, 2.0, 1), (1.0, 2.0, 3.0, 4.0, 2)], "p25 double, p50 double, p75 double, target double, horizon int")
    got = rows.select(*forecast.repair()).collect()
    assert (got[0].p25, got[0].p50, got[0].p75, got[0].crossed) == (0.0, 1.0, 3.0, True)
    m = {r.horizon: r for r in evaluate.overall_and_by(rows, ["horizon"], evaluate.quantile_metrics()).collect()}
    assert m[None].n == 2 and m[None].wape == 3.0 / 6.0 and m[1].crossing_rate == 1.0


def test_units(spark):
    r = spark.createDataFrame([("flour", "bag", "kg", 25.0), ("flour", "kg", "g", 1000.0)], "ingredient_id string, from_unit string, to_unit string, factor double")
    got = {(x.from_unit, x.to_unit): (x.factor, x.hops) for x in bom.unit_closure(r).collect()}
    assert got[("bag", "g")] == (25000.0, 2) and abs(got[("g", "bag")][0] - 1 / 25000) < 1e-12
    one = spark.range(1).select(bom.builtin_factor(F.lit("g"), F.lit("kg")).alias("a"), bom.builtin_factor(F.lit("g"), F.lit("ml")).alias("b")).first()
    assert (one.a, one.b) == (0.001, None)


LOTS = "store_key string, ingredient_id string, lot_id string, quantity double, received_date date, expiry_date date"


def test_day_allocation_and_ledger(spark):
    stock = spark.createDataFrame([("S", "I", "a", 5.0, D(2026, 1, 1), D(2026, 1, 2)), ("S", "I", "b", 5.0, D(2026, 1, 1), None)], LOTS)
    demand = spark.createDataFrame([("S", "I", 6.0)], "store_key string, ingredient_id string, demand double")
    used = {r.lot_id: r.used for r in inventory.allocate_day(stock, demand, inventory.KEY).collect()}
    assert used == {"a": 5.0, "b": 1.0}
    days = spark.createDataFrame([("S", "I", D(2026, 1, 1) + dt.timedelta(i), d) for i, d in enumerate((2.0, 1.0, 1.0, 9.0))], "store_key string, ingredient_id string, date date, demand double")
    coming = spark.createDataFrame([("S", "I", "c", 4.0, D(2026, 1, 4), D(2026, 1, 9), D(2026, 1, 4))], LOTS + ", arrival_date date")
    lines = inventory.ledger(stock, days, coming, inventory.KEY)
    got = [(r.beginning, r.inbound, r.expired, r.fulfilled, r.ending, r.shortage) for r in lines.orderBy("date").collect()]
    assert got == [(10.0, 0.0, 0.0, 2.0, 8.0, 0.0), (8.0, 0.0, 0.0, 1.0, 7.0, 0.0), (7.0, 0.0, 2.0, 1.0, 4.0, 0.0), (4.0, 4.0, 0.0, 8.0, 0.0, 1.0)]
    assert inventory.unbalanced(lines).count() == 0
    s = inventory.summarize(lines, inventory.KEY).first()
    assert s.first_stockout == D(2026, 1, 4) and abs(s.fill_rate - 12 / 13) < 1e-12


def test_ledger_folds_pairs_of_dates_and_not_lots(spark):
    rows = [("S", "I", f"l{i}", 0.5 + i % 3, D(2026, 1, 1), D(2026, 1, 3) if i % 2 else None) for i in range(400)]
    coming = spark.createDataFrame([(*r[:2], f"c{r[2]}", r[3], D(2026, 1, 2), r[5], D(2026, 1, 2)) for r in rows], LOTS + ", arrival_date date")
    days = spark.createDataFrame([("S", "I", D(2026, 1, 1) + dt.timedelta(i), d) for i, d in enumerate((150.0, 90.0, 500.0, 70.0))], "store_key string, ingredient_id string, date date, demand double")
    lines = inventory.ledger(spark.createDataFrame(rows, LOTS), days, coming, inventory.KEY)
    left, want, got = {None: 0.0, D(2026, 1, 3): 0.0}, [], [(r.beginning, r.inbound, r.expired, r.fulfilled, r.ending) for r in lines.orderBy("date").collect()]
    for r in rows:
        left[r[5]] += r[3]
    new = dict(left)
    for i, d in enumerate((150.0, 90.0, 500.0, 70.0)):
        beginning, inbound = sum(left.values()), sum(new.values()) if i == 1 else 0.0
        left = {k: v + (new[k] if i == 1 else 0.0) for k, v in left.items()}
        expired = left[D(2026, 1, 3)] if i > 2 else 0.0
        left[D(2026, 1, 3)] -= expired
        first = min(d, left[D(2026, 1, 3)])
        second = min(d - first, left[None])
        left = {None: left[None] - second, D(2026, 1, 3): left[D(2026, 1, 3)] - first}
        want.append((beginning, inbound, expired, first + second, sum(left.values())))
    assert got == want
    merged = inventory.by_dates(spark.createDataFrame(rows, LOTS), inventory.KEY)
    assert merged.count() == 2 and merged.agg(F.sum("quantity")).first()[0] == sum(r[3] for r in rows)


def test_weighted_quantile_and_cvar(spark):
    w = spark.createDataFrame([("k", float(v), 0.25) for v in (1, 2, 3, 10)], "k string, v double, w double")
    assert evaluate.weighted_quantile(w, ["k"], "v", "w", 0.5, "q").first().q == 2.0
    assert abs(evaluate.weighted_cvar(w, ["k"], "v", "w", 0.6, "c").first().c - (0.25 * 10 + 0.15 * 3) / 0.4) < 1e-9


def test_scenarios_are_stable_and_sane(spark):
    f = spark.createDataFrame([("S", f"P{i}", D(2026, 1, 8), 1, 5.0, 10.0, 15.0) for i in range(4)], "store_key string, product_key string, target_date date, horizon int, p25 double, p50 double, p75 double")
    h = spark.createDataFrame([("S", f"P{i}", D(2025, 1, 1) + dt.timedelta(t), 1, ((t * (i + 3)) % 11 - 5) / 5) for i in range(3) for t in range(40)], "store_key string, product_key string, forecast_origin date, horizon int, scaled_residual double")
    a, b = scenarios.bootstrap(f, h, 30, 7), scenarios.bootstrap(f.repartition(3), h.repartition(5), 30, 7)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 120 and a.where("quantity < 0").count() == 0
    c = scenarios.copula(f, h, 200, 7)
    assert c.count() == 600 and 5 < c.agg(F.avg("quantity")).first()[0] < 15
    levels = scenarios.declared_levels(f, [(0.5, 0.5), (1.5, 0.5)], 100, 1).groupBy("scenario_id").agg(F.countDistinct("quantity").alias("n"))
    assert levels.where("n > 1").count() == 0
    assert spark.range(1).select(scenarios.normal_cdf(F.lit(1.96)).alias("p")).first().p == pytest.approx(0.975, abs=1e-4)


def test_supply(spark):
    o = spark.range(1).select(F.lit(D(2026, 8, 12)).alias("d"))  # a Wednesday
    days, holidays = F.array(F.lit(4)), F.array(F.lit(D(2026, 8, 14)))
    at = lambda m, t=0: o.select(supply.resolve_arrival(F.col("d"), F.lit(1), days, holidays, m, t).alias("x")).first().x
    assert at("RECEIVING") == D(2026, 8, 21) and at("DISPATCH", 2) == D(2026, 8, 23) and at("ORDER") is None
    working = o.select(supply.add_working_days(F.col("d"), F.lit(3), F.array(*[F.lit(i) for i in range(5)]), holidays).alias("x")).first().x
    assert working == D(2026, 8, 18)
    fees = supply.split_fee(spark.createDataFrame([("g", i, 10.0) for i in range(3)], "g string, i int, fee double"), ["g"], "fee", "i").orderBy("i").collect()
    assert [r.fee_share for r in fees] == [3.33, 3.33, 3.34]


def test_revisions(spark):
    old = spark.createDataFrame([("S", 1, 1.0), ("S", 2, 2.0)], "store string, k int, v double")
    same, changed = spark.createDataFrame([("S", 1, 1.0)], old.schema), spark.createDataFrame([("S", 2, 20.0)], old.schema)
    assert revise.append(old, same, ["store", "k"]).count() == 2
    with pytest.raises(checks.DataRefused):
        revise.append(old, changed, ["store", "k"])
    assert {r.k: r.v for r in revise.upsert(old, changed, ["store", "k"]).collect()} == {1: 1.0, 2: 20.0}
    assert revise.replace_scope(old, changed, F.col("store") == "S").count() == 1
    with pytest.raises(checks.DataRefused):
        revise.replace_scope(old, changed, F.col("store") == "T")
    assert revise.import_once(old, changed, ["store", "k"]).count() == 1


def test_files_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("d", T.DateType(), False), T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame([(D(2026, 1, 1), None), (D(2026, 1, 2), 2.5)], schema)
    files.write_canonical(df, str(tmp_path / "t"))
    assert sorted(files.read_canonical(spark, str(tmp_path / "t"), schema, ["d"]).collect()) == sorted(df.collect())
    (tmp_path / "bad.csv").write_text("d,x\n2026-01-01,oops\n")
    with pytest.raises(checks.DataRefused):
        files.read_canonical(spark, str(tmp_path / "bad.csv"), schema, ["d"])
    (tmp_path / "s.csv").write_text("a;b\n1;2\n")
    assert files.delimiter_of(spark, str(tmp_path / "s.csv")) == ";"
    found = files.inventory(spark, str(tmp_path), "*.csv")
    assert files.verify(files.manifest(found, "x"), files.manifest(found, "x")).count() == 0


def test_quarantine_and_totals(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], "row_id int, product_key string, quantity_sold double").withColumn("date", F.lit(D(2026, 1, 1)))
    good, away = clean.quarantine(df, clean.fatal_rules())
    assert good.count() == 1 and away.first().issues == ["null_product", "null_quantity"]
    t = spark.createDataFrame([(" Total ",), ("x",), (None,)], "k string")
    assert clean.drop_totals(t, "k").count() == 2


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "shortage in S1", "RISK")], "query_id int, query string, wanted_type string")
    e = spark.createDataFrame([("a", "RISK", "shortage s1"), ("b", "ORDER", "shortage"), ("c", "RISK", "other")], "evidence_id string, evidence_type string, text string")
    edges = spark.createDataFrame([("a", "c")], "source_id string, target_id string")
    got = [(r.evidence_id, r.score) for r in evidence.structured(q, e, edges, 5).orderBy("rank").collect()]
    assert got == [("a", 14.0), ("b", 2.0), ("c", 0.5)]
    gold = spark.createDataFrame([(1, "b")], "query_id int, evidence_id string")
    m = evidence.ranking_metrics(evidence.lexical(q, e, 5), gold).first()
    assert m.recall_1 == 0.0 and m.recall_3 == 1.0 and m.reciprocal_rank == 0.5


def test_holt_winters_equals_a_plain_loop(spark):
    import math

    ys = [20 + i * 0.3 + 5 * math.sin(i * 2 * math.pi / 7) for i in range(40)]
    rows = spark.createDataFrame([("S", "P", D(2026, 1, 1) + dt.timedelta(i), y) for i, y in enumerate(ys)], "store_key string, product_key string, date date, y double")
    best = None
    for a, b, g in forecast.GRID:
        m1, m2 = sum(ys[:7]) / 7, sum(ys[7:14]) / 7
        level, trend, season, sse = m1, (m2 - m1) / 7, [y - m1 for y in ys[:7]], 0.0
        for y in ys:
            old = season.pop(0)
            sse += (y - level - trend - old) ** 2
            new = a * (y - old) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season.append(g * (y - new) + (1 - g) * old)
            level = new
        path = [max(0.0, level + h * trend + season[h - 1]) for h in range(1, 8)]
        best = min(best, (sse, path)) if best else (sse, path)
    got = [r.prediction for r in forecast.holt_winters(rows).orderBy("horizon").collect()]
    assert got == pytest.approx(best[1])


def test_block_bootstrap(spark):
    rows = spark.createDataFrame([(D(2026, 1, 1) + dt.timedelta(i), 10.0, 9.0, 13.0, 5.0, 15.0 if i % 2 else 8.0) for i in range(30)], "target_date date, target double, good double, poor double, interval_lower double, interval_upper double")
    plan = evaluate.block_plan(rows, 7, 50, 3)
    per = plan.groupBy("replication").count().collect()
    assert len(per) == 50 and {r["count"] for r in per} == {30}
    w = evaluate.paired_wape(rows, plan, "good", ["poor"]).first()
    assert w.high == pytest.approx(-0.2) and w.low == pytest.approx(-0.2)
    c = evaluate.interval_bootstrap(rows, plan).first()
    assert c.n == 50 and 0.4 < c.low <= c.high < 0.6


IMPORT = "k int, v double, at int"


def run_imports(spark, tmp_path, batches, rules, order=None):
    from tidegrain.streaming.imports import import_stream

    for i, rows in enumerate(batches):
        if rows is not None:
            spark.createDataFrame(rows, IMPORT).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{len(list((tmp_path / 'in').glob('*'))) if (tmp_path / 'in').exists() else 0}"))
        stream = spark.readStream.schema(IMPORT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        import_stream(stream, str(tmp_path / "table"), ["k"], rules, str(tmp_path / "check"), order).awaitTermination(120)


def test_import_stream(spark, tmp_path):
    from tidegrain.streaming.imports import compact, current, finished

    rules = {"negative": F.col("v") < 0, "huge": F.col("v") > 100}
    table = lambda: {r.k: r.v for r in current(spark, str(tmp_path / "table"), ["k"]).collect()}
    run_imports(spark, tmp_path, [[(1, 1.0, 0), (2, -1.0, 0), (2, 7.0, 1), (2, float("inf"), 2), (None, 3.0, 0), (None, 3.0, 0)]], rules)
    assert table() == {1: 1.0, 2: 7.0}  # a bad row of a key does not hide the good one
    away = spark.read.parquet(str(tmp_path / "table" / "quarantine"))
    assert away.count() == 4 and sorted(c for r in away.collect() for c in r.issues) == ["KEY_MISSING", "KEY_MISSING", "huge", "negative"]
    run_imports(spark, tmp_path, [None, [(1, 5.0, 0), (3, 3.0, 0)], None], rules)  # nothing new, something, nothing new
    assert table() == {1: 5.0, 2: 7.0, 3: 3.0} and finished(spark, str(tmp_path / "table" / "changes")) == [0, 1]
    assert compact(spark, str(tmp_path / "table"), ["k"]) == compact(spark, str(tmp_path / "table"), ["k"]) == 1
    run_imports(spark, tmp_path, [[(2, 8.0, 0), (4, -4.0, 0)]], rules)
    assert table() == {1: 5.0, 2: 8.0, 3: 3.0}


def test_import_stream_orders_rows_of_a_batch(spark, tmp_path):
    from tidegrain.streaming.imports import current, last_of_batch

    run_imports(spark, tmp_path, [[(1, 9.0, 1), (1, 2.0, 5), (2, 1.0, 3), (2, 4.0, 3)]], {}, ["at"])
    assert {r.k: r.v for r in current(spark, str(tmp_path / "table"), ["k"]).collect()} == {1: 2.0, 2: 4.0}
    assert last_of_batch(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).count() == 1
    with pytest.raises(checks.DataRefused):
        current(spark, str(tmp_path / "none"), ["k"])


def test_registered_queries_have_matching_sql():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 150


def test_sql_twins_are_texts():
    import __spark_entry__ as entry

    assert all(isinstance(text, str) for text in entry.oracle_sql().values())


def test_short_series_get_the_seasonal_naive(spark):
    rows = [("S", k, D(2026, 1, 1) + dt.timedelta(i), float(i)) for k, n in (("nine", 9), ("three", 3), ("long", 20)) for i in range(n)]
    got = forecast.holt_winters(spark.createDataFrame(rows, "store_key string, product_key string, date date, y double")).collect()
    path = lambda k: [r.prediction for r in sorted(got, key=lambda r: r.horizon) if r.product_key == k]
    assert path("nine") == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0] and path("three") == [1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 2.0] and len(path("long")) == 7


def test_no_forecast_row_is_lost_to_sparse_residuals(spark):
    f = spark.createDataFrame([(s, p, D(2026, 1, 8), 1, 5.0, 10.0, 15.0) for s, p in (("S", "rich"), ("S", "few"), ("S", "none"), ("T", "new"))], "store_key string, product_key string, target_date date, horizon int, p25 double, p50 double, p75 double")
    h = spark.createDataFrame([("S", p, D(2025, 1, 1) + dt.timedelta(t), 1, (t % 11 - 5) / 5) for p, n in (("rich", 40), ("few", 5)) for t in range(n)], "store_key string, product_key string, forecast_origin date, horizon int, scaled_residual double")
    got = scenarios.copula_or_bootstrap(f, h, 10, 7)
    assert {r.product_key: r["count"] for r in got.groupBy("product_key").count().collect()} == {"rich": 10, "few": 10, "none": 10, "new": 10}


def test_every_order_line_gets_a_lead_time(spark):
    from tidegrain.plans import QUERIES

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert QUERIES["supply_realisation"](spark, "/root/testdata/sf0.001").count() == 5 * lines


def test_intents_by_phrases_of_each_group(spark):
    asked = ["What IF demand drops", "the forecast evidence is missing", "forecast evidence please", "did the critic pass", "Lô nào hết hạn", "lots of shortage", "cần mua bao nhiêu", None]
    assert values(spark, asked, X.intent(F.col("t"))) == ["what_if", "forecast_availability", "generic", "recommendation", "lot_expiry", "stockout", "immediate_order", "generic"]


def test_longest_name_is_mentioned(spark):
    items = spark.createDataFrame([(1, "Blue cheese pizza, and blue cheese."), (2, "cheeses blue"), (3, None)], "doc_id int, text string")
    names = spark.createDataFrame([("blue",), ("blue cheese",), ("cheese pizza",), ("pizza and",), ("blue",)], "name string")
    assert [tuple(r) for r in evidence.mentions(items, names, "doc_id").orderBy("doc_id").collect()] == [(1, "cheese pizza", 4), (2, "blue", 1)]


def test_checkpoint_and_parquet_budget_refuse(spark, tmp_path):
    good = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, 0.0)], "k int, low double, high double")
    path = str(tmp_path / "stage")
    files.write_checkpoint(good, path, ["k"], ["low", "high"], ["low", "high"])
    assert files.read_parquet(spark, path, 2, 3).count() == 2
    for rows in ([(1, 1.0, 2.0), (1, 1.0, 2.0)], [(1, -1.0, 2.0)], [(1, float("nan"), 2.0)], [(1, 3.0, 2.0)], [(1, None, 2.0)]):
        with pytest.raises(checks.DataRefused):
            files.write_checkpoint(spark.createDataFrame(rows, good.schema), path, ["k"], ["low", "high"], ["low", "high"])
    assert spark.read.parquet(path).count() == 2
    for rows, columns in ((1, 3), (2, 2)):
        with pytest.raises(checks.DataRefused):
            files.read_parquet(spark, path, rows, columns)


def test_rules_by_semantics(spark):
    d = [D(2026, 1, 1), D(2026, 1, 2)]
    ledger = spark.createDataFrame(
        [(w, p, "S", k, day, 10.0, s, m, e) for w, p, s in (("a", 0.25, 0.0), ("b", 0.75, 4.0)) for k, m, e in (("milk", 8.0, 2.0), ("tea", 5.0, 7.0)) for day in d],
        "scenario_id string, weight double, store_key string, ingredient_id string, date date, demand double, shortage double, maximum double, ending double",
    )
    orders = spark.createDataFrame([("S", "milk", "o1", d[0], 30.0, 5), ("S", "milk", "o2", d[0], 20.0, None), ("S", "tea", "o3", d[0], 6.0, 9)], "store_key string, ingredient_id string, offer_id string, arrival_date date, quantity double, shelf_life_days int")
    rules = spark.createDataFrame(
        [("peak", "S", None, "RECEIVING_PEAK", "HARD", 12.0, 1.0, d[1], None, None), ("liters", "S", None, "GLOBAL_RECEIVING_PEAK", "SOFT", 20.0, 1.0, None, None, None), ("least", "S", "milk", "END_OF_DAY_MIN", "SOFT", 3.0, 2.0, None, d[0], None),
         ("most", "S", "tea", "END_OF_DAY_MAX", "HARD", 7.0, 1.0, None, None, None), ("fill", "S", None, "PER_KEY_EXPECTED_FILL", "HARD", 0.9, 1.0, None, None, None), ("cover", "S", "milk", "PURCHASE_COVER_DAYS", "SOFT", 4.0, 1.0, None, None, 10.0),
         ("none", "S", "tea", "PURCHASE_COVER_DAYS", "HARD", 4.0, 1.0, None, None, 0.0), ("life", "S", "milk", "MIN_REMAINING_LIFE_AT_RECEIVING", "HARD", 3.0, 1.0, None, None, None), ("other", "T", None, "RECEIVING_PEAK", "HARD", 0.0, 1.0, None, None, None)],
        "rule_id string, store_key string, ingredient_id string, semantics string, classification string, target double, penalty double, effective_from date, effective_to date, reference_daily double",
    )
    liters = spark.createDataFrame([("milk", 1.0), ("tea", 3.0)], "ingredient_id string, liters double")
    got = {r.rule_id: r for r in review.evaluate_rules(rules, review.rule_observations(rules, ledger, orders, liters)).collect()}
    say = {k: (r.status, round(r.maximum_violation, 6), round(r.weighted_violation, 6), r.n) for k, r in got.items()}
    assert say == {
        "peak": ("FAIL", 1.0, 1.0, 2), "liters": ("TARGET_MISS", 3.0, 6.0, 4), "least": ("TARGET_MISS", 1.0, 1.0, 2), "most": ("PASS", 0.0, 0.0, 4), "fill": ("FAIL", 0.2, 0.4, 2),
        "cover": ("TARGET_MISS", 1.0, 1.0, 1), "none": ("FAIL", 6.0, 6.0, 1), "life": ("FAIL", 4.0, 4.0, 2), "other": ("PASS", 0.0, 0.0, 0),
    }
    assert got["life"].worst == ["o2", "o1"] and got["least"].penalty == 2.0 and got["other"].worst == [] and got["none"].maximum_observed is None
    with pytest.raises(checks.DataRefused):
        review.rule_observations(rules, ledger, orders, liters.where("ingredient_id = 'tea'"))


def test_gates_and_selectors(spark):
    metrics = spark.createDataFrame([("recall", 0.9, 5), ("errors", 0.0, 5), ("empty", None, 0)], "metric_name string, value double, n long")
    targets = spark.createDataFrame([("recall", "gte", 0.9), ("errors", "eq", 0.0), ("recall", "lte", 0.5), ("empty", "gte", 0.0), ("absent", "lte", 1.0)], "metric_name string, operator string, target double")
    got = {(r.metric_name, r.operator): (r.passed, r.note) for r in review.gates(metrics, targets).collect()}
    assert got == {("recall", "gte"): (True, None), ("errors", "eq"): (True, None), ("recall", "lte"): (False, None), ("empty", "gte"): (False, "NOT_APPLICABLE"), ("absent", "lte"): (False, "NOT_APPLICABLE")}
    evidence_rows = spark.createDataFrame([("e1", "SALES", {"store": "S1"}, "m1/a", '{"q":5,"u":"kg"}'), ("e2", "SALES", {"product": "P"}, "m1/b", '{"q":"many","u":"kg"}'), ("e3", "OFFER", {"store": "S1"}, None, None)], "evidence_id string, evidence_type string, entities map<string,string>, source_path string, payload string")
    selectors = spark.createDataFrame(
        [("strict", "SALES", {"store": "S1"}, False, "m1/", {"u": "kg"}, None, 1, 1), ("loose", "SALES", {"store": "S1"}, True, None, None, None, 1, 1), ("number", "SALES", None, True, None, None, {"q": 4.0}, 1, None), ("none", "OFFER", None, True, "m5/", None, None, 1, None), ("bare", "OFFER", {}, True, None, None, None, 0, 1)],
        "selector_id string, evidence_type string, entities map<string,string>, allow_missing boolean, path_prefix string, payload_equals map<string,string>, payload_greater map<string,double>, minimum long, maximum long",
    )
    matches = review.selected(selectors, evidence_rows)
    assert sorted(tuple(r) for r in matches.collect()) == [("bare", "e3"), ("loose", "e1"), ("loose", "e2"), ("number", "e1"), ("strict", "e1")]
    assert {r.selector_id: (r.n, r.issue) for r in review.selector_report(selectors, matches).collect()} == {"strict": (1, None), "loose": (2, "AMBIGUOUS"), "number": (1, None), "none": (0, "TOO_FEW"), "bare": (1, None)}


def test_edits_are_guarded(spark):
    demand = spark.createDataFrame([("S1", "a", 1.0), ("S1", "b", 2.0), ("S2", "a", 4.0), (None, "a", 8.0)], "store_key string, ingredient_id string, quantity double")
    scope = ["store_key", "ingredient_id"]
    scaled = review.scale_demand(demand, [{"store_key": "S1", "multiplier": 3, "expected_matches": 2}, {"store_key": "S2", "ingredient_id": "a", "multiplier": 0.5}], scope)
    assert sorted(r.quantity for r in scaled.collect()) == [2.0, 3.0, 6.0, 8.0]
    assert review.scale_demand(demand, [], scope).count() == 4
    for edits in ([{"store_key": "S1", "multiplier": 2}, {"ingredient_id": "a", "multiplier": 2}], [{"store_key": "S9", "multiplier": 2, "expected_matches": 1}], [{"store_key": "S1", "multiplier": 2, "expected_matches": 1}]):
        with pytest.raises(checks.DataRefused):
            review.scale_demand(demand, edits, scope)
    costs = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 5.0), ("y", 3.0, 6.0)], "id string, holding double, waste double")
    patch = lambda rows: review.patch_one_each(costs, spark.createDataFrame(rows, "id string, waste double"), ["id"])
    assert sorted(tuple(r) for r in patch([("x", 9.0)]).collect()) == [("x", 1.0, 9.0), ("y", 2.0, 5.0), ("y", 3.0, 6.0)]
    for rows in ([("y", 1.0)], [("z", 1.0)], [("x", 1.0), ("x", 2.0)]):
        with pytest.raises(checks.DataRefused):
            patch(rows)


def test_critique_of_plans(spark):
    worlds = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "scenario_id string, weight double")
    rows = [("good", "k", w, 0.5, 1.0, 0.0, None, True) for w in "ab"] + [("bad", "k", "a", 0.5, 1.0, 0.0, 2.0, True), ("bad", "k", "b", 0.4, 0.5, 5.0, None, False), ("part", "k", "a", 0.5, 1.0, 0.0, None, True)]
    summary = spark.createDataFrame(rows, "plan string, key string, scenario_id string, weight double, fill_rate double, shortage double, capacity_violation double, accounting_valid boolean")
    profile = {"minimum_acceptable_fill_rate": 0.8, "maximum_stockout_probability": 0.1, "minimum_expected_fill_rate": 0.9}
    ask = lambda p: sorted(tuple(r) for r in review.critique(summary, worlds, p, ["plan"], "key").collect())
    fixed = [("bad", "ACCOUNTING_INVALID"), ("bad", "CAPACITY_CONSEQUENCE"), ("bad", "EVALUATION_SCENARIO_COVERAGE_MISMATCH"), ("part", "EVALUATION_SCENARIO_COVERAGE_MISMATCH")]
    assert ask({}) == fixed
    assert ask(profile) == sorted(fixed + [("bad", "EXACT_SIMULATION_SAFETY_FLOOR"), ("bad", "RISK_CONSTRAINT_VIOLATION"), ("bad", "SERVICE_LEVEL_REQUIREMENT"), ("part", "SERVICE_LEVEL_REQUIREMENT")])
    assert review.critique(summary.limit(0), worlds, profile, ["plan"], "key").count() == 0
    assert [tuple(r) for r in review.world_key_gaps(summary, "scenario_id", ["plan"]).collect()] == [("part", 1)]
    assert [tuple(r) for r in review.key_differences(worlds, summary.where("plan = 'part'"), ["scenario_id"]).collect()] == [("b", "right")]
