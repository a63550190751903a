"""Every family of coherence checks with a planted fault, and nothing where nothing is wrong."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import coherence as C
from tidegrain.operators.checks import DataRefused

D = dt.date
FORECAST = "store string, day date, p50 double, unit string"
LINES = "store string, day date, p50 double, unit string, horizon int"
PAIRS = [
    C.Pair("forecast", "lines", ["store", "day"], [C.only_left("MISSING"), C.only_right("UNKNOWN"), C.differs("VALUE", "p50", tolerance=1e-6), C.differs("UNIT", "unit", severity="WARNING", blocking=False)]),
    C.Pair("lines", "request", [], [C.outside("WINDOW", "day", "first", "last"), C.holds("HORIZON", lambda a, b: a("horizon") == F.datediff(a("day"), b("origin")))]),
]


def make(spark, lines, request=(D(2026, 1, 1), D(2026, 1, 2), D(2026, 1, 9))):
    forecast = [("S", D(2026, 1, d), 10.0 * d, "kg") for d in range(2, 10)] + [(None, D(2026, 1, 2), None, None)]
    return {"forecast": spark.createDataFrame(forecast, FORECAST), "lines": spark.createDataFrame(lines, LINES), "request": spark.createDataFrame([request], "origin date, first date, last date")}


def good():
    return [("S", D(2026, 1, d), 10.0 * d, "kg", d - 1) for d in range(2, 10)] + [(None, D(2026, 1, 2), None, None, 1)]


def found(tables):
    return {(r.code, json.loads(r.key).get("day")) for r in C.check_pairs(tables, PAIRS).collect()}


def test_coherent_artifacts_have_no_issue(spark):
    assert found(make(spark, good())) == set()


@pytest.mark.parametrize(
    "place,change,expected",
    [
        (0, None, {("MISSING", "2026-01-02")}),
        (1, ("S", D(2026, 1, 3), 30.1, "kg", 2), {("VALUE", "2026-01-03")}),
        (1, ("S", D(2026, 1, 3), None, "kg", 2), {("VALUE", "2026-01-03")}),
        (2, ("S", D(2026, 1, 4), 40.0, None, 3), {("UNIT", "2026-01-04")}),
        (3, ("S", D(2026, 1, 5), 50.0, "kg", 9), {("HORIZON", "2026-01-05")}),
        (4, ("S", D(2026, 2, 6), 60.0, "kg", 36), {("MISSING", "2026-01-06"), ("UNKNOWN", "2026-02-06"), ("WINDOW", "2026-02-06")}),
        (8, ("T", D(2026, 1, 2), 1.0, "kg", 1), {("MISSING", "2026-01-02"), ("UNKNOWN", "2026-01-02")}),
    ],
)
def test_planted_faults(spark, place, change, expected):
    lines = good()
    lines[place : place + 1] = [change] if change else []
    assert found(make(spark, lines)) == expected


def test_repeats_totals_and_report(spark):
    lines = spark.createDataFrame(good() + good()[:2], LINES)
    again = C.repeated(lines, "lines", ["store", "day"], "REPEATED")
    assert again.count() == 2
    weights = lambda *w: spark.createDataFrame([(i % 2, x) for i, x in enumerate(w)], "half int, weight double")
    assert C.wrong_total(weights(0.5, 1.0, 0.5), "w", ["half"], "weight", 1.0, "TOTAL").count() == 0
    assert [json.loads(r.key) for r in C.wrong_total(weights(0.5, 1.0, 0.6), "w", ["half"], "weight", 1.0, "TOTAL").collect()] == [{"half": 0}]
    assert C.wrong_total(weights(0.5, None, 0.5), "w", [], "weight", 1.0, "TOTAL").count() == 1
    issues = C.check_pairs(make(spark, good()[1:-3]), PAIRS).unionByName(again)
    rows = {r.code: r for r in C.report(issues).collect()}
    assert rows["MISSING"].n == 4 and rows["MISSING"].paths == ["forecast", "lines"] and rows["MISSING"].blocking
    assert rows["REPEATED"].n == 2 and json.loads(rows["REPEATED"].first_key)["day"] == "2026-01-02"


def test_refusals(spark):
    tables = make(spark, good())
    with pytest.raises(DataRefused):
        C.check_pairs({"lines": tables["lines"]}, PAIRS)
    with pytest.raises(DataRefused):
        C.check_pairs({**tables, "request": tables["request"].limit(0)}, PAIRS)
