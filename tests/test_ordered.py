"""Exact ranks, quantiles and codes against plain sorting, with hot values, ties and several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import evidence, forecast, ordered, panel


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    hot = [("a", 1.5)] * 400
    return hot + [(r.choice("abc"), round(r.expovariate(1), 2)) for _ in range(600)] + [("d", 9.0), ("a", None), ("e", None)]


def test_ranks_against_sorting(spark, rows):
    ranks = ordered.value_ranks(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v")
    assert ranks.rdd.getNumPartitions() >= 1
    got = {(r.k, r.v): (r.n, r.below, r.place, r.total) for r in ranks.collect()}
    want = {}
    for k in "abcd":
        own = sorted(v for q, v in rows if q == k and v is not None)
        for p, v in enumerate(sorted(set(own))):
            want[k, v] = (own.count(v), own.index(v), p, len(own))
    assert got == want


def test_order_statistics(spark, rows):
    ranks = ordered.value_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    out = ranks.groupBy("k").agg(*[ordered.at_share(s, "v").alias(f"q{i}") for i, s in enumerate(shares)], ordered.at_rank(F.lit(3), "v").alias("third"))
    exact = spark.createDataFrame(rows, "k string, v double").where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    want = {r.k: r.q for r in exact.collect()}
    for r in out.collect():
        own = sorted(v for q, v in rows if q == r.k and v is not None)
        assert [r[f"q{i}"] for i in range(len(shares))] == pytest.approx(want[r.k]) and r.third == (own[2] if len(own) > 2 else None)
    whole = ordered.value_ranks(spark.createDataFrame(rows, "k string, v double"), [], "v").groupBy().agg(ordered.at_share(0.5, "v").alias("m"), F.max("total").alias("n")).first()
    own = sorted(v for _, v in rows if v is not None)
    assert whole.n == len(own) and whole.m == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
    assert ordered.value_ranks(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_codes_and_latency(spark):
    book = panel.category_codes(spark.createDataFrame([(x,) for x in ["b", "a", None, "b", "é", "Z"]], "c string"), "c")
    assert {r.value: r.code for r in book.collect()} == {v: i for i, v in enumerate(sorted(["b", "a", "__MISSING__", "é", "Z"], key=str.encode))}
    r = evidence.latency(spark.createDataFrame([("q", float(i)) for i in range(1, 41)], "k string, v double"), ["k"], "v").first()
    assert (r.n, r.least, r.greatest, r.p50, r.p95_rank) == (40, 1.0, 40.0, 20.5, 39.0) and r.p95 == pytest.approx(38.05)


def test_cqr_takes_the_rank_beyond_coverage(spark):
    rows = [(h, 0.0, 0.0, float(i)) for h, n in ((1, 20), (2, 40)) for i in range(n)]
    got = {r.horizon: (r.correction, r.n) for r in forecast.fit_cqr(spark.createDataFrame(rows, "horizon int, p25 double, p75 double, target double"), 0.5).collect()}
    assert got == {2: (20.0, 40), None: (15.0, 60)}  # 20 rows of horizon 1 are too few; rank 21 of 40, rank 31 of 60
    assert forecast.fit_cqr(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "horizon int, p25 double, p75 double, target double"), 0.9).first().correction is None
