"""All folds fitted in one pass against a loop over the folds."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrain.operators import evaluate as E

START = dt.date(2026, 1, 1)
ROWS = "store_key string, product_key string, horizon int, cutoff_date date, target_date date, target double, anchor double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for t in range(120):
        for h in (1, 2):
            for s, p in (("S", "a"), ("S", "b"), ("T", "a")):
                if p == "b" and t % 9:
                    continue  # too few rows of its own
                target = None if r.random() < 0.05 else float(r.randint(0, 30))
                out.append((s, p, h, START + dt.timedelta(t - h), START + dt.timedelta(t), target, None if r.random() < 0.02 else float(r.randint(0, 30))))
    return out


def test_folds_in_one_pass(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    folds = E.walk_forward_folds(df)
    bounds = {f.fold_id: f for f in folds.collect()}
    assert len(bounds) == 3
    got = {(q.level, q.fold_id, q.store_key, q.product_key, q.horizon): (q.n, q.q25, q.q50, q.q75) for q in E.fold_quantiles(df, folds).collect()}
    want = {}
    for k, f in bounds.items():
        groups = {}
        for s, p, h, _, d, y, a in rows:
            if d <= f.train_end and y is not None and a is not None:
                for key in (("series", k, s, p, h), ("horizon", k, "", "", h), ("all", k, "", "", -1)):
                    groups.setdefault(key, []).append(y - a)
        want |= {key: (len(v), *np.percentile(v, (25, 50, 75))) for key, v in groups.items() if len(v) >= 20}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len({got["all", k, "", "", -1] for k in bounds}) == 3 and not any(k[3] == "b" for k in got)
    out = E.fold_forecasts(df.where("target is not null and anchor is not null"), folds).collect()
    for r in out:
        f = bounds[r.fold_id]
        assert f.validation_start <= r.target_date <= f.validation_end and r.cutoff_date >= f.train_end
        key = ("horizon", r.fold_id, "", "", r.horizon) if r.product_key == "b" else ("series", r.fold_id, r.store_key, r.product_key, r.horizon)
        assert r.level == key[0] and (r.p25, r.p50, r.p75) == pytest.approx([max(0.0, r.anchor + q) for q in want[key][1:]])


def test_audit_and_what_later_days_cannot_change(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    folds = E.walk_forward_folds(df)
    audit = {a.fold_id: a for a in E.fold_audit(df, folds, {"no_target": F.col("target").isNull()}).collect()}
    for f in folds.collect():
        own = [r for r in rows if f.validation_start <= r[4] <= f.validation_end]
        early, empty = [r[3] < f.train_end for r in own], [r[5] is None for r in own]
        a = audit[f.fold_id]
        assert (a.n_candidates, a.n_origin_too_early, a.n_no_target, a.n_eligible) == (len(own), sum(early), sum(empty), sum(not x and not y for x, y in zip(early, empty)))
    last = max(folds.collect(), key=lambda f: f.fold_id).train_end
    changed = df.withColumn("target", F.when(F.col("target_date") > last, 999.0).otherwise(F.col("target")))
    key = lambda x: sorted(map(tuple, E.fold_quantiles(x, folds).collect()))
    assert key(df) == key(changed)
    assert E.fold_quantiles(df.limit(0), folds).count() == 0 and E.fold_forecasts(df.limit(0), folds).count() == 0
