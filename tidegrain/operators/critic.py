"""Review of a plan by recomputation: what it claims against what a run of the ledger gives, to the first place where they part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import failed, union_all

# Issue codes: fixed values.
NOT_CLAIMED, NOT_FOUND = "NOT_CLAIMED", "NOT_FOUND"
MODEL_MISMATCH, CAPACITY_NOT_EVALUATED, UNKNOWN_EXPIRY = "CANDIDATE_MODEL_MISMATCH", "CAPACITY_NOT_EVALUATED", "UNKNOWN_EXPIRY"
STRESS_ACCOUNTING, STRESS_SHORTAGE, STRESS_CAPACITY = "STRESS_ACCOUNTING_INVALID", "STRESS_SHORTAGE_OBSERVED", "STRESS_CAPACITY_VIOLATION"
UNWEIGHTED_STOCKOUT, UNWEIGHTED_SERVICE = "UNWEIGHTED_STOCKOUT_PROBABILITY_NOT_EVALUATED", "UNWEIGHTED_SERVICE_PROBABILITY_NOT_EVALUATED"


def apart(claimed: DataFrame, exact: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of two tables with one row a key that differ: keys, differs (columns in order, or that a side lacks the row), gap (the greatest).

    A null differs from any number, and is like a null. ``tolerance`` is absolute, and relative to the greater value.
    """
    a = claimed.select(*keys, F.struct(*columns).alias("a_"))
    b = exact.select(*keys, F.struct(*columns).alias("b_"))
    x, y = (lambda c: F.col(f"a_.{c}")), (lambda c: F.col(f"b_.{c}"))
    size = lambda c: F.abs(x(c) - y(c))
    near = lambda c: F.coalesce(size(c) <= tolerance * F.greatest(F.lit(1.0), F.abs(x(c)), F.abs(y(c))), x(c).isNull() & y(c).isNull())
    both = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    codes = {NOT_CLAIMED: F.col("a_").isNull(), NOT_FOUND: F.col("b_").isNull(), **{c: both & ~near(c) for c in columns}}
    met = a.join(b, keys, "full").withColumn("differs", failed(codes)).where(F.size("differs") > 0)
    gaps = [F.when(both, size(c)).otherwise(F.abs(F.coalesce(x(c), y(c)))) for c in columns]
    return met.select(*keys, "differs", (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("gap"))


def first_divergence(claimed: DataFrame, exact: DataFrame, keys: list[str], order: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key the first place (by ``order``) where two ledgers differ, what differs there, the greatest gap and the number of places."""
    rows = apart(claimed, exact, [*keys, *order], columns, tolerance)
    first = F.min_by(F.struct(*order, "differs"), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("f_"), F.max("gap").alias("greatest_gap"), F.count("*").alias("n")).select(*keys, *[f"f_.{c}" for c in order], "f_.differs", "greatest_gap", "n")


def broken_chain(ledger: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Days of a ledger that do not begin with what the day before left, or do not follow a day: keys, date, issue, gap."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = ledger.select(*keys, "date", "beginning", F.lag("ending").over(w).alias("left_"), F.lag("date").over(w).alias("last_")).where("last_ is not null")
    gap = F.abs(F.col("beginning") - F.col("left_"))
    issue = F.when(F.datediff("date", "last_") != 1, "DAY_MISSING").when(~F.coalesce(gap <= tolerance * F.greatest(F.lit(1.0), F.abs("left_")), F.lit(False)), "CARRY_OVER_MISMATCH")
    return rows.select(*keys, "date", issue.alias("issue"), gap.alias("gap")).where("issue is not null")


def allocation_divergence(claimed: DataFrame, exact: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key the first day on which the lots that a plan says it took from are not those that are due, first expired first out.

    claimed, exact: keys, lot_id, date, kind, quantity, as ``lots.traces`` gives them.
    """
    one = lambda df: df.groupBy(*keys, "lot_id", "date", "kind").agg(F.sum("quantity").alias("quantity"))
    return first_divergence(one(claimed), one(exact), keys, ["date", "lot_id", "kind"], ["quantity"], tolerance)


def model_gaps(predicted: DataFrame, exact: DataFrame, keys: list[str], most_fill: float, most_stockout: float) -> DataFrame:
    """Keys for which a plan's own figures are too hopeful: fill_gap (predicted less exact) and stockout_gap (exact less predicted), issue.

    predicted, exact: keys, fill_rate, p_stockout over the same worlds. A key without prediction is a mismatch as well.
    """
    p = predicted.select(*keys, F.col("fill_rate").alias("pf_"), F.col("p_stockout").alias("ps_"))
    met = exact.select(*keys, "fill_rate", "p_stockout").join(p, keys, "left").withColumn("fill_gap", F.col("pf_") - F.col("fill_rate")).withColumn("stockout_gap", F.col("p_stockout") - F.col("ps_"))
    fine = F.coalesce((F.col("fill_gap") <= most_fill + 1e-9) & (F.col("stockout_gap") <= most_stockout + 1e-9), F.lit(False))
    return met.where(~fine).select(*keys, "fill_gap", "stockout_gap", F.lit(MODEL_MISMATCH).alias("issue"))


def stress_issues(summary: DataFrame, by: list[str]) -> DataFrame:
    """Per plan and code: what a stressed run shows. summary: by, shortage, capacity_violation (null: none), accounting_valid."""
    rows = summary.groupBy(*by).agg(F.bool_and("accounting_valid").alias("books"), F.max("shortage").alias("short"), F.max(F.coalesce("capacity_violation", F.lit(0.0))).alias("over"))
    return rows.select(*by, F.explode(failed({STRESS_ACCOUNTING: ~F.col("books"), STRESS_SHORTAGE: F.col("short") > 0, STRESS_CAPACITY: F.col("over") > 0})).alias("issue"))


def not_evaluated(summary: DataFrame, worlds: DataFrame, limits: DataFrame, profile: dict, by: list[str], keys: list[str], orders: DataFrame | None = None) -> DataFrame:
    """Per plan and code: what could not be judged.

    summary: by, keys, scenario_id, capacity_violation (null: not evaluated). worlds: scenario_id, weight. limits: keys that have a capacity;
    each must have been evaluated in each world of a plan. profile: as in ``review.critique``; what asks for probabilities needs weights.
    orders: by, shelf_life_days: a null is an expiry that is not known.
    """
    unweighted = worlds.agg((F.count_if(F.col("weight").isNull()) > 0).alias("u_"))
    plans = summary.select(*by).distinct().crossJoin(F.broadcast(unweighted))  # one row
    asks = {
        UNWEIGHTED_STOCKOUT: F.lit(profile.get("maximum_stockout_probability") is not None),
        UNWEIGHTED_SERVICE: F.lit(profile.get("minimum_fill_rate") is not None and profile.get("required_fill_rate_probability") is not None),
    }
    weights = plans.select(*by, F.explode(failed({code: asked & F.col("u_") for code, asked in asks.items()})).alias("issue"))
    met = summary.select(*by, *keys, "capacity_violation").join(limits.select(*keys).distinct(), keys, "left_semi")
    seen = met.groupBy(*by, *keys).agg(F.count_if(F.col("capacity_violation").isNull()).alias("none_")).groupBy(*by).agg(F.count("*").alias("n_"), F.sum("none_").alias("none_"))
    wanted = F.broadcast(limits.agg(F.countDistinct(*keys).alias("all_")))  # one row
    lacking = summary.select(*by).distinct().join(seen, by, "left").crossJoin(wanted).where((F.coalesce("n_", F.lit(0)) < F.col("all_")) | (F.coalesce("none_", F.lit(0)) > 0))
    out = [weights, lacking.select(*by, F.lit(CAPACITY_NOT_EVALUATED).alias("issue"))]
    if orders is not None:
        out.append(orders.where("shelf_life_days is null").select(*by, F.lit(UNKNOWN_EXPIRY).alias("issue")).distinct())
    return union_all(out)


def verdict(issues: DataFrame, plans: DataFrame, by: list[str], warnings: Column) -> DataFrame:
    """Per plan: passed, violations and warnings (codes in order). issues: by, issue. ``warnings``: whether an issue is no violation."""
    some = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("issue"))))
    grouped = issues.withColumn("warns_", warnings).groupBy(*by).agg(some(~F.col("warns_")).alias("violations"), some(F.col("warns_")).alias("warnings"))
    none = F.array().cast("array<string>")
    rows = plans.select(*by).distinct().join(grouped, by, "left")
    return rows.select(*by, (F.size(F.coalesce("violations", none)) == 0).alias("passed"), F.coalesce("violations", none).alias("violations"), F.coalesce("warnings", none).alias("warnings"))
