"""Splits, metrics and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.sources.keep import keep

from .checks import union_all
from .ordered import at_share, value_ranks
from .panel import SERIES


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.avg(F.greatest((y - p) * q, (y - p) * (q - 1)))


def wape(y: Column, p: Column) -> Column:
    """Sum of absolute errors over the sum of actuals; null where that is 0."""
    return F.sum(F.abs(y - p)) / F.nullif(F.sum(F.abs(y)), F.lit(0.0))


def quantile_metrics() -> list[Column]:
    y = F.col("target")
    return [
        F.count("*").alias("n"), F.avg(F.abs(y - F.col("p50"))).alias("mae"), F.avg(F.col("p50") - y).alias("bias"), wape(y, F.col("p50")).alias("wape"),
        *[pinball(y, F.col(f"p{k}"), k / 100).alias(f"pinball_{k}") for k in (25, 50, 75)],
        F.avg(((F.col("p25") > F.col("p50")) | (F.col("p50") > F.col("p75"))).cast("double")).alias("crossing_rate"),
    ]


def overall_and_by(df: DataFrame, keys: list[str], metrics: list[Column]) -> DataFrame:
    """The metrics of all rows (key null) and of each key."""
    return df.groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys]).agg(*metrics)


def interval_metrics(coverage: float = 0.5) -> list[Column]:
    inside = (F.col("target") >= F.col("interval_lower")) & (F.col("target") <= F.col("interval_upper"))
    hit = F.avg(inside.cast("double"))
    return [
        F.count("*").alias("n"), hit.alias("coverage"), (hit - coverage).alias("gap"), F.avg(F.col("interval_upper") - F.col("interval_lower")).alias("width"),
        F.count_if(F.col("interval_lower") > F.col("interval_upper")).alias("invalid"), F.count_if((F.col("p50") < F.col("interval_lower")) | (F.col("p50") > F.col("interval_upper"))).alias("excludes_median"),
    ]


def compare_models(df: DataFrame, models: list[str]) -> DataFrame:
    """model, horizon (null: all), wape, mae, bias from one column of predictions per model."""
    long = df.unpivot(["target", "horizon"], models, "model", "prediction")
    return long.groupingSets([[F.col("model")], [F.col("model"), F.col("horizon")]], F.col("model"), F.col("horizon")).agg(
        wape(F.col("target"), F.col("prediction")).alias("wape"), F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("mae"), F.avg(F.col("prediction") - F.col("target")).alias("bias")
    )


def final_split(rows: DataFrame, calibration_days: int = 28, test_days: int = 28) -> DataFrame:
    """Adds ``split``: train, calibration, test by target date from the end; purged where the origin precedes the fit before it."""
    dates = rows.select("target_date").distinct().withColumn("back_", F.row_number().over(Window.orderBy(F.desc("target_date"))))
    ends = dates.agg(F.max(F.when(F.col("back_") > test_days, F.col("target_date"))).alias("calibration_end"), F.max(F.when(F.col("back_") > test_days + calibration_days, F.col("target_date"))).alias("train_end"))
    met = rows.crossJoin(F.broadcast(ends))  # one row
    t = F.col("target_date")
    split = (
        F.when(t <= F.col("train_end"), "train").when((t <= F.col("calibration_end")) & (F.col("cutoff_date") >= F.col("train_end")), "calibration")
        .when(t <= F.col("calibration_end"), "calibration_purged").when(F.col("cutoff_date") >= F.col("calibration_end"), "test").otherwise("test_purged")
    )
    return met.withColumn("split", split).drop("calibration_end", "train_end")


def walk_forward_folds(rows: DataFrame, minimum: int = 84, validation: int = 14, step: int = 14, most: int = 3) -> DataFrame:
    """fold_id, train_end, validation_start, validation_end of the last ``most`` folds over the distinct target dates."""
    w = Window.orderBy("target_date")
    dates = rows.select("target_date").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    starts = dates.where((F.col("i") >= minimum) & ((F.col("i") - minimum) % step == 0)).select((((F.col("i") - minimum) / step).cast("int") + 1).alias("fold_id"), "i", F.least(F.col("i") + validation - 1, F.col("n") - 1).alias("j"), F.col("target_date").alias("validation_start"))
    a, b = dates.select(F.col("i").alias("ia"), F.col("target_date").alias("train_end")), dates.select(F.col("i").alias("ib"), F.col("target_date").alias("validation_end"))
    folds = starts.join(a, F.col("ia") == F.col("i") - 1).join(b, F.col("ib") == F.col("j"))
    return folds.withColumn("last_", F.row_number().over(Window.orderBy(F.desc("fold_id")))).where(F.col("last_") <= most).select("fold_id", "train_end", "validation_start", "validation_end")


def walk_forward_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's validation whose origin is not before the end of its training."""
    bound = F.broadcast(folds)  # a few folds
    return rows.join(bound, (F.col("target_date") >= bound["validation_start"]) & (F.col("target_date") <= bound["validation_end"]) & (F.col("cutoff_date") >= bound["train_end"]))


LEVELS = (("series", (*SERIES, "horizon")), ("horizon", ("horizon",)), ("all", ()))
SHARES = (0.25, 0.5, 0.75)


def fold_quantiles(rows: DataFrame, folds: DataFrame, least: int = 20) -> DataFrame:
    """level, fold_id, store_key, product_key, horizon (empty or -1 where the level has none), n, q25, q50, q75: quantiles of the residuals
    (target less anchor) that each fold may learn from, of all folds in one pass.

    Rows are counted once by group, residual and the first fold whose training ends no earlier than their target date. Counts add up, so a
    fold's histogram is that of the folds up to it, and rows are never read again for a later fold. Groups of fewer than ``least`` rows are
    left out.
    """
    ends = folds.select("fold_id", "train_end")
    numbered = F.broadcast(ends.agg(F.array_sort(F.collect_list(F.struct("train_end", "fold_id"))).alias("ends_")))  # a row of a few folds
    open_ = F.filter("ends_", lambda e: e["train_end"] >= F.col("target_date"))
    known = rows.where("target is not null and anchor is not null").join(numbered, F.lit(True)).withColumn("first_", F.array_min(F.transform(open_, lambda e: e["train_end"]))).where("first_ is not null")
    counts = keep(known.groupBy(*SERIES, "horizon", "first_", (F.col("target") - F.col("anchor")).alias("residual")).agg(F.count("*").alias("n_")))
    every = []
    for name, keys in LEVELS:
        group = [F.col(c) if c in keys else F.lit("" if c in SERIES else -1).alias(c) for c in (*SERIES, "horizon")]
        every.append(counts.select(F.lit(name).alias("level"), *group, "first_", "residual", "n_").groupBy("level", *SERIES, "horizon", "first_", "residual").agg(F.sum("n_").alias("n_")))
    cumulated = union_all(every).join(F.broadcast(ends), F.col("train_end") >= F.col("first_"))
    keys = ["level", "fold_id", *SERIES, "horizon"]
    ranks = value_ranks(cumulated, keys, "residual", "n_")
    return ranks.groupBy(*keys, F.col("total").alias("n")).agg(*[at_share(s, "residual").alias(f"q{int(s * 100)}") for s in SHARES]).where(F.col("n") >= least)


def fold_forecasts(rows: DataFrame, folds: DataFrame, least: int = 20) -> DataFrame:
    """Rows of each fold's validation (see ``walk_forward_rows``) with p25, p50, p75 as fitted on that fold's training: the anchor plus the
    quantiles of the series and horizon, else of the horizon, else of all; level says which (none: the anchor alone)."""
    fitted = keep(fold_quantiles(rows, folds, least))
    out = walk_forward_rows(rows, folds)
    for i, (name, keys) in enumerate(LEVELS):
        own = fitted.where(F.col("level") == name).select("fold_id", *keys, F.array(*[f"q{int(s * 100)}" for s in SHARES]).alias(f"f{i}"))
        out = out.join(own, ["fold_id", *keys], "left")
    best = F.coalesce(*[f"f{i}" for i in range(len(LEVELS))])
    level = F.lit("none")
    for i, (name, _) in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col(f"f{i}").isNotNull(), name).otherwise(level)
    fresh = {n: F.greatest(F.lit(0.0), F.col("anchor") + F.coalesce(best[i], F.lit(0.0))) for i, n in enumerate(("p25", "p50", "p75"))}
    return out.withColumns({"level": level, **fresh}).drop(*[f"f{i}" for i in range(len(LEVELS))])


def fold_audit(rows: DataFrame, folds: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Per fold: rows of its validation days, those that may be judged, and how many the origin or each reason keeps out (a row may have several).

    rows: with target_date and cutoff_date. reasons: what keeps a row out, by name.
    """
    bound = F.broadcast(folds)  # a few folds
    met = rows.join(bound, (F.col("target_date") >= bound["validation_start"]) & (F.col("target_date") <= bound["validation_end"]))
    broken = {"origin_too_early": F.col("cutoff_date") < F.col("train_end"), **reasons}
    out = {name: F.coalesce(c, F.lit(True)) for name, c in broken.items()}
    bad = F.lit(False)
    for c in out.values():
        bad = bad | c
    return met.groupBy("fold_id").agg(F.count("*").alias("n_candidates"), F.count_if(~bad).alias("n_eligible"), *[F.count_if(c).alias(f"n_{name}") for name, c in out.items()])


def block_plan(dates: DataFrame, block: int, replications: int, seed: int) -> DataFrame:
    """replication, target_date (repeated): circular blocks of ``block`` dates, as many dates as there are."""
    numbered = dates.select("target_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("target_date")) - 1)
    spark = dates.sparkSession
    n = numbered.count()
    if not n:
        return numbered.select(F.lit(0).cast("long").alias("replication"), "target_date")
    blocks = -(-n // block)
    starts = spark.range(replications).withColumnRenamed("id", "replication").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "replication", "b"), F.lit(n)))
    places = starts.select("replication", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"), "b", "start").where(F.col("b") * block + F.col("k") < n).select("replication", F.pmod(F.col("start") + F.col("k"), F.lit(n)).cast("int").alias("i"))
    return places.join(numbered, "i").select("replication", "target_date")


def paired_wape(df: DataFrame, plan: DataFrame, candidate: str, baselines: list[str], alpha: float = 0.05) -> DataFrame:
    """Per baseline: WAPE difference to the candidate with a Bonferroni interval over the replications. Errors are summed per date first."""
    models = [candidate, *baselines]
    per_date = df.groupBy("target_date").agg(F.sum(F.abs("target")).alias("y"), *[F.sum(F.abs(F.col("target") - F.col(m))).alias(f"e_{m}") for m in models])
    drawn = plan.join(per_date, "target_date").groupBy("replication").agg(F.sum("y").alias("y"), *[F.sum(f"e_{m}").alias(f"e_{m}") for m in models])
    share = alpha / max(1, len(baselines))
    long = drawn.select("replication", F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), ((F.col(f"e_{candidate}") - F.col(f"e_{b}")) / F.nullif(F.col("y"), F.lit(0.0))).alias("delta")) for b in baselines])).alias("x")).select("replication", "x.*")
    ends = F.percentile("delta", F.array(F.lit(share / 2), F.lit(0.5), F.lit(1 - share / 2)))
    return long.groupBy("baseline").agg(ends.alias("q"), F.count("*").alias("n")).select("baseline", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def interval_bootstrap(df: DataFrame, plan: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval of coverage over the replications."""
    inside = ((F.col("target") >= F.col("interval_lower")) & (F.col("target") <= F.col("interval_upper"))).cast("double")
    per_date = df.groupBy("target_date").agg(F.sum(inside).alias("hit"), F.count("*").alias("n"))
    drawn = plan.join(per_date, "target_date").groupBy("replication").agg((F.sum("hit") / F.sum("n")).alias("coverage"))
    q = F.percentile("coverage", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return drawn.agg(q.alias("q"), F.count("*").alias("n")).select("n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The first value whose cumulated weight reaches q, else the greatest."""
    w = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("c_", F.sum(weight).over(w))
    return cum.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("c_") >= q - 1e-12, F.col(value))), F.max(value)).alias(name))


def weighted_cvar(df: DataFrame, keys: list[str], value: str, weight: str, alpha: float, name: str) -> DataFrame:
    """Weighted mean of the worst 1 - alpha, the last item counted in part."""
    tail = 1 - alpha
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "tie_").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("tie_", F.monotonically_increasing_id()).withColumn("b_", F.coalesce(F.sum(weight).over(w), F.lit(0.0)))
    part = F.greatest(F.lit(0.0), F.least(F.col(weight), F.lit(tail) - F.col("b_")))
    return rows.groupBy(*keys).agg((F.sum(part * F.col(value)) / tail).alias(name))
