"""Draws of observed values from pools: the most specific pool with enough observations wins.

A pool is kept as counts of its values with the ranks they take, so that a pool of a third of all rows is as many rows as it has values.
A draw is a rank. A pool of at most SHORT values goes to its lines as one array, in which the rank is looked up. The values of a longer
one are ranked by range (``ordered.value_ranks``), sorted by no single task, and dealt into buckets of WIDTH ranks; a draw meets only the
values of its bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.sources.keep import keep

from .checks import union_all
from .ordered import value_ranks

WIDTH = 1024
SHORT = 64
INSUFFICIENT = "SCENARIO_DATA_INSUFFICIENT"


def pools(observations: DataFrame, levels: list[tuple[str, list[str]]], value: str, count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """pool, total, values_ (an array of below and value in order; null for more than SHORT values) for the pools of every level (name,
    columns); and the values of the long ones: pool, value, n, below. Rows with a null in a level's columns are not in its pools.

    ``count`` names how many observations a row stands for. Observations are counted in one pass, and the levels from these counts.
    """
    columns = list(dict.fromkeys(c for _, own in levels for c in own))
    seen = observations.where(F.col(value).isNotNull()).withColumn("one_", F.col(count) if count else F.lit(1).cast("long"))
    counted = keep(seen.groupBy(*columns, F.col(value).alias("value")).agg(F.sum("one_").alias("n_")))
    every = []
    for name, own in levels:
        known = counted
        for c in own:
            known = known.where(F.col(c).isNotNull())
        every.append(known.groupBy(pool_of(name, own).alias("pool"), "value").agg(F.sum("n_").alias("n_")))
    found = keep(union_all(every))
    long = keep(found.groupBy("pool").agg(F.count("*").alias("v_")).where(F.col("v_") > min(SHORT, WIDTH)))
    ranks = keep(value_ranks(found.join(long.select("pool"), "pool", "left_semi"), ["pool"], "value", "n_"))
    order = F.array_sort(F.collect_list(F.struct("value", "n_")))
    start = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast(f"array<struct<below:bigint,value:{found.schema['value'].dataType.simpleString()}>>").alias("all"))
    summed = F.aggregate(order, start, lambda acc, x: F.struct((acc["to"] + x["n_"]).alias("to"), F.array_append(acc["all"], F.struct(acc["to"].alias("below"), x["value"].alias("value"))).alias("all")))
    short = found.join(long.select("pool"), "pool", "left_anti").groupBy("pool").agg(summed.alias("x_")).select("pool", F.col("x_.to").alias("total"), F.col("x_.all").alias("values_"))
    return keep(short.unionByName(ranks.groupBy("pool").agg(F.max("total").alias("total")), allowMissingColumns=True)), ranks


def pool_of(name: str, columns: list[str]) -> Column:
    return F.to_json(F.array(F.lit(name), *[F.col(c).cast("string") for c in columns]))


def chosen_pools(lines: DataFrame, found: DataFrame, levels: list[tuple[str, list[str]]], least: int) -> DataFrame:
    """The distinct level columns of ``lines`` with source (the first level whose pool has ``least`` observations; null: none), pool, n_observed and values_."""
    columns = list(dict.fromkeys(c for _, own in levels for c in own))
    sizes = found.select("pool", F.col("total").alias("n_")).where(F.col("n_") >= least)
    rows = lines.select(*columns).distinct()
    for i, (name, own) in enumerate(levels):
        rows = rows.withColumn("pool", pool_of(name, own)).join(sizes.withColumnRenamed("n_", f"n{i}_"), "pool", "left").withColumn(f"p{i}_", F.when(F.col(f"n{i}_").isNotNull(), F.struct(F.lit(name).alias("source"), "pool", F.col(f"n{i}_").alias("n_observed")))).drop("pool", f"n{i}_")
    best = F.coalesce(*[f"p{i}_" for i in range(len(levels))])
    rows = rows.withColumn("best_", best).select(*columns, "best_.source", "best_.pool", "best_.n_observed")
    return rows.join(found.select("pool", "values_"), "pool", "left")


def draw(lines: DataFrame, observations: DataFrame, levels: list[tuple[str, list[str]]], value: str, u: Column | Callable[[Column], Column], least: int = 3, count: str | None = None, asked: DataFrame | None = None, worlds: range | None = None, dealt: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``lines`` with source, n_observed and value (an observed one, by the share ``u`` of 0 to 1 of its pool's rows in order), and the
    lines for which no pool has ``least`` observations, with an issue. ``u`` must be the same whenever it is computed.

    ``count``: as in ``pools``. ``asked``: the level columns of all lines, where that is a smaller table. ``worlds``: every line is drawn
    once for each of these, the column scenario_id, of which ``u`` is then a function; lines are copied last. ``dealt``: columns of ``lines`` by which
    they are dealt before that, so that a sum by these columns and scenario_id moves no copies.
    """
    found, ranks = pools(observations, levels, value, count)
    columns = list(dict.fromkeys(c for _, own in levels for c in own))
    chosen = chosen_pools(lines if asked is None else asked, found, levels, least)
    chosen = chosen.withColumnsRenamed({c: f"{c}_of_" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in columns], F.lit(True))
    met = lines.join(chosen, same).select(*lines.columns, "source", "pool", "n_observed", "values_")
    known = met.where("source is not null")
    numbers = [F.lit(k).cast("long") for k in worlds] if worlds is not None else [F.lit(0).cast("long")]
    out = [*lines.columns, *([F.col("world_").alias("scenario_id")] if worlds is not None else []), "source", "n_observed", value]
    rank = lambda share: F.least(F.floor(share * F.col("n_observed")), F.col("n_observed") - 1)
    marked = known.withColumn("ranks_", F.array(*[F.struct(k.alias("world_"), rank(u if worlds is None else u(k)).alias("rank_")) for k in numbers]))
    pick = lambda x: F.struct(x["world_"].alias("world_"), F.element_at(F.filter("values_", lambda v: v["below"] <= x["rank_"]), -1)["value"].alias(value))
    near = marked.where("values_ is not null").withColumn("ranks_", F.transform("ranks_", pick)).drop("values_", "pool")
    near = (near.repartition(*dealt) if dealt else near).select(*lines.columns, "source", "n_observed", F.inline("ranks_"))
    far = marked.where("values_ is null").select(*lines.columns, "source", "pool", "n_observed", F.inline("ranks_")).withColumn("bucket_", F.floor(F.col("rank_") / WIDTH))
    spread = ranks.select(F.col("pool").alias("pool_"), F.col("value").alias(value), "below", "n", F.explode(F.sequence(F.floor(F.col("below") / WIDTH), F.floor((F.col("below") + F.col("n") - 1) / WIDTH))).alias("b_"))
    hit = (F.col("pool") == F.col("pool_")) & (F.col("bucket_") == F.col("b_")) & (F.col("rank_") >= F.col("below")) & (F.col("rank_") < F.col("below") + F.col("n"))
    drawn = near.select(*out) if ranks.isEmpty() else near.select(*out).unionByName(far.join(spread, hit).select(*out))
    return drawn, met.where("source is null").select(*lines.columns, F.lit(INSUFFICIENT).alias("issue"))


LEAD_LEVELS = [("supplier_ingredient", ["supplier_id", "ingredient_id"]), ("supplier", ["supplier_id"]), ("ingredient", ["ingredient_id"]), ("global", [])]


def observed_lead_times(orders: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """supplier_id, ingredient_id, lead of the orders whose arrival was known by ``as_of``, and those that cannot be used, with an issue."""
    lead = F.datediff("arrival_date", "order_date")
    issue = F.when(F.col("order_date").isNull() | F.col("arrival_date").isNull(), "DATES_MISSING").when(lead < 0, "LEAD_TIME_NEGATIVE")
    known = orders.withColumn("issue", issue).where(F.col("issue").isNotNull() | (F.col("arrival_date") <= as_of))
    return known.where("issue is null").select("supplier_id", "ingredient_id", lead.alias("lead")), known.where("issue is not null")


def realise_supply(lines: DataFrame, observed: DataFrame, u: Column | Callable[[Column], Column], least: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """Lines (supplier_id, ingredient_id, order_date, shelf_life_days and more) with lead, arrival_date, expiry_date (null: does not expire;
    counted from the arrival) and arrival_condition; and the lines without a pool. ``how``: as in ``draw``."""
    drawn, without = draw(lines, observed, LEAD_LEVELS, "lead", u, least, **how)
    arrived = drawn.withColumn("arrival_date", F.date_add("order_date", F.col("lead").cast("int"))).withColumn("expiry_date", F.date_add("arrival_date", F.col("shelf_life_days").cast("int")))
    condition = F.when(F.col("expiry_date") < F.col("arrival_date"), "arrived_expired_realization").otherwise("normal")
    return arrived.withColumn("arrival_condition", condition), without
