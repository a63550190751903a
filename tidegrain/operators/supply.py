"""Supplier calendars, offers, order opportunities and checks of a given plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import failed, union_all


def add_working_days(start: Column, lead: Column, working: Column, holidays: Column, most: int = 60) -> Column:
    """The day ``lead`` working days after ``start``; null if it lies beyond ``most`` days."""
    days = F.filter(F.sequence(F.date_add(start, 1), F.date_add(start, most)), lambda d: F.array_contains(working, F.weekday(d)) & ~F.array_contains(holidays, d))
    return F.when(lead == 0, start).otherwise(F.try_element_at(days, lead.cast("int")))


def next_receiving(earliest: Column, weekdays: Column, holidays: Column, most: int = 21) -> Column:
    """The first day from ``earliest`` on that is a delivery weekday and no holiday."""
    return F.array_min(F.filter(F.sequence(earliest, F.date_add(earliest, most)), lambda d: F.array_contains(weekdays, F.weekday(d)) & ~F.array_contains(holidays, d)))


def resolve_arrival(order: Column, lead: Column, weekdays: Column, holidays: Column, meaning: str = "RECEIVING", transport: int = 0, next_day: bool = False) -> Column:
    """Arrival under a weekly calendar. ORDER: weekdays on which one may order (else null); DISPATCH: adds the transport days."""
    effective = F.date_add(order, int(next_day))
    earliest = F.date_add(effective, lead)
    if meaning == "ORDER":
        return F.when(F.array_contains(weekdays, F.weekday(effective)) & ~F.array_contains(holidays, effective), earliest)
    return F.date_add(next_receiving(earliest, weekdays, holidays), transport if meaning == "DISPATCH" else 0)


def normalise_offers(offers: DataFrame) -> DataFrame:
    """Minimum quantity in packs to base quantity, price per pack to price per base unit."""
    moq = F.when(F.col("order_unit") == "pack", F.col("minimum_order_quantity") * F.col("pack_size")).otherwise(F.col("minimum_order_quantity"))
    return offers.withColumn("minimum_quantity", moq).withColumn("price_per_unit", F.when(F.col("price_basis") == "PACK", F.col("unit_price") / F.col("pack_size")).otherwise(F.col("unit_price")))


def undominated(offers: DataFrame, terms: list[str], order: str = "order_date") -> DataFrame:
    """Of offers with the same terms the earliest, with all their order dates."""
    w = Window.partitionBy(*terms)
    rows = offers.withColumn("order_dates", F.array_sort(F.collect_set(order).over(w))).withColumn("r_", F.row_number().over(w.orderBy(order, "offer_id")))
    return rows.where("r_ = 1").drop("r_")


def split_fee(lines: DataFrame, group: list[str], fee: str, order: str) -> DataFrame:
    """Each line's share of its group's one fee, in cents; the last line takes what is left."""
    w = Window.partitionBy(*group)
    rows = lines.withColumn("k_", F.row_number().over(w.orderBy(order))).withColumn("n_", F.count("*").over(w))
    each = F.bround(F.col(fee) / F.col("n_"), 2)
    return rows.withColumn("fee_share", F.when(F.col("k_") < F.col("n_"), each).otherwise(F.round(F.col(fee) - each * (F.col("n_") - 1), 2))).drop("k_", "n_")


def plan_violations(plan: DataFrame, offers: DataFrame) -> DataFrame:
    """Plan lines with the codes of the offer terms they break."""
    o = offers.select("offer_id", F.col("ingredient_id").alias("o_ingredient"), F.col("price_per_unit").alias("o_price"), "pack_size", "minimum_quantity", "maximum_quantity")
    rows = plan.join(o, "offer_id", "left")
    rules = {
        "UNKNOWN_OFFER": F.col("o_ingredient").isNull(), "INGREDIENT_MISMATCH": F.col("ingredient_id") != F.col("o_ingredient"), "PRICE_MISMATCH": F.abs(F.col("price") - F.col("o_price")) > 1e-6,
        "NOT_WHOLE_PACKS": F.abs(F.col("quantity") / F.col("pack_size") - F.round(F.col("quantity") / F.col("pack_size"))) > 1e-9, "BELOW_MINIMUM": F.col("quantity") < F.col("minimum_quantity"), "ABOVE_MAXIMUM": F.col("quantity") > F.col("maximum_quantity"),
    }
    return rows.withColumn("violations", failed(rules)).drop("o_ingredient", "o_price")


# Reason codes of supply bounds: fixed values.
BEFORE_FIRST_ARRIVAL, NO_USABLE_LOT, CUMULATIVE, EXPIRY_REQUIRED = "DEMAND_BEFORE_FIRST_ARRIVAL", "NO_USABLE_LOT", "CUMULATIVE_DEMAND_BEFORE_FIRST_ARRIVAL", "SUPPLIER_EXPIRY_REQUIRED"


def is_open(decision: Column) -> Column:
    """Whether an offer may still be ordered, and arrives."""
    ok = F.coalesce("available", F.lit(False)) & (F.col("order_date") >= decision) & F.coalesce(F.col("order_date") <= F.col("order_cutoff_date"), F.lit(True))
    return F.coalesce(ok & F.col("arrival_date").isNotNull(), F.lit(False))


def open_offers(offers: DataFrame, decision: Column, unknown_expiry: str = "reject") -> DataFrame:
    """Offers that may still be ordered, with expiry_date and blocked (no shelf life where that must be known: they arrive, but supply nothing).

    offers: offer_id, available, order_date, order_cutoff_date, arrival_date, shelf_life_days, maximum_order_quantity (null: no limit).
    """
    rows = offers.where(is_open(decision))
    return rows.withColumn("expiry_date", F.date_add("arrival_date", F.col("shelf_life_days").cast("int"))).withColumn("blocked", F.col("shelf_life_days").isNull() & F.lit(unknown_expiry == "reject"))


def blocked_offers(opened: DataFrame, needs: DataFrame, keys: list[str]) -> DataFrame:
    """Offers without a shelf life that would arrive by the last day of a need of their key: their terms have to be confirmed."""
    last = needs.groupBy(*keys).agg(F.max("date").alias("last_"))
    return opened.where("blocked").join(last, keys).where("arrival_date <= last_").select(*keys, "offer_id", "arrival_date", F.lit(EXPIRY_REQUIRED).alias("reason"))


START = "0001-01-01"  # the day on which what is on hand counts as received


def supply_row(arrival: Column, expiry: Column, quantity: Column, firm: bool, blocked: Column, price: Column) -> Column:
    """A lot, a delivery or an offer: offers are not firm, and without a limit if their quantity is null."""
    return F.struct(arrival.cast("date").alias("arrival_date"), expiry.cast("date").alias("expiry_date"), quantity.cast("double").alias("quantity"), F.lit(firm).alias("firm"), blocked.alias("blocked"), price.cast("double").alias("price_per_unit"))


def stock_of(initial: DataFrame, inbound: DataFrame, opened: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the fields of ``supply_row``: all that is on hand, comes or is offered."""
    expiry, no, none = F.col("expiry_date"), F.lit(False), F.lit(None)
    price = F.col("price_per_unit") if "price_per_unit" in opened.columns else none
    rows = [
        (initial, supply_row(F.lit(START), expiry, F.col("quantity"), True, no, none)),
        (inbound, supply_row(F.col("arrival_date"), expiry, F.col("quantity"), True, no, none)),
        (opened, supply_row(F.col("arrival_date"), expiry, F.col("maximum_order_quantity"), False, F.col("blocked"), price)),
    ]
    return union_all([df.select(*keys, row.alias("s_")).select(*keys, "s_.*") for df, row in rows])


def daily_changes(needs: DataFrame, stock: DataFrame, keys: list[str], expiry_inclusive: bool = True) -> DataFrame:
    """Per key and day: q (usable quantity that comes less what goes), n (offers without a limit, likewise), r (received), a, e and p (first
    arrival, last expiry and least price of offers that arrive), asked (whether ``needs`` has it). Stock is read once and added up where it lies.
    """
    zero, no_day = F.lit(0.0), F.lit(None).cast("date")
    arrival, expiry, quantity, firm, offer = F.col("arrival_date"), F.col("expiry_date"), F.col("quantity"), F.col("firm"), ~F.col("firm")
    gone = F.date_add("expiry_date", 1 if expiry_inclusive else 0)
    limited, counts = firm | quantity.isNotNull(), ~F.col("blocked")
    stays = counts & F.coalesce(expiry.isNull() | (gone > arrival), F.lit(False))  # what expires before it comes never counts
    row = lambda day, q=zero, n=zero, r=zero, a=no_day, e=no_day, p=F.lit(None), asked=False: F.struct(
        day.alias("date"), q.cast("double").alias("q"), n.alias("n"), r.cast("double").alias("r"), a.alias("a"), e.alias("e"), p.cast("double").alias("p"), F.lit(asked).alias("asked")
    )
    comes = row(arrival, F.when(stays & limited, quantity).otherwise(0.0), F.when(stays & ~limited, 1.0).otherwise(0.0), F.when(firm, quantity).otherwise(0.0), F.when(offer, arrival), F.when(offer, expiry), F.when(offer, F.col("price_per_unit")))
    goes = F.when(stays & expiry.isNotNull(), row(gone, F.when(limited, -quantity).otherwise(0.0), F.when(~limited, -1.0).otherwise(0.0)))
    changes = stock.select(*keys, F.inline(F.array(comes, goes))).where("asked IS NOT NULL")
    every = changes.unionByName(needs.select(*keys, row(F.col("date"), asked=True).alias("s_")).select(*keys, "s_.*"))
    return every.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in "qnr"], F.min("a").alias("a"), F.max("e").alias("e"), F.min("p").alias("p"), F.max("asked").alias("asked"))


def sweep(daily: DataFrame, keys: list[str]) -> DataFrame:
    """The running sums of ``daily_changes`` on the days that are asked for: see ``usable_supply``."""
    key = Window.partitionBy(*keys)
    so_far = key.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    later = key.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    swept = daily.select(
        *keys, "date", "asked", F.greatest(F.sum("q").over(so_far), F.lit(0.0)).alias("usable"), F.sum("n").over(so_far).cast("long").alias("unlimited"), F.sum("r").over(so_far).alias("received"),
        F.min("a").over(key).alias("earliest_arrival"), F.min("a").over(later).alias("next_arrival"), F.max("e").over(key).alias("last_expiry"),
    )
    return swept.where("asked").drop("asked")


def usable_supply(needs: DataFrame, initial: DataFrame, inbound: DataFrame, opened: DataFrame, keys: list[str], expiry_inclusive: bool = True) -> DataFrame:
    """Per key and day of ``needs``: usable (upper bound of what could serve the day), unlimited (offers without a limit), received
    (initial stock and inbound so far, whatever its expiry), earliest_arrival, next_arrival and last_expiry of the offers.

    A sweep: supply comes on the day it arrives and goes after its last day. Changes are added up by key and day before the one window
    of a key, which has as many rows as there are days, however many lots and offers there are. What is consumed is left out on
    purpose, so that the bound is never too low.
    """
    return sweep(daily_changes(needs, stock_of(initial, inbound, opened, keys), keys, expiry_inclusive), keys)


def supply_bounds(needs: DataFrame, swept: DataFrame, keys: list[str], world: str = "scenario_id", tolerance: float = 1e-6) -> DataFrame:
    """Per world, key and day: required, usable, shortfall (a sound lower bound) and reason (null where nothing is short).

    needs: ``world``, keys, date, quantity. The bound takes all that could be usable on the day, as if nothing were consumed before.
    """
    required = needs.groupBy(world, *keys, "date").agg(F.sum("quantity").alias("required"))
    short = F.when(F.col("unlimited") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("required") - F.col("usable")))
    reason = F.when(F.col("date") < F.col("earliest_arrival"), BEFORE_FIRST_ARRIVAL).otherwise(NO_USABLE_LOT)
    return required.join(swept, [*keys, "date"]).withColumn("shortfall", short).withColumn("reason", F.when(F.col("shortfall") > tolerance, reason))


def prefix_bounds(bounds: DataFrame, keys: list[str], world: str = "scenario_id", tolerance: float = 1e-6) -> DataFrame:
    """Per world and key: the need of all days before the first offer arrives against all stock received by then, each counted once."""
    before = bounds.where(F.col("earliest_arrival").isNull() | (F.col("date") < F.col("earliest_arrival")))
    sums = before.groupBy(world, *keys).agg(F.max("date").alias("date"), F.sum("required").alias("required"), F.max_by("received", "date").alias("received"), F.min("earliest_arrival").alias("earliest_arrival"))
    short = F.greatest(F.lit(0.0), F.col("required") - F.col("received"))
    return sums.withColumn("shortfall", short).withColumn("reason", F.when(F.col("shortfall") > tolerance, CUMULATIVE))


def key_bounds(bounds: DataFrame, prefixes: DataFrame, keys: list[str], world: str = "scenario_id") -> DataFrame:
    """Per world and key: required in all, and shortfall (the days' bounds together or the prefix bound, whichever is greater)."""
    days = bounds.groupBy(world, *keys).agg(F.sum("required").alias("required"), F.sum("shortfall").alias("daily"), F.count("reason").alias("n_days"))
    prefix = prefixes.select(world, *keys, F.col("shortfall").alias("prefix"), (F.col("reason").isNotNull()).alias("cumulative"))
    met = days.join(prefix, [world, *keys], "left")
    return met.select(world, *keys, "required", F.greatest("daily", F.coalesce("prefix", F.lit(0.0))).alias("shortfall"), ((F.col("n_days") > 0) | F.coalesce("cumulative", F.lit(False))).alias("short"))


def ruled_out(by_key: DataFrame, weights: DataFrame, profiles: list[tuple[str, float, float, float]], keys: list[str], world: str = "scenario_id", tolerance: float = 1e-9) -> DataFrame:
    """Profiles (name, least fill rate of any key and world, greatest probability of a stockout, least expected fill rate of any key) that no
    plan can meet: profile, worst_fill, stockout_probability, worst_expected_fill, infeasible. What is not ruled out need not be feasible.

    weights: ``world``, weight (null in any row: the two conditions on probabilities are left out).
    """
    fill = F.when(F.col("required") > 0, 1 - F.col("shortfall") / F.col("required")).otherwise(1.0)
    rows = by_key.join(weights, world).withColumn("fill", fill)
    worlds = rows.groupBy(world).agg(F.min("fill").alias("fill"), F.max("short").alias("short"), F.first("weight").alias("weight"), F.count_if(F.col("weight").isNull()).alias("unknown"))
    one = worlds.agg(F.min("fill").alias("worst_fill"), F.sum(F.when(F.col("short"), F.col("weight")).otherwise(0.0)).alias("p"), F.sum("unknown").alias("unknown"))
    expected = rows.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("fill")).alias("f")).agg(F.min("f").alias("f"))
    known = F.col("unknown") == 0
    kinds = F.inline(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(float(a)).alias("a_"), F.lit(float(b)).alias("b_"), F.lit(float(c)).alias("c_")) for n, a, b, c in profiles]))
    made = one.join(F.broadcast(expected), F.lit(True)).select("*", kinds)  # one row of each
    broken = (F.col("worst_fill") + tolerance < F.col("a_")) | (known & ((F.col("p") > F.col("b_") + tolerance) | (F.col("f") + tolerance < F.col("c_"))))
    return made.select("profile", "worst_fill", F.when(known, F.col("p")).alias("stockout_probability"), F.when(known, F.col("f")).alias("worst_expected_fill"), F.coalesce(broken, F.lit(False)).alias("infeasible"))


def least_cost(by_key: DataFrame, received: DataFrame, opened: DataFrame, least_fill: float, keys: list[str], last: Column) -> DataFrame:
    """Per key: quantity that must be bought so that every world reaches ``least_fill``, at the least price of an offer that arrives by ``last``.

    received: keys, received (initial stock and inbound in all). A need without any price is left to the bounds above (cost null).
    """
    most = by_key.groupBy(*keys).agg(F.max("required").alias("required"))
    price = opened.where(F.col("arrival_date") <= last).groupBy(*keys).agg(F.min("price_per_unit").alias("price"))
    quantity = F.greatest(F.lit(0.0), F.col("required") * F.lit(float(least_fill)) - F.coalesce("received", F.lit(0.0)))
    rows = most.join(received, keys, "left").join(price, keys, "left").withColumn("quantity", quantity)
    return rows.select(*keys, "quantity", "price", F.when(F.col("quantity") > 0, F.col("quantity") * F.col("price")).otherwise(0.0).alias("cost"))
