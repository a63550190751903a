"""Lot ledgers with waste, costs and traces: what became of every lot, day by day.

A day of a key goes: deliveries arrive, what is past its date expires, demand takes lots first expired first out, waste events take what
they name. Lots of equal dates are one entry before the fold over days, unless a waste event names one of them, and waste events that follow
each other on a day without naming a lot are one run. So a fold has as many entries as pairs of dates, and as many runs as days and
events that name a lot. The fold reports what each entry loses; where running sums overlap (an entry's lots in their order, its losses
in theirs; a run's events and its losses) tells which lot and which event that was. Overlaps are found in one sort of both, not by pairs.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.sources.keep import keep

from .inventory import NEVER, START, fefo_order

ENTRY = ["arrival_", "expiry_", "received_", "own_"]
AMOUNTS = ["beginning", "inbound", "maximum", "expired", "demand", "fulfilled", "waste", "ending", "at_risk"]
TOLERANCE = 1e-9


def entries(lots: DataFrame, inbound: DataFrame, waste: DataFrame, keys: list[str]) -> DataFrame:
    """Every lot with the entry it belongs to: the day it arrives, its dates as numbers, and its own id where it is an entry of its own."""
    named = waste.where("lot_id is not null").select(*keys, "lot_id", F.lit(True).alias("named_")).distinct()
    shown = [*keys, "lot_id", "quantity", "expiry_date", "received_date"]
    every = lots.select(*shown, F.lit(START).alias("arrival_")).unionByName(inbound.select(*shown, F.unix_date("arrival_date").alias("arrival_")))
    number = lambda c: F.coalesce(F.unix_date(c), F.lit(NEVER))
    every = every.withColumns({"expiry_": number("expiry_date"), "received_": number("received_date")})
    dates = [*keys, *ENTRY[:3]]
    apart = every.join(named, [*keys, "lot_id"], "left_semi").select(*dates, F.lit(True).alias("named_")).distinct()
    return every.join(apart, dates, "left").withColumn("own_", F.when(F.col("named_"), F.col("lot_id")).otherwise("")).drop("named_")


def waste_runs(waste: DataFrame, keys: list[str]) -> DataFrame:
    """Waste events that ask for something, with their run: an event that names a lot is one, and so are those between two of them."""
    order = Window.partitionBy(*keys, "date").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    named = F.col("lot_id").isNotNull()
    asked = waste.select(*keys, "date", F.col("event_id").cast("string").alias("event_id"), F.col("quantity").cast("double").alias("quantity"), "lot_id").where("quantity > 0")
    return asked.withColumn("run_", (2 * F.count_if(named).over(order) - named.cast("int")).cast("int"))


def overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``by``, a_, b_, quantity: where the stretches (a struct a_ or b_, from_, to_) of two tables lie over each other.

    The stretches of a table follow each other within ``by``. The starts of both are sorted together; from each to the next, the last
    start of either table tells what lies there, if it has not ended.
    """
    kinds = {name: df.schema[name].dataType for name, df in (("a_", a), ("b_", b))}
    ends = a.where("from_ < to_").select(*by, "from_", F.struct("a_", "to_").alias("x_")).unionByName(b.where("from_ < to_").select(*by, "from_", F.struct("b_", "to_").alias("y_")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("from_")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(*by, "from_", F.last("x_", True).over(so_far).alias("x_"), F.last("y_", True).over(so_far).alias("y_"), F.lead("from_").over(w).alias("next_"))
    met = pieces.withColumn("quantity", F.least("next_", "x_.to_", "y_.to_") - F.col("from_")).where(F.col("x_").isNotNull() & F.col("y_").isNotNull() & (F.col("quantity") > TOLERANCE))
    return met.select(*by, *[F.col(f"{c}.{name}").cast(kinds[name]).alias(name) for c, name in (("x_", "a_"), ("y_", "b_"))], "quantity")


def stretches(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with the stretch from_ to to_ that their quantity takes among those of ``by`` in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = lambda end: F.sum("quantity").over(w.rowsBetween(Window.unboundedPreceding, end))
    return df.where("quantity > 0").withColumns({"to_": running(0), "from_": F.coalesce(running(-1), F.lit(0.0))})


def flow(lots: DataFrame, demand: DataFrame, inbound: DataFrame, waste: DataFrame, keys: list[str], expiry_inclusive: bool = True, at_risk_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """The fold, written once: all its rows (``lines``, ``refused_waste`` and ``traces`` read them), and the lots with their entries.

    lots: keys, lot_id, quantity, expiry_date, received_date. inbound: the same with arrival_date. demand: keys, date, demand, the days to
    simulate. waste: keys, event_id, date, quantity, lot_id (null: first expired first out). What a waste event asks beyond the stock it
    may take is reported as refused. Deliveries on days that are not simulated do not arrive.
    """
    placed, runs = entries(lots, inbound, waste, keys), waste_runs(waste, keys)
    none = lambda kind: F.lit(None).cast(kind)
    rows = lambda df, day, kind, quantity, expiry=none("int"), received=none("int"), own=none("string"), lot=none("string"), run=none("int"): df.select(
        *keys, day.alias("day"), F.lit(kind).alias("kind"), quantity.cast("double").alias("quantity"), expiry.alias("expiry_"), received.alias("received_"), own.alias("own_"), lot.alias("lot_id"), run.alias("run_")
    )
    grouped = placed.groupBy(*keys, *ENTRY).agg(F.sum("quantity").alias("quantity"))
    grouped_waste = runs.groupBy(*keys, "date", "run_", "lot_id").agg(F.sum("quantity").alias("quantity"))
    events = (
        rows(grouped, F.col("arrival_"), "lot", F.col("quantity"), F.col("expiry_"), F.col("received_"), F.col("own_"))
        .unionByName(rows(demand, F.unix_date("date"), "day", F.coalesce("demand", F.lit(0.0))))
        .unionByName(rows(grouped_waste, F.unix_date("date"), "waste", F.col("quantity"), lot=F.col("lot_id"), run=F.col("run_")))
    )
    kinds = {f.name: f.dataType.simpleString() for f in demand.schema.fields}
    lost = ["arrival_ int", "expiry_ int", "received_ int", "own_ string", "step int", "run_ int", "quantity double"]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "kind string", "day int", *lost, *[f"{c} double" for c in AMOUNTS]])

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fold_days(group, expiry_inclusive, at_risk_days), columns=["kind", "day", *[c.split()[0] for c in lost], *AMOUNTS])
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out

    folded = keep(events.groupBy(*keys).applyInPandas(fold, schema))
    return folded.where("run_ is null").drop("run_").withColumn("event_id", none("string")).unionByName(by_event(folded.where("run_ is not null"), runs, keys)), placed


def by_event(found: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """What runs of waste events lost, and what of them was refused, for each event: they are served in order, and the last go without."""
    day = [*keys, "day", "run_"]
    asked = stretches(runs.withColumn("day", F.unix_date("date")), day, [F.col("event_id")]).select(*day, F.struct("event_id").alias("a_"), "from_", "to_")
    own = [c for c in found.columns if c not in (*day, "quantity")]
    gone = stretches(found, day, [F.col("kind") == "refused", F.col("step")]).select(*day, F.struct(*own).alias("b_"), "from_", "to_")
    return overlaps(asked, gone, day).select(*keys, "day", "a_.event_id", "quantity", "b_.*").select(*[c if c != "run_" else "event_id" for c in found.columns])


def fold_days(rows: pd.DataFrame, inclusive: bool, at_risk_days: int) -> list[tuple]:
    """Rows of one key: a line for each day, and a loss for each time that an entry gives something."""
    of = lambda kind: rows[rows["kind"] == kind]
    arriving: dict[int, list] = {}
    for r in of("lot").itertuples():
        arriving.setdefault(r.day, []).append([(int(r.expiry_), int(r.received_), r.day, r.own_), r.quantity, r.own_])
    wasting: dict[int, list] = {}
    for r in of("waste").sort_values("run_").itertuples():
        wasting.setdefault(r.day, []).append((int(r.run_), r.lot_id, r.quantity))
    stock: list[list] = []  # [order, quantity, own id], in order
    out: list[tuple] = []
    blank = (None,) * len(AMOUNTS)
    step = 0

    def lose(kind: str, day: int, entry: list, quantity: float, run: int | None = None) -> None:
        nonlocal step
        step += 1
        entry[1] -= quantity
        expiry, received, arrival, _ = entry[0]
        out.append((kind, day, arrival, expiry, received, entry[2], step, run, quantity, *blank))

    def take(kind: str, day: int, wanted: float, run: int | None = None, lot: str | None = None) -> float:
        """First expired first out, or from the entry of ``lot``; returns what could not be taken."""
        for entry in stock if lot is None else [e for e in stock if e[2] == lot]:
            if wanted <= 0:
                break
            got = min(entry[1], wanted)
            if got > 0:
                lose(kind, day, entry, got, run)
                wanted -= got
        stock[:] = [e for e in stock if e[1] > 0]
        return wanted

    for found in arriving.get(START, []):
        bisect.insort(stock, found)
    for r in of("day").sort_values("day").itertuples():
        day, beginning = r.day, sum(e[1] for e in stock)
        arrived = 0.0
        for found in arriving.get(day, []):
            bisect.insort(stock, found)
            arrived += found[1]
        expired = 0.0
        while stock and (stock[0][0][0] < day if inclusive else stock[0][0][0] <= day):
            entry = stock.pop(0)
            expired += entry[1]
            if entry[1] > 0:
                lose("expired", day, entry, entry[1])
        short = take("consumed", day, r.quantity)
        before = sum(e[1] for e in stock)
        for run, lot, wanted in wasting.get(day, []):
            rest = take("wasted", day, wanted, run, None if pd.isna(lot) else lot)
            if rest > TOLERANCE:
                out.append(("refused", day, None, None, None, None, None, run, rest, *blank))
        ending = sum(e[1] for e in stock)
        risk = sum(e[1] for e in stock if e[0][0] != NEVER and 0 <= e[0][0] - day <= at_risk_days)
        out.append(("line", day, None, None, None, None, None, None, None, beginning, arrived, beginning + arrived, expired, r.quantity, r.quantity - short, before - ending, ending, risk))
    return out


def lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The daily ledger: keys, date, amounts and shortage."""
    return rows.where("kind = 'line'").select(*keys, F.date_from_unix_date("day").alias("date"), *AMOUNTS, (F.col("demand") - F.col("fulfilled")).alias("shortage"))


def refused_waste(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Waste events with what they ask beyond the stock they may take."""
    return rows.where("kind = 'refused'").select(*keys, F.date_from_unix_date("day").alias("date"), "event_id", "quantity", F.lit("INVALID_WASTE_EVENT").alias("issue"))


def traces(rows: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lot_id, date, kind (consumed, expired, wasted), event_id, quantity: what each lot gave, and when."""
    entry = [*keys, *ENTRY]
    held = stretches(placed, entry, fefo_order()).select(*entry, F.struct("lot_id").alias("a_"), "from_", "to_")
    lost = stretches(rows.where("kind in ('consumed', 'expired', 'wasted')"), entry, [F.col("step"), F.col("event_id")]).select(*entry, F.struct("day", "kind", "event_id").alias("b_"), "from_", "to_")
    return overlaps(held, lost, entry).select(*keys, "a_.lot_id", F.date_from_unix_date("b_.day").alias("date"), "b_.kind", "b_.event_id", "quantity")


def outcomes(placed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every lot with what was consumed, expired and wasted of it, what is left, and the last day it gave something.

    Rows of one key that repeat an id are one lot here, with their quantities together and their least dates.
    """
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("quantity_")).otherwise(0.0)).alias(kind)
    sums = found.withColumnRenamed("quantity", "quantity_").groupBy(*keys, "lot_id").agg(part("consumed"), part("expired"), part("wasted"), F.max("date").alias("last_date"))
    lots = placed.groupBy(*keys, "lot_id").agg(F.sum("quantity").alias("quantity"), F.min("expiry_date").alias("expiry_date"), F.min("received_date").alias("received_date"))
    rows = lots.join(sums, [*keys, "lot_id"], "left").fillna(0.0, ["consumed", "expired", "wasted"])
    return rows.withColumn("left", F.col("quantity") - F.col("consumed") - F.col("expired") - F.col("wasted"))


def unbalanced(ledger: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Ledger lines where beginning and inbound, less what was fulfilled, expired and wasted, are not the ending."""
    gap = F.col("beginning") + F.col("inbound") - F.col("fulfilled") - F.col("expired") - F.col("waste") - F.col("ending")
    return ledger.where(F.abs(gap) > tolerance * F.greatest(F.lit(1.0), F.abs("ending")))


def with_costs(ledger: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with its costs and what exceeds the capacity of the day; null for a key without terms.

    terms: keys, holding_cost (a unit and day), shortage_cost, expired_cost, waste_cost (a unit), capacity, capacity_from, capacity_to (null:
    open).
    """
    rows = ledger.join(terms, keys, "left")
    held = F.coalesce(F.col("date") >= F.col("capacity_from"), F.lit(True)) & F.coalesce(F.col("date") <= F.col("capacity_to"), F.lit(True))
    over = F.when(held & F.col("capacity").isNotNull(), F.greatest(F.lit(0.0), F.col("maximum") - F.col("capacity"))).otherwise(0.0)
    costs = {"holding": ("ending", "holding_cost"), "short": ("shortage", "shortage_cost"), "expiry": ("expired", "expired_cost"), "wasting": ("waste", "waste_cost")}
    rows = rows.withColumns({f"cost_{name}": F.col(amount) * F.col(price) for name, (amount, price) in costs.items()}).withColumn("capacity_violation", over)
    return rows.select(*ledger.columns, "capacity_violation", *[f"cost_{name}" for name in costs])


def summarize(costed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: totals, first and last stock, costs (null where no day has them), fill rate, days of supply, days of stockout."""
    total = lambda c: F.sum(c).alias(c)
    out = costed.groupBy(*keys).agg(
        *[total(c) for c in ("demand", "fulfilled", "shortage", "expired", "waste", "inbound")], F.min_by("beginning", "date").alias("beginning"), F.max_by("ending", "date").alias("ending"), F.max("maximum").alias("maximum"),
        F.max("capacity_violation").alias("capacity_violation"), *[total(f"cost_{c}") for c in ("holding", "short", "expiry", "wasting")], F.count("*").alias("n_days"), F.count_if(F.col("shortage") > TOLERANCE).alias("n_stockout_days"),
        F.min(F.when(F.col("shortage") > TOLERANCE, F.col("date"))).alias("first_stockout"), F.max("at_risk").alias("at_risk"),
    )
    daily = F.col("demand") / F.col("n_days")
    costs = [F.col(f"cost_{c}") for c in ("holding", "short", "expiry", "wasting")]
    known: Column = costs[0].isNotNull() | costs[1].isNotNull() | costs[2].isNotNull() | costs[3].isNotNull()
    cost = sum((F.coalesce(c, F.lit(0.0)) for c in costs[1:]), F.coalesce(costs[0], F.lit(0.0)))
    return out.withColumns({"fill_rate": F.when(F.col("demand") > 0, F.col("fulfilled") / F.col("demand")).otherwise(1.0), "days_of_supply": F.when(daily > 0, F.col("ending") / daily), "cost_total": F.when(known, cost)})
