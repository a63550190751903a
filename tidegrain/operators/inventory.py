"""Lots: one-day allocation first expired first out, day-by-day ledgers, summaries and risk over scenarios."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["store_key", "ingredient_id"]
START, NEVER = -(1 << 30), 1 << 30  # as days: what is on hand before the first one, and the expiry of what does not expire


def fefo_order() -> list[Column]:
    return [F.col("expiry_date").asc_nulls_last(), F.col("received_date").asc_nulls_last(), F.col("lot_id")]


def is_expired(expiry: Column, day: Column, inclusive: bool = True) -> Column:
    """Expired after the date (inclusive: the date itself still counts), or from it on; no date never expires."""
    return F.coalesce(expiry < day if inclusive else expiry <= day, F.lit(False))


def allocate_day(lots: DataFrame, demand: DataFrame, keys: list[str]) -> DataFrame:
    """Lots with what of the day's demand each serves: running supply cut at the demand, no loop."""
    w = Window.partitionBy(*keys).orderBy(*fefo_order()).rowsBetween(Window.unboundedPreceding, 0)
    rows = lots.join(demand, keys, "left").withColumn("after_", F.sum("quantity").over(w))
    used = F.greatest(F.lit(0.0), F.least("after_", F.coalesce("demand", F.lit(0.0))) - (F.col("after_") - F.col("quantity")))
    return rows.withColumn("used", used).withColumn("left", F.col("quantity") - F.col("used")).drop("after_")


def by_dates(lots: DataFrame, keys: list[str]) -> DataFrame:
    """Lots of equal keys and dates as one: first expired first out serves them next to each other, so no balance changes."""
    return lots.groupBy(*keys, "expiry_date", "received_date").agg(F.min("lot_id").alias("lot_id"), F.sum("quantity").alias("quantity"))


def ledger(lots: DataFrame, demand: DataFrame, inbound: DataFrame, keys: list[str]) -> DataFrame:
    """Daily ledger per key: inbound, expiry, first-expired-first-out service, balances. Keys are independent.

    lots: keys, lot_id, quantity, expiry_date, received_date. inbound: the same with arrival_date. demand: keys, date, demand, the days
    to simulate; lots that arrive on another day are not counted. Lots of equal dates are one before a key's days are folded, so a fold
    has as many entries as days and pairs of dates, however many lots there are, and carries one quantity for each expiry date.
    """
    lots, inbound = by_dates(lots, keys), by_dates(inbound, [*keys, "arrival_date"])
    none = F.lit(None).cast("double")
    expiry = F.coalesce(F.unix_date("expiry_date"), F.lit(NEVER)).alias("expiry")
    events = (
        lots.select(*keys, F.lit(START).alias("day"), expiry, "quantity", none.alias("demand"))
        .unionByName(inbound.select(*keys, F.unix_date("arrival_date").alias("day"), expiry, "quantity", none.alias("demand")))
        .unionByName(demand.select(*keys, F.unix_date("date").alias("day"), F.lit(NEVER).alias("expiry"), none.alias("quantity"), F.coalesce(F.col("demand").cast("double"), F.lit(0.0)).alias("demand")))
    )
    kinds = {f.name: f.dataType.simpleString() for f in demand.schema.fields}
    columns = ["beginning", "inbound", "maximum", "expired", "demand", "fulfilled", "ending"]
    fold = lambda key, rows: pd.DataFrame({**dict(zip(keys, key, strict=True)), **fold_days(rows, columns)})
    lines = events.groupBy(*keys).applyInPandas(fold, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "day int", *[f"{c} double" for c in columns]]))
    return lines.select(*keys, F.date_from_unix_date("day").alias("date"), *columns, (F.col("demand") - F.col("fulfilled")).alias("shortage"))


def fold_days(rows: pd.DataFrame, columns: list[str]) -> dict[str, list]:
    """The days of one key in order. ``rows``: arrivals (day, expiry, quantity) and days to simulate (day, demand)."""
    asked = rows["demand"].notna()
    arriving: dict[int, list[tuple[int, float]]] = {}
    for day, expiry, quantity in rows.loc[~asked, ["day", "expiry", "quantity"]].sort_values(["day", "expiry"]).itertuples(index=False):
        arriving.setdefault(day, []).append((expiry, quantity))
    stock: dict[int, float] = {}  # quantity by expiry date
    order: list[int] = []  # its keys, ascending

    def add(found: list[tuple[int, float]]) -> float:
        for expiry, quantity in found:
            if expiry not in stock:
                bisect.insort(order, expiry)
            stock[expiry] = stock.get(expiry, 0.0) + quantity
        return sum(q for _, q in found)

    add(arriving.get(START, []))
    out: dict[str, list] = {"day": [], **{c: [] for c in columns}}
    for day, want in rows.loc[asked, ["day", "demand"]].sort_values("day").itertuples(index=False):
        beginning, arrived = sum(stock.values()), add(arriving.get(day, []))
        expired = 0.0
        while order and order[0] < day:
            expired += stock.pop(order.pop(0))
        left = want
        while order and left > 0:
            held = stock[order[0]]
            if held > left:
                stock[order[0]], left = held - left, 0.0
            else:
                left -= held
                del stock[order.pop(0)]
        for name, value in zip(out, (day, beginning, arrived, beginning + arrived, expired, want, want - left, sum(stock.values())), strict=True):
            out[name].append(value)
    return out


def unbalanced(lines: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Ledger lines whose quantities do not add up."""
    return lines.where(F.abs(F.col("beginning") + F.col("inbound") - F.col("fulfilled") - F.col("expired") - F.col("ending")) > tolerance)


def summarize(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: totals, fill rate (1 without demand), greatest stock, first day of shortage."""
    return lines.groupBy(*keys).agg(
        F.sum("demand").alias("demand"), F.sum("fulfilled").alias("fulfilled"), F.sum("shortage").alias("shortage"), F.sum("expired").alias("expired"), F.max("maximum").alias("maximum"),
        F.coalesce(F.sum("fulfilled") / F.nullif(F.sum("demand"), F.lit(0.0)), F.lit(1.0)).alias("fill_rate"), F.min(F.when(F.col("shortage") > 1e-9, F.col("date"))).alias("first_stockout"),
    )


def risk(summaries: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Over weighted scenarios: probability of a stockout, expected shortage and fill rate."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return summaries.groupBy(*keys).agg((F.sum(w * (F.col("shortage") > 1e-9).cast("double")) / F.sum(w)).alias("p_stockout"), mean("shortage").alias("shortage"), mean("fill_rate").alias("fill_rate"), mean("expired").alias("expired"))
