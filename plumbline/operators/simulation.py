"""Simulations of books whose costs depend on the equity they leave, rotation schedules, and checks of one engine by
another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series
from .folds import banded_weights, streamed
from .portfolio import fill_cost

#: Charges of delivery trades as shares of the turnover, by leg.
DELIVERY = {"tax": 0.001, "stamp_buy": 0.00015, "exchange": 0.00003, "levy": 0.000001, "service": 0.18, "brokerage": 0.0}
#: Charges of fund trades as shares of the turnover, and one in money for a sale.
FUND = {"exchange": 0.0000325, "levy": 0.000001, "stamp_buy": 0.00015, "service": 0.18, "flat_sell": 15.93}


def delivery_rates(charges: dict[str, float] = DELIVERY) -> dict[str, float]:
    """Rates of a purchase, a sale and both: the sale has no stamp; the service tax is on brokerage, exchange and levy."""
    service = charges["service"] * (charges["brokerage"] + charges["exchange"] + charges["levy"])
    sell = charges["tax"] + charges["exchange"] + charges["levy"] + service + charges["brokerage"]
    buy = sell + charges["stamp_buy"]
    return {"buy": buy, "sell": sell, "round_trip": buy + sell}


def fund_cost(delta, spread_bps, tax_bps, charges: dict[str, float] = FUND):
    """Cost of buying (delta > 0) or selling a fund for that much money: half the spread, exchange and levy with service
    tax on both; stamp when buying; tax and a flat charge when selling. Numbers; fund_cost_column() is for columns."""
    value = abs(delta)
    toll = value * (charges["exchange"] + charges["levy"])
    side = value * charges["stamp_buy"] if delta > 0 else value * tax_bps / 1e4 + charges["flat_sell"]
    return value * spread_bps / 2 / 1e4 + toll + charges["service"] * toll + side


def fund_cost_column(value: Column, buys: bool, spread_bps: Column, tax_bps: Column, charges: dict[str, float] = FUND) -> Column:
    toll = value * (charges["exchange"] + charges["levy"])
    side = value * charges["stamp_buy"] if buys else value * tax_bps / 1e4 + charges["flat_sell"]
    return value * spread_bps / 2 / 1e4 + toll + charges["service"] * toll + side


def round_trip_bps(value: Column, spread_bps: Column, tax_bps: Column) -> Column:
    """Cost of buying and selling that much of a fund, of the value, in hundredths of a percent; missing without a value."""
    both = fund_cost_column(value, True, spread_bps, tax_bps) + fund_cost_column(value, False, spread_bps, tax_bps)
    return F.when(value > 0, both / value * 1e4)


def holding_bps(ratio: Column, days: Column) -> Column:
    """What a yearly expense ratio takes in days."""
    return ratio * days / 365.0 * 1e4


def round_trip_share(price: Column, quantity: Column, slip_bps: Column) -> Column:
    """Cost of a purchase and a sale of an order, slippage both times, as a share of its value."""
    charges = fill_cost(F.lit("buy"), price, quantity)["total"] + fill_cost(F.lit("sell"), price, quantity)["total"]
    return F.try_divide(charges, price * quantity) + 2 * slip_bps / 1e4


def cash_price(day: Column, yearly: float) -> Column:
    """Price of cash that grows by yearly over 252 days, day counted from 0."""
    return F.pow(F.lit((1.0 + yearly) ** (1.0 / 252.0)), day)


def filled_grid(prices: DataFrame, symbol: str = "symbol") -> DataFrame:
    """date, symbol, price of every symbol on every date from the first on which all have one; a missing price is the
    last one before. prices: date, symbol, price."""
    days = prices.agg(F.sort_array(F.collect_set("date")).alias("days"))  # the calendar: one row
    names = prices.select(symbol).distinct()
    grid = names.join(F.broadcast(days)).select(F.explode("days").alias("date"), symbol)
    known = F.last("price", ignorenulls=True).over(series(symbol, "date").rowsBetween(Window.unboundedPreceding, 0))
    dense = grid.join(prices, ["date", symbol], "left").withColumn("price", known)
    begin = dense.where("price is not null").groupBy(symbol).agg(F.min("date").alias("d")).agg(F.max("d").alias("begin"))
    return dense.join(F.broadcast(begin)).where("date >= begin").select("date", symbol, "price")


def simulated(rows: DataFrame, capital: float, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """by, date, equity of books that are rebalanced to a schedule of weights, net of costs.

    rows: by, date, symbol, price, weight, spread_bps, tax_bps; every symbol of a book on each of its dates; weight is
    missing on a date without rebalancing. Legs drift with their prices; on a rebalancing date each is traded to its
    weight of the equity, the costs are paid from the equity and all legs are scaled to what is left. Before the first
    such date the equity is the capital. A book is a sorted run of rows that streams through a task, which holds a date.
    """
    keys = [*by, "date"]
    schema = rows.select(*keys).schema.add("equity", "double")
    names = [*keys, "symbol", "price", "weight", "spread_bps", "tax_bps"]
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, day, held = None, None, []
        legs: dict = {}
        last: dict = {}
        equity, begun = capital, False

        def close() -> float:
            nonlocal equity, begun
            for s, price, *_ in held:
                if legs.get(s):
                    legs[s] *= price / last[s]
                last[s] = price
            equity = sum(legs.values()) or equity
            if any(w is not None for _, _, w, _, _ in held):
                begun = True
                target = {s: (w or 0.0) * equity for s, _, w, _, _ in held}
                cost = 0.0
                for s, _, _, spread, tax in held:
                    delta = target[s] - legs.get(s, 0.0)
                    if abs(delta) >= 1e-9:
                        cost += fund_cost(delta, spread, tax)
                equity -= cost
                total = sum(target.values())
                for s, t in target.items():
                    legs[s] = t * (equity / total if total else 1.0)
            return equity if begun else capital

        done: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (row[:n] != book or row[n] != day):
                    done.append((*book, day, close()))
                    held = []
                if row[:n] != book:
                    book, equity, begun = row[:n], capital, False
                    legs.clear()
                    last.clear()
                day = row[n]
                held.append(row[n + 1 :])
            yield _frame(done, b, keys)
            done = []
        if held:
            yield _frame([(*book, day, close())], b, keys)

    return rows.select(*names).repartition(*by).sortWithinPartitions(*keys, "symbol").mapInArrow(run, schema)


def _frame(rows: list[tuple], like: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    kinds = [like.schema.field(k).type for k in keys] + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*keys, "equity"])


def rotation_weights(ranked: DataFrame, k: int, haircut: float, cash: str) -> DataFrame:
    """date, symbol, weight of a rotation's rebalancing dates: the k names with the largest score share the date's budget
    by inverse volatility, cash has the rest.

    ranked: date, symbol, score, vol, risk_off; a name without a score is not chosen, and a date without any is all
    cash. The budget is 1, less haircut where risk_off. Equal scores go by name."""
    on = Window.partitionBy("date")
    place = F.when(F.col("score").isNotNull(), F.row_number().over(on.orderBy(F.desc_nulls_last("score"), "symbol")))
    inverse = F.when(F.col("place") <= k, 1 / F.greatest(F.coalesce("vol", F.lit(0.0)), F.lit(1e-6)))
    held = ranked.withColumn("place", place).withColumn("i", inverse)
    budget = 1 - F.when(F.col("risk_off"), haircut).otherwise(0.0)
    held = held.select("date", "symbol", F.coalesce(budget * F.col("i") / F.sum("i").over(on), F.lit(0.0)).alias("weight"))
    rest = held.groupBy("date").agg((1 - F.sum("weight")).alias("weight")).select("date", F.lit(cash).alias("symbol"), "weight")
    return held.unionByName(rest)


def banded_book(book: DataFrame, band: float) -> DataFrame:
    """date, symbol, held, r: holdings of every name on every date of book (date, symbol, weight, close) by
    banded_weights(), and the return to the name's next row of the grid; a missing weight is 0, a missing return too."""
    days = book.agg(F.sort_array(F.collect_set("date")).alias("days"))  # the rebalancing dates: one row
    grid = book.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("days").alias("date"))
    dense = grid.join(book.select("date", "symbol", "weight", "close"), ["date", "symbol"], "left")
    r = F.coalesce(F.try_divide(F.lead("close").over(series("symbol", "date")), "close") - 1, F.lit(0.0))
    return banded_weights(dense.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "r": r}), band).select("date", "symbol", "held", "r")


def book_returns(held: DataFrame, rate: float) -> DataFrame:
    """date, turnover, cost, gross, net of holdings (date, symbol, held, r): the window form."""
    moved = held.withColumn("dw", F.abs(F.col("held") - F.coalesce(F.lag("held").over(series("symbol", "date")), F.lit(0.0))))
    out = moved.groupBy("date").agg(F.sum("dw").alias("turnover"), F.sum(F.col("held") * F.col("r")).alias("gross"))
    return out.withColumn("cost", rate * F.col("turnover")).withColumn("net", F.col("gross") - F.col("cost"))


def book_returns_by_loop(held: DataFrame, rate: float) -> DataFrame:
    """date, net of the same holdings by a second engine: one pass over the dates that keeps the book."""

    def make():
        book: dict = {}
        day, net = None, 0.0

        def step(date, symbol, weight, r):
            nonlocal day, net
            if date != day:
                day, net = date, 0.0
            net += weight * r - rate * abs(weight - book.get(symbol, 0.0))
            book[symbol] = weight
            return (net,)

        return step

    one = held.withColumn("book", F.lit(0))
    run = streamed(one, make, ["date", "symbol", "held", "r"], {"net": "double"}, by=("book",), order=("date", "symbol"))
    return run.groupBy("date").agg(F.max_by("net", "symbol").alias("net"))


def disagreement(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """One row: rows, and the largest absolute difference of every column between two engines' results; a row that only
    one of them has makes rows negative, so that it can't pass for agreement."""
    right = b.select(*on, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_there"))
    both = a.withColumn("_here", F.lit(1)).join(right, on, "full")
    lost = F.sum(F.when(F.col("_here").isNull() | F.col("_there").isNull(), 1).otherwise(0))
    differ = [F.coalesce(F.max(F.abs(F.col(c) - F.col(f"_{c}"))), F.lit(0.0)).alias(c) for c in columns]
    return both.agg(F.when(lost > 0, -lost).otherwise(F.count("*")).alias("rows"), *differ)


def equity_by_loop(held: DataFrame, capital: float) -> DataFrame:
    """Adds filled, cash, equity: the event-driven engine, bar by bar, of positions (held) filled at each bar's open."""

    def make():
        position, cash = 0, capital

        def step(opens, close, want):
            nonlocal position, cash
            delta = want - position
            if delta:
                turnover = opens * abs(delta)
                brokerage, fee, levy = min(turnover * 0.0003, 20.0), turnover * 0.0000297, turnover * 0.000001
                cost = brokerage + (turnover * 0.00003 if delta > 0 else turnover * 0.00025) + fee + levy + (brokerage + fee + levy) * 0.18
                cash -= opens * delta + cost
                position = want
            return int(delta != 0), cash, cash + position * close

        return step

    return streamed(held, make, ["open", "close", "held"], {"filled": "int", "cash": "double", "equity": "double"})
