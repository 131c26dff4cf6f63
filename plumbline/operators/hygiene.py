"""Point-in-time hygiene: calendars, memberships, gaps, corporate actions, liquidity screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series
from .folds import TICK_CHECKS, bad_ticks
from .joins import as_of


def trading_day(day: Column) -> Column:
    return F.weekday(day) < 5


def session_phase(ts: Column, pre: int = 9 * 60, opens: int = 9 * 60 + 15, closes: int = 15 * 60 + 30) -> Column:
    """closed, pre_open or open by minute of day; weekends are closed."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (
        F.when(~trading_day(F.to_date(ts)), "closed").when((minute >= opens) & (minute < closes), "open").when((minute >= pre) & (minute < opens), "pre_open").otherwise("closed")
    )


def gaps(bars: DataFrame, minutes: int) -> DataFrame:
    """symbol, ts, missing: bars that lack between two of a day; half a bar rounds to even. Nights are no gap."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    step = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) / (60 * minutes)
    return bars.select("symbol", "ts", (F.bround(step) - 1).cast("long").alias("missing")).where("missing > 0")


def missing_days(bars: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """symbol, date of trading days between a symbol's first and last bar without one."""
    span = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("date")).where(trading_day(F.col("date")))
    if holidays is not None:
        days = days.join(holidays, "date", "left_anti")
    return days.join(bars.select("symbol", F.to_date("ts").alias("date")), ["symbol", "date"], "left_anti")


def covers(day: Column, start: str = "start", end: str = "end") -> Column:
    """Closed interval with an open end allowed."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (day <= F.col(end)))


def members_on(memberships: DataFrame, day: Column) -> DataFrame:
    return memberships.where(covers(day)).select("symbol").distinct()


def screened(stats: DataFrame, least_value: float, most_spread: float, excluded: list[str]) -> DataFrame:
    """Adds reasons (of low_value, wide_spread, excluded) and eligible to symbol, adv, spread."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("adv") < least_value, "low_value"),
            F.when(F.col("spread") > most_spread, "wide_spread"),
            F.when(F.col("symbol").isin(excluded), "excluded"),
        )
    )
    return stats.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def average_daily_value(bars: DataFrame) -> DataFrame:
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(F.col("close") * F.col("volume")).alias("value"))
    return days.groupBy("symbol").agg(F.avg("value").alias("adv"))


def coverage(bars: DataFrame) -> DataFrame:
    days = F.to_date("ts")
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_distinct(days).alias("days"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def back_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds adj_close: the close times the product of the factors of the symbol's actions (symbol, ex_date, factor)
    whose ex-date is later than the bar's day. The factors are multiplied up once per symbol, from the last date."""
    later = series("symbol", "ex_date").rowsBetween(0, Window.unboundedFollowing)
    steps = actions.groupBy("symbol", "ex_date").agg(F.sum(F.ln("factor")).alias("f")).withColumn("f", F.sum("f").over(later))
    # the step that holds on a day is that of the first ex-date after it
    marks = steps.select("symbol", F.col("ex_date").alias("day"), "f", F.lit(0).alias("is_bar"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    days = bars.select("symbol", F.to_date("ts").alias("day"), F.lit(None).cast("double").alias("f"), F.lit(1).alias("is_bar"), "ts")
    w = Window.partitionBy("symbol").orderBy("day", "is_bar").rowsBetween(1, Window.unboundedFollowing)
    known = marks.unionByName(days).withColumn("ahead", F.first("f", ignorenulls=True).over(w)).where("is_bar = 1")
    scale = known.select("symbol", "ts", F.exp(F.coalesce("ahead", F.lit(0.0))).alias("scale"))
    return bars.join(scale, ["symbol", "ts"]).withColumn("adj_close", F.col("close") * F.col("scale")).drop("scale")


def dead_dates(panel: DataFrame, least_share: float, most_alive: int) -> DataFrame:
    """Dates on which ceil(share of all symbols) or more are present but at most most_alive traded (volume > 0)."""
    names = panel.select(F.count_distinct("symbol").alias("n"))
    days = panel.groupBy("date").agg(F.count("*").alias("present"), F.sum(F.when(F.col("volume") > 0, 1).otherwise(0)).alias("alive"))
    return days.crossJoin(names).where((F.col("present") >= F.ceil(F.col("n") * least_share)) & (F.col("alive") <= most_alive)).select("date")


def isolated_outliers(x: str, w, reach: int = 10, low: float = 0.6, high: float = 1.7) -> Column:
    """Whether x is outside low..high times the median of the reach rows on both sides (a look ahead: cleaning only)."""
    around = F.array_sort(F.concat(F.collect_list(x).over(w.rowsBetween(-reach, -1)), F.collect_list(x).over(w.rowsBetween(1, reach))))
    n = F.size(around)
    middle = (F.get(around, F.floor((n - 1) / 2).cast("int")) + F.get(around, F.floor(n / 2).cast("int"))) / 2
    share = F.try_divide(F.col(x), middle)
    return F.coalesce((share < low) | (share > high), F.lit(False))


def calendar(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """date, trading, next_day, previous_day, opens, closes of days (date), weekdays but for holidays (date) being trading
    days; next and previous are strict and missing where days hold none; opens and closes are missing on other days.

    days is a calendar, a few thousand rows, so its order is one task's."""
    marked = days.select("date").distinct().join(holidays.select("date", F.lit(True).alias("_off")).distinct(), "date", "left")
    marked = marked.withColumn("trading", trading_day(F.col("date")) & F.col("_off").isNull()).drop("_off")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    day = F.when(F.col("trading"), F.col("date"))
    at = lambda minutes: F.when(F.col("trading"), F.timestamp_add("MINUTE", F.lit(minutes), F.col("date").cast("timestamp_ntz")))
    return marked.select(
        "date", "trading",
        F.min(day).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_day"),
        F.max(day).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_day"),
        at(9 * 60 + 15).alias("opens"), at(15 * 60 + 30).alias("closes"),
    )


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """First and last microsecond of a day in a zone, as UTC."""
    begin = F.to_utc_timestamp(day.cast("timestamp_ntz"), zone)
    return begin, F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp_ntz"), zone) - F.expr("interval 1 microsecond")


def quality_report(bars: DataFrame, start: str, stop: str, minutes: int, spike: float, checks: tuple[str, ...] = TICK_CHECKS) -> DataFrame:
    """symbol, expected, observed, bars, first, last, gaps, missing_days, bad_ticks, has_issues of every symbol's bars
    from start to stop, and a row of totals whose symbol is null.

    expected counts the weekdays from start to stop, observed the days with a bar; bad ticks fail one of checks. A symbol
    without bars in the range has no row: unread() finds it."""
    window = bars.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))
    days = F.sequence(F.lit(start).cast("timestamp_ntz").cast("date"), F.lit(stop).cast("timestamp_ntz").cast("date"))
    expected = F.size(F.filter(days, trading_day)).cast("long")
    parts = [
        gaps(window, minutes).groupBy("symbol").agg(F.count("*").alias("gaps")),
        missing_days(window).groupBy("symbol").agg(F.count("*").alias("missing_days")),
        bad_ticks(window, spike, checks).groupBy("symbol").agg(F.count("reason").alias("bad_ticks")),
    ]
    out = coverage(window).select("symbol", F.col("days").alias("observed"), "bars", "first", "last")
    for p in parts:
        out = out.join(p, "symbol", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gaps", "missing_days", "bad_ticks")})
    sums = [F.sum(c).alias(c) for c in ("observed", "bars", "gaps", "missing_days", "bad_ticks")]
    total = out.agg(*sums, F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).where("n > 0")
    total = total.withColumns({"symbol": F.lit(None).cast("string"), "expected": expected * F.col("n")}).drop("n")
    issues = (F.col("gaps") > 0) | (F.col("missing_days") > 0) | (F.col("bad_ticks") > 0) | (F.col("observed") < F.col("expected"))
    return out.withColumn("expected", expected).unionByName(total).withColumn("has_issues", issues)


def unread(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol of the requested ones (symbol) that no bar has: a backfill with any such has failed."""
    return requested.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def action_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, ex_date, factor, volume_factor of actions (symbol, ex_date, kind, ratio, amount) that have a bar before
    their date.

    A split or bonus divides prices by its ratio and multiplies volumes by it. A dividend scales prices by what it leaves
    of the raw close of the last bar before its date; one that leaves nothing is an error, as is a ratio that isn't positive."""
    close = bars.select("symbol", F.expr("timestampadd(DAY, 1, date_trunc('DAY', ts))").alias("ts"), F.struct("ts", "close").alias("_c"))
    close = close.groupBy("symbol", "ts").agg(F.max("_c")["close"].alias("_close"))
    met = as_of(actions.withColumn("ts", F.col("ex_date").cast("timestamp_ntz")), close, values=("_close",)).where("_close is not null")
    dividend = F.col("kind") == "dividend"
    bad = F.raise_error(F.concat(F.lit("action of "), F.col("symbol"), F.lit(" leaves no price"))).cast("double")
    factor = F.when(dividend & (F.col("amount") < F.col("_close")), 1 - F.col("amount") / F.col("_close")).when(~dividend & (F.col("ratio") > 0), 1 / F.col("ratio")).otherwise(bad)
    return met.select("symbol", "ex_date", factor.alias("factor"), F.when(dividend, 1.0).otherwise(F.col("ratio")).alias("volume_factor"))


def adjusted_bars(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """bars with prices and volume scaled by the product of the factors of all later ex-dates; volumes round half to even."""
    prices = back_adjusted(bars, factors.select("symbol", "ex_date", "factor")).withColumn("_p", F.try_divide("adj_close", "close"))
    both = back_adjusted(prices.drop("adj_close"), factors.select("symbol", "ex_date", F.col("volume_factor").alias("factor"))).withColumn("_v", F.try_divide("adj_close", "close"))
    scaled = {c: F.col(c) * F.col("_p") for c in ("open", "high", "low", "close")}
    return both.withColumns(scaled | {"volume": F.bround(F.col("volume") * F.col("_v")).cast("long")}).drop("_p", "_v", "adj_close")


def action_list(raw: DataFrame, words: dict[str, str], pattern: str = "dd-MMM-yyyy") -> DataFrame:
    """symbol, ex_date, kind, quarter of raw (symbol, subject, ex): the kind is the first whose word the subject holds, in
    any case; rows of no kind or without a date are dropped, repeats too. quarter is the window that a fetch would ask."""
    subject = F.lower("subject")
    kind = None
    for k, word in words.items():
        kind = F.when(subject.contains(word), k) if kind is None else kind.when(subject.contains(word), k)
    day = F.try_to_date("ex", pattern)
    rows = raw.select("symbol", day.alias("ex_date"), kind.alias("kind")).where("ex_date is not null and kind is not null").distinct()
    return rows.withColumn("quarter", F.to_date(F.date_trunc("quarter", "ex_date")))


def memberships(raw: DataFrame) -> DataFrame:
    """symbol, start, end of records of text (symbol, start, end: ISO days); an empty or missing end is open, a record
    without a start is dropped."""
    return raw.select("symbol", F.to_date(F.nullif("start", F.lit(""))).alias("start"), F.to_date(F.nullif("end", F.lit(""))).alias("end")).where("start is not null")
