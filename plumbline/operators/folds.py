"""Recursions along a symbol's rows: smoothed indicators, CUSUM, tick filter, holdings.

Each symbol is a sorted run of rows that streams through a task, so that a symbol of any length needs the memory of one
batch and of the recursion's few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import last_n

_KINDS = {"double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def streamed(df: DataFrame, make: Callable[[], Callable[..., tuple]], inputs: list[str], out: dict[str, str], by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds the columns out to df. make() begins a group: the function that it returns takes a row's inputs, row by row in
    order, and returns the row's new values."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in out.items())])
    kinds = [_KINDS[v] for v in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for b in batches:
            made = []
            keys = zip(*(b.column(c).to_pylist() for c in by), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in inputs), strict=True)
            for k, row in zip(keys, rows, strict=True):
                if step is None or k != key:
                    key, step = k, make()
                made.append(step(*row))
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *out])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def ema(n: int) -> Callable[[float | None], float | None]:
    """Exponential average with weight 2 / (n + 1), begun by the mean of the first n values; missing before."""
    held, count = 0.0, 0

    def push(x: float | None) -> float | None:
        nonlocal held, count
        if x is None:
            return None
        count += 1
        if count <= n:
            held += x / n
            return held if count == n else None
        held += (x - held) * 2 / (n + 1)
        return held

    return push


def rsi(bars: DataFrame, n: int) -> DataFrame:
    """Wilder's relative strength: averages of gains and losses begun by a plain mean; 0 without any change."""

    def make():
        last, count, up, down = None, 0, 0.0, 0.0

        def step(close):
            nonlocal last, count, up, down
            change, last = (None if last is None or close is None else close - last), close
            if change is None:
                return (None,)
            count += 1
            keep = 1.0 if count <= n else (n - 1) / n
            up, down = up * keep + max(change, 0) / n, down * keep + max(-change, 0) / n
            if count < n:
                return (None,)
            return (100 * up / (up + down) if up + down else 0.0,)

        return step

    return streamed(bars, make, ["close"], {"rsi": "double"})


def macd(bars: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """Difference of two exponential averages, and its distance from its own average."""

    def make():
        a, b, own = ema(fast), ema(slow), ema(signal)

        def step(close):
            x, y = a(close), b(close)
            line = None if x is None or y is None else x - y
            mean = own(line)
            return line, None if mean is None else line - mean

        return step

    return streamed(bars, make, ["close"], {"macd": "double", "histogram": "double"})


def directional_index(bars: DataFrame, n: int) -> DataFrame:
    """Wilder's directional index of smoothed up and down moves; both are divided by the same true range, which cancels."""

    def make():
        last, count, plus, minus = None, 0, 0.0, 0.0

        def step(high, low):
            nonlocal last, count, plus, minus
            before, last = last, (high, low)
            if before is None:
                return (None,)
            up, down = high - before[0], before[1] - low
            count += 1
            keep = 1.0 if count <= n else 1 - 1 / n
            plus, minus = plus * keep + (up if up > down and up > 0 else 0), minus * keep + (down if down > up and down > 0 else 0)
            return (100 * abs(plus - minus) / (plus + minus) if count >= n and plus + minus else None,)

        return step

    return streamed(bars, make, ["high", "low"], {"dx": "double"})


def frac_diff_weights(d: float, threshold: float) -> list[float]:
    """Weights of (1 - lag)^d until one is smaller than threshold."""
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= threshold:
        w.append(nxt)
    return w


def frac_diff(x: str, d: float, threshold: float) -> Column:
    """Fixed-width fractional difference; missing until the window is full."""
    w = frac_diff_weights(d, threshold)
    frame = F.collect_list(x).over(last_n(len(w)))
    weights = F.array(*(F.lit(v) for v in reversed(w)))
    total = F.aggregate(F.zip_with(frame, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.count(x).over(last_n(len(w))) == len(w), total)


TICK_CHECKS = ("non_positive", "negative_volume", "inconsistent", "spike")


def bad_ticks(bars: DataFrame, most: float, checks: tuple[str, ...] = TICK_CHECKS) -> DataFrame:
    """Adds reason: the first of checks that a bar fails, non_positive, negative_volume, inconsistent, spike (the close is
    over most percent from that of the last bar that was kept), or missing for good bars.

    After a kept close of zero or NaN every close is a spike; a missing one is none, and nothing after it until the next."""
    prices, volume, range_, spike = (c in checks for c in TICK_CHECKS)

    def make():
        last = None

        def step(c, o=None, h=None, low=None, v=None):
            nonlocal last
            why = None
            if prices and min(o, h, low, c) <= 0:
                why = "non_positive"
            elif volume and v < 0:
                why = "negative_volume"
            elif range_ and (h < max(o, c, low) or low > min(o, c)):
                why = "inconsistent"
            elif spike and None not in (last, c) and (last == 0 or not abs(c / last - 1) * 100 <= most):
                why = "spike"
            if why is None:
                last = c
            return (why,)

        return step

    return streamed(bars, make, ["close", "open", "high", "low", "volume"] if prices or volume or range_ else ["close"], {"reason": "string"})


def cusum(bars: DataFrame, threshold: float, x: str = "ret") -> DataFrame:
    """Adds event: 1 or -1 where the symmetric cumulative sum of x passes the threshold, else 0.

    The side that fires begins anew; when up fires, down keeps its sum."""

    def make():
        up = down = 0.0

        def step(r):
            nonlocal up, down
            if r is None or r != r:
                return (0,)
            up, down = max(0.0, up + r), min(0.0, down + r)
            if up > threshold:
                up = 0.0
                return (1,)
            if down < -threshold:
                down = 0.0
                return (-1,)
            return (0,)

        return step

    return streamed(bars, make, [x], {"event": "int"})


def held_weights(targets: DataFrame, band: float, most: float) -> DataFrame:
    """Adds held: the weight moves to its target (weight; date, symbol) only by more than band times most."""
    return _holding(targets, lambda want, held: band * most)


def banded_weights(targets: DataFrame, band: float) -> DataFrame:
    """Adds held: the weight moves to its target (weight; date, symbol) only by more than band times the larger of both,
    so that a name which enters or leaves always trades. targets has a row for every name on every date."""
    return _holding(targets, lambda want, held: band * max(abs(want), abs(held)))


def _holding(targets: DataFrame, least: Callable[[float, float], float]) -> DataFrame:
    def make():
        held = 0.0

        def step(want):
            nonlocal held
            if abs(want - held) > least(want, held):
                held = want
            return (held,)

        return step

    return streamed(targets, make, ["weight"], {"held": "double"}, order=("date",))
