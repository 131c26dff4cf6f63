"""Relations between series: unit-root tests, differencing orders, pairs that stay together and books of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import last_n, series
from .folds import frac_diff

#: Response surfaces of the 5 % critical values of Dickey-Fuller statistics with a constant, by number of
#: series: b0 + b1 / n + b2 / n^2 + b3 / n^3.
CRITICAL = {1: (-2.86154, -2.8903, -4.234, -40.040), 2: (-3.33613, -6.1101, -6.823, 0.0)}


def log_price(x: str | Column) -> Column:
    """Logarithm of a positive price, else missing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.ln(x))


def critical(n: Column, of: int = 1) -> Column:
    b = CRITICAL[of]
    return b[0] + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)


def dickey_fuller(df: DataFrame, x: str, by: list[str], order: str, of: int = 1) -> DataFrame:
    """by, n, statistic, critical, stationary: the t statistic of the slope of x's changes on x before them, with a constant
    and no further lags, against the 5 % critical value; missing with fewer than 4 changes or a constant x.

    The regression is sums over a lag, so that a group of any length is one aggregate."""
    before = F.lag(x).over(Window.partitionBy(*by).orderBy(order))
    pairs = df.select(*by, before.alias("_b"), (F.col(x) - before).alias("_d")).where("_b is not null and _d is not null")
    g = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("_d", "_b").alias("_s"), F.regr_sxx("_d", "_b").alias("_xx"),
        F.regr_syy("_d", "_b").alias("_yy"), F.regr_sxy("_d", "_b").alias("_xy"),
    )
    rest = F.greatest(F.col("_yy") - F.col("_s") * F.col("_xy"), F.lit(0.0)) / (F.col("n") - 2)
    t = F.when((F.col("n") > 3) & (F.col("_xx") > 0), F.try_divide("_s", F.sqrt(F.try_divide(rest, F.col("_xx")))))
    out = g.select(*by, "n", t.alias("statistic"), critical(F.col("n"), of).alias("critical"))
    return out.withColumn("stationary", F.col("statistic") < F.col("critical"))


def least_difference(df: DataFrame, x: str, orders: list[float], threshold: float, order: str = "ts") -> DataFrame:
    """symbol, d: the smallest of the orders at which the fractionally differenced x is stationary; missing if none is."""
    tried = None
    for d in orders:
        one = df.withColumn("_x", frac_diff(x, d, threshold)).where("_x is not null").withColumn("d", F.lit(float(d)))
        found = dickey_fuller(one, "_x", ["symbol", "d"], order)
        tried = found if tried is None else tried.unionByName(found)
    return tried.groupBy("symbol").agg(F.min(F.when(F.col("stationary"), F.col("d"))).alias("d"))


def named_pairs(prices: DataFrame) -> DataFrame:
    """date, a, b, x, y: log prices of every two names (a before b) on every date that both have one. prices: date,
    symbol, close.

    Dates are the join's key, so a date's names meet in one task: the names are a universe of some thousands at most."""
    p = prices.select("date", "symbol", log_price("close").alias("x")).where("x is not null")
    other = p.select("date", F.col("symbol").alias("b"), F.col("x").alias("y"))
    return p.withColumnRenamed("symbol", "a").join(other, "date").where("a < b")


def cointegrated(pairs: DataFrame, k: int) -> DataFrame:
    """a, b, slope, statistic of the k pairs whose residual of x on y has the most negative Dickey-Fuller statistic."""
    fit = pairs.groupBy("a", "b").agg(F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("cut"))
    rest = pairs.join(fit, ["a", "b"]).withColumn("e", F.col("x") - F.col("slope") * F.col("y") - F.col("cut"))
    found = dickey_fuller(rest, "e", ["a", "b"], "date", of=2).where("statistic is not null")
    return found.join(fit, ["a", "b"]).orderBy("statistic", "a", "b").limit(k).select("a", "b", "slope", "statistic", "stationary")


def spread_book(pairs: DataFrame, ends: DataFrame, n: int, most: float) -> DataFrame:
    """date, pairs, ret: the mean over pairs of position times the spread's change to the next end (ends: date).

    At an end a pair's spread x - slope * y is fitted on its last n dates; the position is minus its score, at most most
    in size; a pair without n dates or without spread has none."""
    w = series("symbol", "date")
    s = pairs.withColumn("symbol", F.concat_ws("|", "a", "b"))
    frame = last_n(n, w)
    slope = F.regr_slope("x", "y").over(frame)
    s = s.withColumns({"slope": F.when(F.count("x").over(frame) == n, slope), "mx": F.avg("x").over(frame), "my": F.avg("y").over(frame)})
    s = s.withColumns({"vx": F.var_samp("x").over(frame), "vy": F.var_samp("y").over(frame), "c": F.covar_samp("x", "y").over(frame)})
    at = s.join(F.broadcast(ends), "date", "left_semi")
    variance = F.col("vx") + F.col("slope") * F.col("slope") * F.col("vy") - 2 * F.col("slope") * F.col("c")
    score = F.try_divide(F.col("x") - F.col("mx") - F.col("slope") * (F.col("y") - F.col("my")), F.sqrt(F.when(variance > 1e-12, variance)))
    position = F.greatest(F.lit(-most), F.least(F.lit(most), -score))
    change = F.lead("x").over(w) - F.col("x") - F.col("slope") * (F.lead("y").over(w) - F.col("y"))
    held = at.withColumn("r", position * change).where("r is not null")
    return held.groupBy("date").agg(F.count("*").alias("pairs"), F.avg("r").alias("ret"))


class SumTree:
    """Weights with the sums of every WIDE of them, of every WIDE of those sums, and so on up to a single node."""

    WIDE = 64

    def __init__(self, weights):
        import numpy as np

        self.levels = [np.array(weights, float)]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            padded = np.zeros(-(-len(last) // self.WIDE) * self.WIDE)
            padded[: len(last)] = last
            self.levels[-1] = padded
            self.levels.append(padded.reshape(-1, self.WIDE).sum(1))

    def set(self, at, weights) -> None:
        """Replaces the weights at these places; sums above are added up anew, so that no error builds up."""
        import numpy as np

        self.levels[0][at] = weights
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            at = np.unique(at // self.WIDE)
            above[at] = below.reshape(-1, self.WIDE)[at].sum(1)

    def find(self, share: float) -> int:
        """The place where the running sum passes share (0 to 1) of all."""
        import numpy as np

        target, at = share * float(self.levels[-1][0]), 0
        for level in self.levels[-2::-1]:
            sums = np.cumsum(level[at * self.WIDE : (at + 1) * self.WIDE])
            k = min(int(np.searchsorted(sums, target, "right")), int(np.searchsorted(sums, sums[-1], "left")))
            target -= float(sums[k - 1]) if k else 0.0
            at = at * self.WIDE + k
        return at


def sequence_of_draws(start, stop, seed: int):
    """Places of as many labels (start and stop positions) as there are, each drawn with chances by its average uniqueness
    among those drawn before.

    A draw changes only the chances of labels that overlap the drawn one, and a sum tree over the labels finds the next,
    so that a draw costs the overlapping labels and a few nodes instead of all labels."""
    import numpy as np

    a, b = np.asarray(start, np.int64), np.asarray(stop, np.int64)
    a, b = a - a.min(), b - a.min()
    rng = np.random.default_rng(seed)
    order = np.argsort(a, kind="stable")
    sorted_a, longest = a[order], int((b - a).max())
    held = np.zeros(int(b.max()) + 1)
    tree = SumTree(np.ones(len(a)))
    drawn = np.empty(len(a), np.int64)
    for k in range(len(a)):
        i = tree.find(rng.random())
        drawn[k] = i
        held[a[i] : b[i] + 1] += 1
        lo, hi = np.searchsorted(sorted_a, a[i] - longest), np.searchsorted(sorted_a, b[i], "right")
        near = order[lo:hi]
        near = near[b[near] >= a[i]]
        first = int(a[near].min())
        sums = np.concatenate(([0.0], np.cumsum(1 / (held[first : int(b[near].max()) + 1] + 1))))
        tree.set(near, (sums[b[near] + 1 - first] - sums[a[near] - first]) / (b[near] + 1 - a[near]))
    return drawn


def sequential_draws(spans: DataFrame, seed: int, by: str = "symbol") -> DataFrame:
    """symbol, draw, id: as many labels of each symbol as it has, drawn with chances by their average uniqueness among those
    drawn before. spans: symbol, id, start, stop (positions).

    Every draw depends on those before it, so a symbol is a group of one task: meant for the labels of a strategy."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        drawn = sequence_of_draws(p["start"], p["stop"], abs(hash_of(f"{seed}|{p[by].iloc[0]}")))
        return pd.DataFrame({by: p[by].iloc[0], "draw": range(len(p)), "id": p["id"].to_numpy()[drawn]})

    return spans.where("start is not null and stop >= start").groupBy(by).applyInPandas(run, f"{by} string, draw int, id long")


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def draw_uniqueness(draws: DataFrame, spans: DataFrame) -> DataFrame:
    """symbol, uniqueness: mean over the drawn labels (symbol, draw, id; repeats count) of the mean over their positions of
    one over how many drawn labels hold there."""
    active = draws.join(spans, ["symbol", "id"]).select("symbol", "draw", F.explode(F.sequence("start", "stop")).alias("pos"))
    many = active.groupBy("symbol", "pos").agg(F.count("*").alias("c"))
    each = active.join(many, ["symbol", "pos"]).groupBy("symbol", "draw").agg(F.avg(1 / F.col("c")).alias("u"))
    return each.groupBy("symbol").agg(F.avg("u").alias("uniqueness"))
